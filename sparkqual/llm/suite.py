"""The operators of this folder as queries over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkqual.llm import decontaminate, language, lexical_search, neighbours, ngram_join, packing, passages, prefix_trie, secrets, substrings, token_files, toxicity, urls
from sparkqual.llm.tables import held_out, table

# Fixed values of the query: rules as (verdict, host and path).
URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
# A page that has one of these words puts its address on the list of blocked URLs.
LISTING_WORDS = "(?i)moron|pathetic|disgusting|worthless"


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, by kind and place."""
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("markov").alias("n_markov"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to files and read back."""
    path = token_files.new_folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: sets of 4-word shingles that are 85% alike."""
    return ngram_join.ngram_links(table(spark, sf_dir, "documents"), width=4, percent=85)[0]


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors to every 20th one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.detect(docs, language.train(docs.filter(~held_out())))
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 100 bytes that start earlier, too."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's address."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.col("html").rlike(LISTING_WORDS)).select("url")
    return urls.filter_urls(pages, listed, URL_RULES).drop("url")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark).drop("doc_key")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per node of the trie of rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words that occur more than once."""
    found = passages.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
with parts as (
  select page_id, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
), named as (
  select *, case when host = '' then '' else
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') end as canonical,
    case
      when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parts
), listed as (
  select distinct canonical from named
  where canonical <> '' and regexp_matches(html, '(?i)moron|pathetic|disgusting|worthless')
)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from named
"""

OP11_SQL = """
with recursive bits as (
  select range as b, 0 as k, range as v from range(256)
  union all
  select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bits where k < 8
), entry as (select b, v from bits where k = 8),
crc as (
  select distinct conv_id as c, cast(conv_id as varchar) as s, 1 as i, cast(4294967295 as bigint) as r
  from conversations where conv_id is not null
  union all
  select c, s, i + 1, xor(r // 256, entry.v)
  from crc join entry on entry.b = xor(r % 256, ascii(substr(s, i, 1)))
  where i <= length(s)
), taken as (select c, xor(r, 4294967295) % 9 as h from crc where i = length(s) + 1),
turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null
), rebuilt as (
  select taken.c, i, role, text from taken join turns on turns.c = taken.c - taken.c % 5 where i <= h
  union all
  select taken.c, i, role, text from taken join turns on turns.c = taken.c where i > h
), steps as (
  select c, row_number() over (partition by c order by i) as depth, text,
    list({'role': role, 'text': text}) over (partition by c order by i) as path
  from rebuilt
), paths as (
  select c, depth, strlen(text) as bytes, path from steps
  union all
  select c, 0, 0, [] from taken
), lasts as (select c, max(depth) as depth from paths group by c),
nodes as (
  select path, paths.depth, any_value(bytes) as bytes, min(paths.c) as conv_id, count(*) as n_convs,
    coalesce(string_agg(cast(paths.c as varchar), ',' order by paths.c) filter (paths.depth = lasts.depth), '') as ends
  from paths join lasts on lasts.c = paths.c
  group by path, paths.depth
), counted as (
  select nodes.path, nodes.depth, nodes.conv_id, nodes.n_convs, nodes.bytes, nodes.ends,
    count(child.path) as n_children
  from nodes left join nodes as child on child.depth = nodes.depth + 1 and child.path[1:nodes.depth] = nodes.path
  group by all
)
select node.conv_id, node.depth, parent.conv_id as parent_conv_id, node.n_convs, node.n_children,
  count(*) filter (below.n_children = 0) as n_leaves,
  cast(sum((below.n_convs - 1) * below.bytes) as bigint) as saved_tokens,
  sha256(node.ends) as ends_sha256
from counted as node
join counted as below on below.depth >= node.depth and below.path[1:node.depth] = node.path
left join counted as parent on parent.depth = node.depth - 1 and parent.path = node.path[1:node.depth - 1]
group by node.path, node.conv_id, node.depth, parent.conv_id, node.n_convs, node.n_children, node.ends
"""

OP12_SQL = r"""
with folded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), sizes as (
  select doc_id, terms, cast(len(terms) as bigint) as n,
    cast(count(*) filter (len(terms) > 0) over () as bigint) as docs, cast(sum(len(terms)) over () as bigint) as length
  from folded
), counted as (
  select doc_id, n, docs, length, term, cast(count(*) as bigint) as tf
  from (select doc_id, n, docs, length, unnest(terms) as term from sizes)
  group by all
), wanted as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), weights as (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from counted group by term, docs
), scores as (
  select item_id, doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) as bigint) as score
  from wanted join weights using (term) join counted using (term)
  group by item_id, doc_id
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scores where score > 0
qualify rank <= 10
"""

OP13_SQL = r"""
with split as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), windows as (
  select r, i, md5(array_to_string(words[i:i + 34], ' ')) as content
  from (select r, words, unnest(range(1, len(words) - 33)) as i from split)
), repeated as (
  select r, i from windows
  where content in (select content from windows group by content having count(*) > 1)
), placed as (
  select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from split
), judged as (
  select placed.r, p, word,
    coalesce(max(i) over (partition by placed.r order by p) >= p - 34, false) as gone
  from placed left join repeated on repeated.r = placed.r and repeated.i = p
), kept as (
  select r, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by p) filter (not gone) as words
  from judged group by r
)
select doc_id, cast(len(split.words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(coalesce(kept.words, '')) as kept_sha256
from split left join kept using (r)
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_secrets": op2_secrets,
    "op3_token_files": op3_token_files,
    "op4_ngram_join": op4_ngram_join,
    "op5_neighbours": op5_neighbours,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_substrings": op8_substrings,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_passages": op13_passages,
}
_SQL = {"op9_url_filter": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_passages": OP13_SQL}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
