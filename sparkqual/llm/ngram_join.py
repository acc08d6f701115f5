"""Near-duplicate documents: an exact Jaccard join over word shingles by T-occurrence search.

1. Each text becomes its set of hashed shingles; texts with equal sets form a class, and one
   document stands for it.
2. Shingles are put into one order, rare ones first. Two sets that are similar enough share one
   of the first (1 - threshold) of their shingles, so only those go into inverted lists.
3. In each list all members are compared with its first and its last member (stars). What proves
   similar is merged into components; then only pairs of different components are left to
   compare. A large group of near copies costs a few links per member, not all pairs. Where links
   are asked for (`ngram_links`), the other pairs inside components are compared too.
4. Candidates are narrowed by length, by the place of the shared shingle, and by bitmaps whose
   difference bounds the difference of the sets; none of these loses a similar pair.
5. Candidates of a document are decided by DivideSkip: of the inverted lists of its shingles over
   the candidates, short ones are heap-merged, long ones probed by binary search, and candidates
   that reach the required overlap stay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkqual.llm.components import components
from sparkqual.llm.shingles import mix, shingle_sets
from sparkqual.llm.tables import stored, texts
from sparkqual.llm.workers import enter
from sparkqual.plans.durable import durable

# Words of the bitmap that bounds differences; sets of more than LONG shingles have a longer one too.
BITMAP = 16
LONG, LONG_BITMAP = 2500, 256
# Candidates of one document that are decided together, and sets of one task's group (expected).
CHUNK, GROUP = 512, 600
# Members of a list that meet in one key, and sets on each side of a block of pairs that are decided.
BLOCK, SIDE = 1000, 200
# Shingles before a shared one by which a pair that has met at one of them is told.
BEFORE = 8
# Tables of ids of up to this many rows (40 bytes each) are broadcast; beyond, they are joined by key.
BROADCAST_ROWS = 1_000_000
# Slots of the shingle counts that order shingles: four per document within these bounds.
SLOTS = (1 << 12, 1 << 20)
# Cost of probing against merging (published value).
MU = 0.0085

_TEXTS = 250


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for k in range(0, batch.num_rows, _TEXTS):
        part = batch.column(column).slice(k, _TEXTS).to_pylist()
        yield k, shingle_sets(part, width)


def _class_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a set: equal for equal sets."""
    if not len(shingles):
        return 0
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(mix(mix(shingles + place * np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True)).view(np.int64)[0])


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents' shingles fall into each slot, as a rank of rarity (0 to 255).

    All documents count; each task sends its slots once, and the tasks' tables are added part by
    part. The result has a fixed largest size. It only orders shingles: any order gives the same links.
    """
    rows = docs.count()
    slots = 1 << (min(max(4 * rows, SLOTS[0]), SLOTS[1]) - 1).bit_length()
    parts = max(1, slots >> 14)
    shift = np.uint64(64 - slots.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram_join.counts")
        total = np.zeros(slots, np.int32)
        for batch in batches:
            for _, found in _sets(batch, 0, width):
                joined = np.concatenate(found) if found else np.zeros(0, np.uint64)
                total += np.bincount((joined >> shift).astype(np.int64), minlength=slots).astype(np.int32)
        tables = [t.tobytes() for t in np.split(total, parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array(tables, pa.binary())], names=["part", "counts"]
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in rows["counts"])
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [total.tobytes()]})

    tables = (
        docs.select("text")
        .mapInArrow(count, "part int, counts binary")
        .groupBy("part")
        .applyInPandas(add, "part int, counts binary")
        .collect()
    )
    if not tables:
        return np.zeros(slots, np.uint8)
    total = np.concatenate([np.frombuffer(t["counts"], np.int64) for t in sorted(tables, key=lambda t: t["part"])])
    # Eight ranks to each doubling of the count.
    return np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)


def _bitmap(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmap: each shingle flips one bit, so two maps differ in no more bits than the sets."""
    flips = np.bincount((shingles & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


def summaries(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, class, n, prefix, wide, b0 ..) of every document; `prefix` holds its rarest shingles,
    `wide` the longer bitmap of long sets, b0 .. the short one."""
    ranks = shingle_counts(docs, width)
    shift = np.uint64(64 - len(ranks).bit_length() + 1)
    names = [f"b{k}" for k in range(BITMAP)]

    def first(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s.view(np.int64)
        size = len(s) - -(-percent * len(s) // 100) + 1
        rank = ranks[(s >> shift).astype(np.int64)]
        return s[np.argsort(rank, kind="stable")[:size]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram_join.summaries")
        for batch in batches:
            for k, found in _sets(batch, 1, width):
                maps = np.stack([_bitmap(s, BITMAP) for s in found])
                wide = [_bitmap(s, LONG_BITMAP).tolist() if len(s) > LONG else None for s in found]
                prefixes = [first(s) for s in found]
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
                columns = [
                    batch.column(0).slice(k, len(found)),
                    pa.array([_class_id(s) for s in found], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    lists,
                    pa.array(wide, pa.list_(pa.int64())),
                    *[pa.array(np.ascontiguousarray(maps[:, j])) for j in range(BITMAP)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "class", "n", "prefix", "wide", *names])

    schema = "doc_id long, class long, n long, prefix array<long>, wide array<long>, " + ", ".join(f"{b} long" for b in names)
    return docs.mapInArrow(run, schema)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _allowed(differ: Column, na: Column, nb: Column, percent: int) -> Column:
    """Sets of na and nb shingles that differ in at least `differ` may have the wanted overlap."""
    # With overlap o the difference is na + nb - 2 o, and o >= p (na + nb) / (100 + p).
    return differ * (100 + percent) <= (na + nb) * (100 - percent)


def _could_be_similar(a: str, b: str, percent: int) -> Column:
    """Lengths and short bitmaps allow 100 * overlap >= percent * union."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum(
        (F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(BITMAP)), F.lit(0)
    )
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & _allowed(differ, na, nb, percent)


def _long_maps_allow(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (key, q, c, nq, nc, apart) without those of long sets that the longer bitmaps exclude."""
    both = F.least("nq", "nc") > LONG
    differ = F.aggregate(
        F.zip_with("mq", "mc", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n
    )
    maps = _small(maps)
    long = (
        pairs.filter(both)
        .join(maps.toDF("q", "mq"), "q")
        .join(maps.toDF("c", "mc"), "c")
        .filter(_allowed(differ, F.col("nq"), F.col("nc"), percent))
    )
    return pairs.filter(~both).unionByName(long.select(*pairs.columns))


def divide_skip(lists: list[np.ndarray], least: int, required: np.ndarray) -> list[int]:
    """Members that occur in at least `required[member]` of the sorted lists; `least` is their minimum.

    The longest lists are set aside. A member that reaches `least` must occur in `least` less their
    number of the others, which are merged; those found are looked up in the long ones.
    """
    if not lists or least > len(lists):
        return []
    lists = sorted(lists, key=len)
    longest = max(len(lists[-1]), 2)
    aside = min(int(least / (MU * log2(longest) + 1)), least - 1)
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    members, counts = [], []
    for member, hits in groupby(heapq.merge(*[s.tolist() for s in short])):
        n = sum(1 for _ in hits)
        if n >= least - aside:
            members.append(member)
            counts.append(n)
    ids, total = np.array(members, np.int64), np.array(counts, np.int64)
    for k, probed in enumerate(long):
        if not len(ids):
            break
        at = np.minimum(np.searchsorted(probed, ids), len(probed) - 1)
        total += probed[at] == ids
        reach = total + (len(long) - k - 1) >= required[ids]
        if not reach.all():
            ids, total = ids[reach], total[reach]
    return ids[total >= required[ids]].tolist() if len(ids) else []


def similar_to(query: np.ndarray, candidates: list[np.ndarray], percent: int) -> list[int]:
    """Numbers of the candidate sets with 100 * overlap >= percent * union, by T-occurrence search."""
    sizes = np.array([len(c) for c in candidates], np.int64)
    required = -(-percent * (len(query) + sizes) // (100 + percent))
    member = np.repeat(np.arange(len(candidates)), sizes)
    shingles = np.concatenate(candidates)
    at = np.minimum(np.searchsorted(query, shingles), len(query) - 1)
    shared = query[at] == shingles
    at, member = at[shared], member[shared]
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    lists = np.split(member, starts[1:]) if len(at) else []
    return divide_skip(lists, int(required.min()), required)


def _decide(percent: int):
    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        enter("ngram_join.decide")
        held = {k: np.asarray(s, np.int64) for k, s in zip(sets["class"], sets["shingles"], strict=True)}
        found = []
        for q, group in pairs.groupby("q", sort=False):
            for k in range(0, len(group), CHUNK):
                part = group[k : k + CHUNK]
                found.append(part.iloc[similar_to(held[q], [held[c] for c in part["c"]], percent)])
        columns = ["q", "c", "apart"]
        return pd.concat(found)[columns] if found else pairs[columns].head(0)

    return run


def _set_table(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, shingles) of the classes in `wanted` (class, doc_id), from their documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram_join.sets")
        for batch in batches:
            for k, found in _sets(batch, 1, width):
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate([np.sort(s.view(np.int64)) for s in found])
                own = pa.array([_class_id(s) for s in found], pa.int64())
                wanted_class = batch.column(0).slice(k, len(found))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([wanted_class, own, lists], names=["class", "own", "shingles"])

    found = docs.join(_small(wanted), "doc_id").select("class", "text")
    found = found.mapInArrow(run, "class long, own long, shingles array<long>")
    # An id that occurs with several texts fetches all of them.
    return found.filter("class = own").drop("own")


def verified(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, rows: int
) -> DataFrame:
    """(q, c, apart): of the pairs (key, q, c, apart), those whose sets are similar, stored. `rows`: of `docs`.

    The pairs of a key with many classes are cut into blocks of up to SIDE classes on either side
    (approximate counts, they only deal the work); a set is sent once to each block.
    """
    pairs = stored(pairs.select("key", "q", "c", "apart"), rows)
    n = pairs.count()
    hot = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > SIDE).select("key")
    sides = pairs.join(_small(hot), "key").groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.approx_count_distinct("q").alias("nq"), F.approx_count_distinct("c").alias("nc")
    )
    sides = stored(sides.withColumns({f"k{x}": F.ceil(F.col(f"n{x}") / SIDE) for x in "qc"}), n // SIDE)
    sent = sides.agg(F.sum("size"), F.sum(F.expr("nq * kc + nc * kq"))).first()
    groups = max(1, -(-(n - (sent[0] or 0) + (sent[1] or 0)) // GROUP))
    place = [F.pmod(F.xxhash64(x), F.coalesce(f"k{x}", F.lit(1))) for x in "qc"]
    dealt = pairs.join(_small(sides.select("key", "kq", "kc")), "key", "left").select(
        "q", "c", "apart", F.pmod(F.xxhash64("key", *place), F.lit(groups)).alias("group")
    )
    dealt = stored(dealt, n)
    roles = stored(
        dealt.select("group", F.col("q").alias("class"))
        .distinct()
        .unionByName(dealt.select("group", F.col("c").alias("class")).distinct())
        .distinct(),
        2 * n,
    )
    involved = roles.select("class").distinct()
    wanted = stored(involved.join(classes, "class").select("class", F.col("first_doc").alias("doc_id")), n)
    sets = _set_table(docs, wanted, width).join(_small(roles), "class").select("group", "class", "shingles")
    decided = dealt.groupBy("group").cogroup(sets.groupBy("group"))
    return durable(decided.applyInPandas(_decide(percent), "q long, c long, apart boolean"))


def _meeting(left: DataFrame, percent: int, inside: bool) -> DataFrame:
    """(key, q, c, nq, nc, apart): pairs that share a token of `left` and may be similar, each once.

    A token's members are cut into blocks of about BLOCK; a block meets itself and each later one under a
    key of its own. `apart`: in different components; the other pairs are left out unless `inside`.
    """
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    left = left.withColumn("last", blocks - 1).withColumn("own", F.pmod(F.xxhash64("class"), blocks).cast("int"))
    first = left.withColumn("block", F.col("own")).withColumn("other", F.explode(F.sequence("own", "last")))
    second = left.withColumn("block", F.explode(F.sequence(F.lit(0), "own"))).withColumn("other", F.col("own"))
    # The overlap is at most one more than what follows the shared shingle in either prefix order.
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    apart = F.col("x.component") != F.col("y.component")
    met = first.alias("x").join(
        second.alias("y"),
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("x.other") == F.col("y.other"))
        & ((F.col("x.block") < F.col("x.other")) | (F.col("x.class") < F.col("y.class")))
        & (F.lit(inside) | apart)
        & (most * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
        & _could_be_similar("x", "y", percent)
        # At the first token they share nothing before it is shared; most later meetings are dropped.
        & ~F.arrays_overlap("x.before", "y.before"),
    )
    return (
        met.select(
            F.col("x.token").alias("key"),
            F.least("x.class", "y.class").alias("q"), F.greatest("x.class", "y.class").alias("c"),
            F.least("x.n", "y.n").alias("nq"), F.greatest("x.n", "y.n").alias("nc"), apart.alias("apart"),
        )
        .groupBy("q", "c", "nq", "nc", "apart")
        .agg(F.min("key").alias("key"))
    )


def _linked(docs: DataFrame, width: int, percent: int, inside: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, component_id, class), classes (class, first_doc, members), members of them
    (class, doc_id), and links (q, c) of classes: all of them if `inside`, else enough for the components."""
    docs = texts(docs)
    n_docs = docs.count()
    rows = durable(summaries(docs, width, percent))
    bits = [f"b{k}" for k in range(BITMAP)]
    known = rows.filter("n > 0 and doc_id is not null")
    ids = known.select("class", "doc_id").distinct()
    classes = stored(ids.groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("members")), n_docs)
    # One row per class: that of its smallest document.
    copies = known.select("doc_id", "class").join(classes, "class").filter("doc_id <> first_doc")
    copies = stored(copies.select("doc_id", "class").distinct(), n_docs)
    picked = known.join(_small(copies), ["doc_id", "class"], "left_anti")
    place = stored(picked.select("class", "n", *bits).dropDuplicates(["class"]), 2 * n_docs)
    maps = stored(picked.filter("wide is not null").select("class", "wide").dropDuplicates(["class"]), 2 * n_docs)
    entries = picked.select("class", "n", F.posexplode("prefix").alias("at", "token"))
    lists = (
        entries.groupBy("token")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("held"))
        .filter("low < high")
    )
    shared = durable(entries.join(lists, "token"))
    star = (
        shared.select(F.col("low").alias("q"), F.col("class").alias("c"))
        .unionByName(shared.select(F.col("high").alias("q"), F.col("class").alias("c")))
        .filter("q <> c")
        .distinct()
        .alias("p")
        .join(place.alias("x"), F.expr("p.q = x.class"))
        .join(place.alias("y"), F.expr("p.c = y.class"))
        .filter(_could_be_similar("x", "y", percent))
        .select(F.col("q").alias("key"), "q", "c", F.col("x.n").alias("nq"), F.col("y.n").alias("nc"), F.lit(True).alias("apart"))
    )
    star = stored(star, n_docs)
    links = verified(_long_maps_allow(star, maps, percent), docs, classes, width, percent, n_docs)
    merged = components(links.select("q", "c"))
    grouped = (
        shared.join(merged.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
        # Pairs with a list's first or last member were compared above.
        .filter("class <> low and class <> high and held > 3")
        .drop("low", "high")
    )
    if not inside:
        mixed = (
            grouped.groupBy("token")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .filter("low < high")
            .select("token")
        )
        grouped = grouped.join(mixed, "token")
    preceding = Window.partitionBy("class").orderBy("at").rowsBetween(-BEFORE, -1)
    grouped = grouped.withColumn("before", F.collect_list("token").over(preceding))
    left = durable(grouped.join(place.drop("n"), "class"))
    tried = star.select(F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c")).distinct()
    rest = _meeting(left, percent, inside).join(tried, ["q", "c"], "left_anti")
    links = links.unionByName(verified(_long_maps_allow(rest, maps, percent), docs, classes, width, percent, n_docs))
    # Rows of one id with different texts tie their classes together.
    twice = known.groupBy("doc_id").agg(F.min("class").alias("q"), F.max("class").alias("r")).filter("q < r")
    ties = known.join(twice, "doc_id").filter("class > q").select("q", F.col("class").alias("c"))
    merged = components(links.filter("apart").select("q", "c").unionByName(ties))
    named = classes.join(merged.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = named.join(smallest, "component").select("class", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id"))
    found = (
        rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
        .join(named, "class", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("component_id"))).alias("component_id"),
            "class",
        )
    )
    return found, classes, ids, links.select(F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c")).distinct()


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Words are runs of characters other than space and \\t to \\r, A-Z lower-cased; a set holds the
    distinct shingles of `width` words, or the whole sequence of a shorter text. Two documents are
    linked when 100 * overlap >= `percent` * union; the component is the smallest doc_id reachable.
    Null text and text without words: an empty set, linked with nothing, its own component. Rows
    with a null id get no component and link nothing. Rows with the same id are one document in the
    links, each keeps its own row. An empty table gives no rows; other columns are ignored. Sets are
    compared by 64-bit hashes of their shingles.
    """
    return _linked(docs, width, percent, inside=False)[0].drop("class")


def ngram_links(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as of `ngram_join` with n_links; members (class, doc_id); links (q, c) of classes, q < c.

    A class is a set of shingles; its members are the distinct ids that have it. All members of a class
    are linked with each other, and with all members of each class that a link names; no link of
    different texts is left out. n_links counts the other members a row's set is linked with (an id
    with several sets is a member of several classes); 0 without words, null for a null id.
    """
    found, classes, members, links = _linked(docs, width, percent, inside=True)
    links = durable(links)
    size = classes.select("class", "members")
    halves = [
        links.join(size.withColumnRenamed("class", b), b).groupBy(F.col(a).alias("class")).agg(F.sum("members").alias("others"))
        for a, b in ("qc", "cq")
    ]
    others = halves[0].unionByName(halves[1]).groupBy("class").agg(F.sum("others").alias("others"))
    counted = size.join(others, "class", "left").select(
        "class", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    found = found.join(counted, "class", "left").select("doc_id", "n_shingles", "component_id", n_links.alias("n_links"))
    return found, members, links
