"""URL rules and a list of blocked URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Bits a listed URL takes in the filter. A block has 8 words of 32 bits; a URL sets one bit in each.
BITS_PER_URL = 16
WORDS = 8
# The filter is broadcast up to this many blocks of 40 bytes; beyond, it is joined by block number.
BROADCAST_BLOCKS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for the addresses of a page: no scheme, `www.`, `m.`, query, fragment, `.html` or
    last slash. Empty without a host."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host == "", "").otherwise(F.concat(bare, F.regexp_replace(path, r"(\.html|/)$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one.

    A rule such as `example.net/en/` fits its host, all subdomains, and paths that start with its own.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + start))
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """The bit (0 to 31) a URL sets in each word."""
    second = F.xxhash64(url, F.lit("word"))
    return [F.shiftright(second, 5 * k).bitwiseAND(F.lit(31)).cast("int") for k in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the words of every block that has a URL, combined before the shuffle."""
    words = [F.expr(f"bit_or(shiftleft(1L, b{k}))").alias(f"w{k}") for k in range(WORDS)]
    bits = [b.alias(f"b{k}") for k, b in enumerate(_bits(F.col("canonical")))]
    return listed.select(_block(F.col("canonical"), blocks).alias("block"), *bits).groupBy("block").agg(*words)


def listed_only(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """`pages` with a column `listed`: whether its `canonical` is in `listed` (one row each).

    Pages whose bits are not all set in the filter are settled without a join on the URL; only
    possible hits go to the exact join, which removes false positives.
    """
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (32 * WORDS)))
    words = bloom_filter(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    hit = F.lit(True)
    for k, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.expr(f"shiftright(w{k}, b{k})").bitwiseAND(F.lit(1)) == 1)
    bits = {f"b{k}": b for k, b in enumerate(_bits(F.col("canonical")))}
    tested = (
        pages.withColumn("block", _block(F.col("canonical"), blocks))
        .join(words, "block", "left")
        .withColumns(bits)
        .withColumn("possible", F.coalesce(hit, F.lit(False)) & (F.col("canonical") != ""))
        .select(*pages.columns, "possible")
    )
    exact = listed.select("canonical", F.lit(True).alias("listed"))
    hits = tested.filter("possible").join(exact, "canonical", "left")
    return (
        hits.select(*pages.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
        .unionByName(tested.filter("not possible").select(*pages.columns, F.lit(False).alias("listed")))
    )


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every page.

    `listed` has a column `url` of blocked addresses; null ones and those without a host are no
    entries, repeated ones count once. The longest fitting rule decides; without one, a page is
    blocked where its canonical URL is listed. A null URL, or one without `://`, has an empty host
    and path and is allowed. An empty list blocks nothing. Rows, ids and order of `pages` don't
    matter; its other columns are ignored.
    """
    url = F.col("url")
    entries = (
        listed.select(canonical(host_of(url), path_of(url)).alias("canonical"))
        .filter("canonical <> ''")
        .distinct()
    )
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = parts.select(
        "*",
        rule.alias("rule"),
        verdict.alias("by_rule"),
        F.when(rule.isNull(), canonical(F.col("host"), F.col("path"))).otherwise("").alias("canonical"),
    )
    found = listed_only(judged, entries)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("by_rule", by_list).alias("verdict")
    )
