"""Finding passages of benchmark items in documents, with DataFrame operations only.

1. Documents that share no shingle with any item are left out; this loses nothing, as their
   similarity to every item is 0.
2. Windows as long as an item start at each shared shingle. A window that starts elsewhere holds
   no more shared shingles than one of these.
3. A window's fingerprint (SimHash) has a bit for each of 64 positions: whether the weight of its
   shingles whose hash has the bit is over half.
4. Fingerprints are cut into blocks. Two that differ in at most RADIUS bits differ in at most
   RADIUS / BLOCKS bits in one block, so every item's block values are listed with all values that
   close, and windows join on block and value: all pairs within the radius are found.
5. Pairs found are verified by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkqual.llm.tables import free_name, texts
from sparkqual.plans.durable import durable

# Words of a shingle.
WIDTH = 5
# Fingerprints within this many of 64 bits are candidates; blocks they are cut into. At the limit of
# 0.8 the mean distance is 10; of simulated windows at most 0.002% differ in more than 23 bits.
RADIUS, BLOCKS = 23, 8
# Tables of shared shingles or documents up to this many rows (20 bytes each) are broadcast.
BROADCAST_ROWS = 2_000_000
# A shingle's weight is at most this.
TOP_WEIGHT = 4


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of the words from each place on; empty with fewer words than a shingle has."""
    last = F.size(words) - WIDTH
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingle_rows(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, hash, size): a row per shingle of `text`, with the text's number of shingles."""
    words = table.withColumn("_words", _words(F.col("text")))
    hashed = words.select(*keys, _shingles(F.col("_words")).alias("_hashes"))
    # The outer form, as from the other one a filter on the array is inferred and computes it again.
    exploded = hashed.select(
        *keys, F.size("_hashes").alias("size"), F.posexplode_outer("_hashes").alias("at", "hash")
    )
    return exploded.filter("hash is not null")


def weights(items: DataFrame) -> DataFrame:
    """(hash, weight) of items' shingles: 1 if over half of the items have it, up to TOP_WEIGHT for rare ones."""
    total = items.select("item_id").distinct().count()
    seen = items.groupBy("hash").agg(F.count_distinct("item_id").alias("items"))
    return seen.select("hash", _weight(F.col("items"), total).alias("weight"))


def _weight(items: Column, total: int) -> Column:
    out = F.lit(1)
    for k in range(1, TOP_WEIGHT):
        out = F.when(items * (1 << k) <= F.lit(total), F.lit(k + 1)).otherwise(out)
    return out.cast("long")


def _sums(rows: DataFrame, keys: list[str], lane: int) -> DataFrame:
    """(keys, fingerprint, weight) of each group's weighted shingles.

    The weights of several bit positions are summed in one long, `lane` bits to each.
    """
    ones = sum(1 << (lane * k) for k in range(64 // lane))
    sums = [
        F.sum(F.shiftrightunsigned("hash", j).bitwiseAND(F.lit(ones)) * F.col("weight")).alias(f"s{j}")
        for j in range(lane)
    ]
    summed = rows.groupBy(*keys).agg(*sums, F.sum("weight").alias("weight"))
    bits = F.lit(0).cast("long")
    for j in range(lane):
        for k in range(64 // lane):
            held = F.shiftrightunsigned(f"s{j}", lane * k).bitwiseAND(F.lit((1 << lane) - 1))
            bit = F.when(held * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), j + lane * k)).otherwise(F.lit(0).cast("long"))
            bits = bits.bitwiseOR(bit)
    return summed.select(*keys, bits.alias("fingerprint"), "weight")


def _block(fingerprint: Column, block: Column, width: int) -> Column:
    moved = F.call_function("shiftrightunsigned", fingerprint, block * F.lit(width))
    return moved.bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def within_radius(windows: DataFrame, items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of a window and an item of its length whose fingerprints differ in at most `radius` bits.

    `windows`: (doc_key, start, length, fingerprint), `items`: (item_key, length, fingerprint).
    """
    width = 64 // blocks
    near = [m for m in range(1 << width) if m.bit_count() <= radius // blocks]
    masks = F.split(F.lit(",".join(map(str, near))), ",").cast("array<int>")
    numbers = F.array(*[F.lit(b) for b in range(blocks)])
    listed = (
        items.select("item_key", "length", "fingerprint", F.explode(numbers).alias("block"))
        .withColumn("own", _block(F.col("fingerprint"), F.col("block"), width))
        .withColumn("mask", F.explode(masks))
        .select(
            "item_key", "length", "block", F.col("fingerprint").alias("other"),
            F.col("own").bitwiseXOR(F.col("mask")).alias("value"),
        )
    )
    asked = windows.withColumn("block", F.explode(numbers)).withColumn(
        "value", _block(F.col("fingerprint"), F.col("block"), width)
    )
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius
    return (
        asked.join(listed, ["length", "block", "value"])
        .filter(close)
        .select("doc_key", "start", "length", "item_key")
        .distinct()
    )


def _possible(windows: DataFrame, hits: DataFrame, items: DataFrame, span: int, unknown: Column, percent: int) -> DataFrame:
    """Windows that can be similar to an item of their length.

    What a window shares with an item weighs at most as much as the shingles in it that any item has
    (its hits); the weight of the others is known without looking at them. Nothing is lost.
    """
    end = F.col("start") + F.col("length") - 1
    cut = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(end / span))))
    placed = hits.select("doc_key", "at", "weight", F.floor(F.col("at") / span).alias("bucket"))
    inside = (F.col("at") >= F.col("start")) & (F.col("at") <= end)
    window = ["doc_key", "start", "length"]
    summed = (
        cut.join(placed, ["doc_key", "bucket"])
        .filter(inside)
        .groupBy(*window)
        .agg(F.sum("weight").alias("known"), F.count(F.lit(1)).alias("n"))
    )
    least = _small(items.groupBy("length").agg(F.min("weight").alias("least")))
    whole = F.col("known") + (F.col("length") - F.col("n")) * unknown + F.col("least")
    return summed.join(least, "length").filter(F.col("known") * (100 + percent) >= whole * percent).select(*window)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """(doc_key, doc_id, item_id, similarity, start_word, n_words): the best window for each document and item.

    A row for each document and item with a window whose weighted Jaccard similarity on shingles of
    five words is at least `percent` / 100. Words are lower-cased runs of letters and digits.
    `doc_key` is a hash of id and text, see `key`. Null texts, and texts or items with fewer than
    five words, match nothing; items without id are no items. Rows with equal id and text are one
    document, ties go to the smallest start. Empty tables give no rows; other columns are ignored.
    """
    listed = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    listed = listed.withColumn("item_key", F.xxhash64("item_id", "text"))
    items = durable(shingle_rows(listed, "item_id", "item_key"))
    total = items.select("item_id").distinct().count()
    longest = items.agg(F.max("size")).first()[0] or 1
    lane = 16 if longest * TOP_WEIGHT < 1 << 16 else 32
    weighed = durable(weights(items))
    docs = texts(docs).withColumn("doc_key", key())
    unknown = _weight(F.lit(1), total)
    hits = durable(
        shingle_rows(docs, "doc_key")
        .join(_small(weighed), "hash")
        .select("doc_key", "size", "at", "hash", "weight")
    )
    weighed_items = items.join(weighed, "hash").withColumnRenamed("size", "length")
    item_marks = durable(_sums(weighed_items, ["item_key", "item_id", "length"], lane))
    window = ["doc_key", "start", "length"]
    lengths = _small(items.select("hash", F.col("size").alias("length")).distinct())
    windows = (
        hits.join(lengths, "hash")
        .select(
            "doc_key", "length",
            F.greatest(F.lit(0), F.least("at", F.col("size") - F.col("length"))).alias("start"),
        )
        .distinct()
    )
    chosen = durable(_possible(windows, hits, item_marks, max(longest, 1), unknown, percent))
    # The shingles of each window are cut from its document's, which are computed once.
    listed_windows = _small(chosen.groupBy("doc_key").agg(F.collect_list(F.struct("start", "length")).alias("windows")))
    held = (
        docs.join(listed_windows, "doc_key")
        .withColumn("words", _words(F.col("text")))
        .select("doc_key", "doc_id", _shingles(F.col("words")).alias("hashes"), "windows")
        .select("doc_key", "doc_id", "hashes", F.explode_outer("windows").alias("at"))
        .select(
            "doc_key", "doc_id", "at.start", "at.length", F.slice("hashes", F.col("at.start") + 1, F.col("at.length")).alias("hashes")
        )
    )
    held = durable(held.dropDuplicates(window))
    shingles = held.select("doc_id", *window, F.explode_outer("hashes").alias("hash")).join(_small(weighed), "hash", "left")
    shingles = shingles.withColumn("weight", F.coalesce("weight", unknown))
    marked = durable(_sums(shingles, window, lane))
    pairs = durable(within_radius(marked, item_marks, radius, blocks))
    in_window = (
        shingles.join(_small(durable(pairs.select(*window).distinct())), window, "left_semi")
        .groupBy(*window, "doc_id", "hash", "weight")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_item = weighed_items.groupBy("item_key", "hash").agg(F.count(F.lit(1)).alias("m"))
    shared = (
        pairs.join(in_window, window)
        .join(in_item, ["item_key", "hash"])
        .groupBy(*window, "doc_id", "item_key")
        .agg(F.sum(F.col("weight") * F.least("n", "m")).alias("shared"))
    )
    both = F.col("window_weight") + F.col("item_weight")
    similar = (
        shared.join(marked.select(*window, F.col("weight").alias("window_weight")), window)
        .join(item_marks.select("item_key", "item_id", F.col("weight").alias("item_weight")), "item_key")
        .filter(F.col("shared") * (100 + percent) >= both * percent)
        .withColumn("similarity", F.col("shared") / (both - F.col("shared")))
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (F.col("length") + WIDTH - 1).alias("words")))
    return (
        similar.groupBy("doc_key", "doc_id", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_key", "doc_id", "item_id", "best.similarity",
            (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.words").cast("long").alias("n_words"),
        )
    )


def key() -> Column:
    """The document's key: a hash of its id and text (null text counts as empty)."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that `contaminated` lists; all columns stay."""
    name = free_name(docs, "doc_key")
    leaks = durable(contaminated(docs, benchmark, **options).select(F.col("doc_key").alias(name)).distinct())
    return docs.withColumn(name, key()).join(_small(leaks), name, "left_anti").select(*docs.columns)
