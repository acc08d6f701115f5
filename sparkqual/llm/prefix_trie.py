"""A trie of conversation prefixes: shared turns are one node, with totals of every subtree.

1. Turns are numbered by running totals over range parts, and a prefix is known by the running XOR of
   128-bit hashes of its turns, taken in bands of BAND turns: no task orders a whole conversation.
2. Prefixes are grouped into nodes. A node's smallest member stands for it, so the path from the
   root to a node is the path of one conversation.
3. Totals of subtrees: a node explodes to its ancestors in its own band of depths only, at most BAND.
   The topmost nodes of the bands form a trie of their own, BAND times flatter, which is
   totalled the same way; a completed total then goes to the nodes of the band above it. The
   rounds grow with the logarithm of the depth, the explosion is at most BAND each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkqual.plans.durable import durable
from sparkqual.plans.ranks import running_totals
from sparkqual.plans.skew import join_unique

# Depths of a band.
BAND = 32
# Turns of the first conversation of a family that others can start with.
FAMILY, SHARED = 5, 9
# Bytes of ids in one row on the way to a node's checksum.
CHUNK = 1 << 20

_KEY = ["k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, at, n, digest, bytes): every turn with its place (from 0) in its conversation of n turns.

    Turns come in the order of `turn`, nulls first; those of equal `turn` by the first characters
    of role and text, then by a digest. Null role and text are empty; rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.substring(role, 1, 16).alias("role"),
            F.substring(text, 1, 32).alias("text"),
            digest.alias("digest"),
        ).alias("place"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("one"),
    )
    return running_totals(rows, ["conv"], "place", ["one"]).select(
        "conv", F.col("before_one").alias("at"), F.col("total_one").alias("n"), F.col("place.digest").alias("digest"), "bytes"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first one of their family: (conv, depth, digest, bytes), (conv, depth).

    Conversation c takes the first h turns of conversation c - c % FAMILY (all if it has fewer, none
    if there is none), then its own turns after its first h; h is the crc32 of its number
    modulo SHARED. The second table has the number of turns of every conversation.
    """
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(SHARED))
    convs = turns.filter("at = 0").select(
        "conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base")
    )
    first = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = durable(
        convs.join(first, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0))))
    )
    heads = turns.filter(F.col("at") < SHARED - 1).select(F.col("conv").alias("base"), "at", "digest", "bytes")
    before = convs.select("conv", "base", "shared").join(heads, "base").filter("at < shared")
    # Only conversations with a shorter first one are moved, and no hot one goes to one task.
    moved = convs.filter("shared < h and n > h").select("conv", (F.col("h") - F.col("shared")).alias("by"), "n")
    own = join_unique(turns.filter(F.col("at") >= taken).drop("n"), moved, ["conv"], "left", "n")
    depth = (F.col("at") + 1).alias("depth")
    rows = before.select("conv", depth, "digest", "bytes").unionByName(
        own.select("conv", (F.col("at") + 1 - F.coalesce("by", F.lit(0))).alias("depth"), "digest", "bytes")
    )
    lengths = convs.select("conv", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    return rows, lengths


def running_xor(rows: DataFrame, band: int = BAND) -> DataFrame:
    """`rows` (conv, depth from 1 on, k1, k2, ...) with k1 and k2 combined over all depths up to each row.

    A window orders at most `band` rows; totals of the bands are combined the same way, one level up.
    """
    number = F.floor((F.col("depth") - 1) / band).cast("long")
    rows = rows.withColumn("band", number)
    inside = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(
        *[c for c in rows.columns if c not in _KEY], *[F.expr(f"bit_xor({k})").over(inside).alias(k) for k in _KEY]
    )
    if not (rows.agg(F.max("depth")).first()[0] or 0) > band:
        return out.drop("band")
    totals = rows.groupBy("conv", (F.col("band") + 1).alias("depth")).agg(*[F.expr(f"bit_xor({k})").alias(k) for k in _KEY])
    above = running_xor(durable(totals), band).select(
        "conv", F.col("depth").alias("band"), *[F.col(k).alias(f"above_{k}") for k in _KEY]
    )
    joined = out.join(above, ["conv", "band"], "left")
    return joined.select(
        *[c for c in out.columns if c not in (*_KEY, "band")],
        *[F.col(k).bitwiseXOR(F.coalesce(f"above_{k}", F.lit(0))).alias(k) for k in _KEY],
    )


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """(k1, k2, values): sums of `values` over every node's subtree.

    `nodes` has (conv, depth, values), one row each, where `conv` is a conversation that goes through
    the node; `paths` has (conv, depth, k1, k2) for at least these conversations at every depth.
    """
    number = F.floor(F.col("depth") / band).cast("long").alias("band")
    of = nodes.select("conv", number, F.col("depth").alias("below"), *values)
    on = paths.select("conv", number, "depth", *_KEY)
    sums = [F.sum(v).alias(v) for v in values]
    inside = of.join(on, ["conv", "band"]).filter("depth <= below").groupBy(*_KEY).agg(*sums)
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < band:
        return inside
    inside = durable(inside)
    # The topmost nodes of all bands, as a trie whose depth counts bands.
    up = (F.col("depth") / band).cast("long").alias("depth")
    steps = paths.filter(F.col("depth") % band == 0).select("conv", up, *_KEY)
    tops = nodes.filter(F.col("depth") % band == 0).select("conv", up)
    tops = durable(tops.join(steps, ["conv", "depth"]).join(inside, _KEY).select("conv", "depth", *_KEY, *values))
    done = subtree_totals(tops.drop(*_KEY), steps, values, band)
    # Completed totals go to the nodes above them, in the band before theirs.
    sent = tops.drop(*values).join(done, _KEY).filter("depth > 0")
    sent = sent.select("conv", (F.col("depth") - 1).alias("band"), *values)
    return inside.unionByName(sent.join(on, ["conv", "band"]).select(*_KEY, *values)).groupBy(*_KEY).agg(*sums)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node that follow each other, joined by commas: (k1, k2, first id, ids)."""
    held: tuple[int, int] | None = None
    ids: list[str] = []
    size, first = 0, 0
    out: list[tuple[int, int, int, str]] = []

    def rows() -> pa.RecordBatch:
        k1, k2, at, text = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.string())],
            names=["k1", "k2", "first", "ids"],
        )

    for batch in batches:
        k1, k2, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        if not len(conv):
            continue
        heads = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(conv)], strict=True):
            key = (int(k1[a]), int(k2[a]))
            if ids and (key != held or size > CHUNK):
                out.append((*held, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                held, first = key, int(conv[a])
            more = list(map(str, conv[a:b].tolist()))
            ids += more
            size += sum(map(len, more))
        if out:
            yield rows()
    if ids:
        out.append((*held, first, ",".join(ids)))
        yield rows()


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order; only one chunk is held."""
    held, state = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([state.hexdigest()])],
            names=["k1", "k2", "ends_sha256"],
        )

    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if held == (k1, k2):
                state.update(b",")
            else:
                if held:
                    yield row()
                held, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
    if held:
        yield row()


def end_checksums(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the ascending `conv` of each node, joined by commas.

    Ids are sorted by ranges that also split a node, and joined to chunks there; a checksum then
    reads its node's chunks one after another, as SHA-256 must.
    """
    chunks = (
        ends.select(*_KEY, "conv")
        .repartitionByRange(*_KEY, "conv")
        .sortWithinPartitions(*_KEY, "conv")
        .mapInArrow(_join_ids, "k1 long, k2 long, first long, ids string")
    )
    ordered = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return ordered.mapInArrow(_checksums, "k1 long, k2 long, ends_sha256 string")


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest"))


def prefix_trie(rows: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """One row per distinct sequence of first turns (node), the empty one included.

    `rows` has (conv, depth, digest, bytes), a row per conversation and turn, depth from 1 on without
    gaps; `lengths` (conv, depth) has every conversation, also those without turns. Returns
    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Without conversations there are no nodes.
    """
    # The hash of a turn is kept next to the running one: their XOR is the parent's.
    hashed = rows.select("conv", "depth", "bytes", *[_hashed(i).alias(k) for i, k in enumerate(_KEY)])
    hashed = hashed.select("*", F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    walked = running_xor(hashed, band).select(
        "conv", "depth", "bytes", *_KEY, F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    tops = lengths.select(
        "conv", zero.alias("depth"), zero.alias("bytes"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2")
    )
    paths = durable(walked.unionByName(tops))
    nodes = durable(
        paths.groupBy("depth", *_KEY, "p1", "p2", "bytes").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    )
    below = nodes.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    nodes = durable(
        nodes.join(below.agg(F.count(F.lit(1)).alias("n_children")), _KEY, "left").fillna(0, ["n_children"])
    )
    own = nodes.select(
        "conv",
        "depth",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(own, paths.select("conv", "depth", *_KEY), ["n_leaves", "saved_tokens"], band)
    ends = end_checksums(lengths.join(paths, ["conv", "depth"]))
    parents = nodes.filter("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("rows")
    )
    linked = join_unique(nodes, parents, ["p1", "p2"], "left", "rows")
    return (
        linked.join(totals, _KEY)
        .join(ends, _KEY, "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    Null role or text is empty, a null turn comes first, equal turns come by role and text, repeated rows
    are turns of their own, rows without conv_id are left out, other columns are ignored; an
    empty table has no nodes. Texts of any length are read once, to a digest.
    """
    rows, lengths = rebuilt(durable(turns_of(conversations)))
    return prefix_trie(rows, lengths, band)
