"""Removing repeated passages: every byte in a string of LENGTH bytes that also starts earlier.

1. Each string of LENGTH bytes is represented by the smallest hash among its short grams (its
   anchor), so equal strings have equal anchors at the same place in them. Neighbouring strings
   with one anchor form a run, about one for each 40 bytes.
2. Runs go to buckets by their anchor's hash, packed by task and bucket. Of equal runs all but
   the first are repeats; a run whose anchor no other run shares has none.
   Runs are equal if their anchors and fingerprints (64 bits each) are.
3. Only runs that share an anchor but differ are left open. Their bytes are fetched, and the
   strings in them are sorted by deep-shallow sorting: equal strings end up next to each other,
   and all but the first of them are repeats. The strings of an anchor with more than HOT_RUNS open
   runs are grouped by 128-bit digests instead, so that no task has to sort all of them.
4. The repeats of a document are merged and cut out of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkqual.llm.shingles import mix
from sparkqual.llm.suffix_sort import sort_equal, words_at
from sparkqual.llm.tables import texts
from sparkqual.plans.durable import durable

LENGTH = 100
# Bytes of the grams an anchor is chosen from; where strings are shorter than two grams, half a string.
# Grams of 16 bytes, two or three words, come up again by chance the more often the larger the table is, and
# each run of such an anchor is left open; those of 32 hardly do.
GRAM = 32
# Bytes of text a task works on at a time (each takes about a hundred bytes of memory), bytes of packed
# runs it holds, and documents it takes from a batch.
CHUNK, HELD, SOME = 1 << 17, 8 << 20, 500
# Documents whose runs make up a bucket (expected), and open runs of a sorting group.
BUCKET_DOCS, GROUP_RUNS = 2000, 4000
# A bucket of more bytes is worked on row by row instead of in one task.
BUCKET_BYTES = 64 << 20
# An anchor with more open runs is compared string by string, spread over tasks.
HOT_RUNS = 5000

_ODD = np.uint64(0x9E3779B97F4A7C15)
# Runs in memory, and their columns as they are packed: one after another, which compresses better.
_RUN = np.dtype([("key", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4"), ("lead", "<i4")])

_COLUMNS = {"key": "<u8", "print": "<u8", "doc": "<i8", "start": "<u4", "n": "<u2", "lead": "<u2"}
# Where strings are short, a byte does for the last two.
_NARROW = _COLUMNS | {"n": "<u1", "lead": "<u1"}


def dump(runs: np.ndarray) -> bytes:
    """Runs as bytes. Texts are shorter than 4 GB, and runs no longer than a string."""
    narrow = int(max(runs["n"].max(initial=0), runs["lead"].max(initial=0)) < 256)
    columns = _NARROW if narrow else _COLUMNS
    return bytes([narrow]) + b"".join(runs[c].astype(t).tobytes() for c, t in columns.items())


def load(packed: bytes) -> np.ndarray:
    columns = _NARROW if packed[0] else _COLUMNS
    n, at = (len(packed) - 1) // sum(np.dtype(t).itemsize for t in columns.values()), 1
    runs = np.zeros(n, _RUN)
    for c, t in columns.items():
        runs[c] = np.frombuffer(packed, t, n, at)
        at += n * np.dtype(t).itemsize
    return runs


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of `width` values from each place on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on, where so many follow."""
    have = min(gram, 8)
    out = words_at(data)[: len(data) - have + 1] >> np.uint64(64 - 8 * have)
    while have < gram:
        step = min(have, gram - have)
        out = out[: len(out) - step] * _ODD + mix(out[step:])
        have += step
    return mix(out)


def overlapping(raw: bytes, length: int) -> list[tuple[int, bytes]]:
    """(place, bytes) of the parts of a text; each string of `length` bytes is in exactly one."""
    if len(raw) <= CHUNK:
        return [(0, raw)]
    return [(at, raw[at : at + CHUNK + length - 1]) for at in range(0, len(raw) - length + 1, CHUNK)]


def runs_of(raw: list[bytes], docs: list[int], length: int, places: list[int] | None = None) -> np.ndarray:
    """Runs of strings of `length` bytes with one anchor: key, fingerprint of all their bytes, document,
    first start, number of strings, distance from the first start to the anchor. `places` tells where
    each part of a text begins in it."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    gram = min(GRAM, (length + 1) // 2)
    if len(data) < length:
        return np.zeros(0, _RUN)
    grams = _grams(data, gram)
    least = _sliding_min(grams, length - gram + 1)
    begins = np.cumsum(sizes) - sizes
    # Strings that lie in one document.
    counts = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, begins, (counts > 0).astype(np.int8))
    np.add.at(valid, begins + counts, -(counts > 0).astype(np.int8))
    valid = np.cumsum(valid)[: len(least)] > 0
    # A run ends where the smallest gram changes, or where the leftmost smallest one is passed.
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[1:]) | ~valid[:-1]
    new[begins[begins < len(least)]] = True
    first = np.flatnonzero(new & valid)
    if not len(first):
        return np.zeros(0, _RUN)
    edges = np.flatnonzero(new | ~valid)
    after = np.searchsorted(edges, first, "right")
    last = np.append(edges, len(least))[after]
    out = np.zeros(len(first), _RUN)
    number = np.searchsorted(begins, first, "right") - 1
    # Empty documents share a start with the next one; the run belongs to the last that starts there.
    out["key"], out["n"] = least[first], last - first
    out["doc"], out["start"] = np.asarray(docs, np.int64)[number], first - begins[number]
    if places is not None:
        out["start"] += np.asarray(places, np.int64)[number]
    powers, backs = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    end = last + length - 1
    out["print"] = mix((sums[end] - sums[first]) * backs[first] + mix(out["n"].astype(np.uint64)))
    out["lead"] = _first_place(grams, out["key"], first, length - gram + 1) - first
    return out


def _first_place(grams: np.ndarray, keys: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each key the first of `width` places from `first` on where a gram equals it."""
    at, left = first.copy(), np.arange(len(first))
    for _ in range(width):
        left = left[grams[at[left]] != keys[left]]
        if not len(left):
            break
        at[left] += 1
    return at


_powers = np.ones((2, 1), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of a fixed odd number, and of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        size = max(n, CHUNK + 1)
        steps = np.stack([np.full(size, _ODD), np.full(size, np.uint64(pow(int(_ODD), -1, 1 << 64)))])
        steps[:, 0] = 1
        _powers = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers


def _shared(key: np.ndarray) -> np.ndarray:
    """Which of the sorted keys are there more than once."""
    out = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, rest): runs equal to an earlier one, and the others."""
    order = np.argsort(runs["key"], kind="stable")
    key = runs["key"][order]
    shared = _shared(key)
    # Only runs of an anchor that others have, too, are sorted further.
    few = order[shared]
    some = runs[few]
    order[shared] = few[np.lexsort((some["start"], some["doc"], some["print"], some["key"]))]
    runs = runs[order]
    same = np.zeros(len(runs), bool)
    same[1:] = (runs["key"][1:] == runs["key"][:-1]) & (runs["print"][1:] == runs["print"][:-1])
    head = runs[np.maximum.accumulate(np.where(same, 0, np.arange(len(runs))))] if len(runs) else runs
    later = (runs["doc"] != head["doc"]) | (runs["start"] != head["start"])
    return runs[same & later], runs[~same]


def spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) of ranges, those that meet or overlap made one; in order."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    # Texts are shorter than 4 GB, so no stop reaches over the next document.
    wide = (np.cumsum(new) - 1) << 33
    reach = np.maximum.accumulate(stop + wide) - wide
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], reach[np.append(heads[1:], len(doc)) - 1] if len(doc) else reach


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as Python values, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            some = batch.slice(at, SOME)
            yield from zip(*(c.to_pylist() for c in some.columns), strict=True)


_PACKED = "bucket int, runs binary, repeats boolean"


def _pack(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        raw, docs, places, fill = [], [], [], 0
        for doc, text in _rows_of(batches):
            whole = text.encode("utf-8", "replace")
            if len(whole) < length:
                continue
            for place, part in overlapping(whole, length):
                raw.append(part)
                docs.append(doc)
                places.append(place)
                fill += len(part)
                if fill >= CHUNK:
                    held.append(runs_of(raw, docs, length, places))
                    size += held[-1].nbytes
                    raw, docs, places, fill = [], [], [], 0
                if size >= HELD:
                    yield pack(np.concatenate(held))
                    held, size = [], 0
        if raw:
            held.append(runs_of(raw, docs, length, places))
        if held:
            yield pack(np.concatenate(held))

    def pack(runs: np.ndarray) -> pa.RecordBatch:
        # Equal runs of a task are settled here: a passage that many documents share is sent once.
        repeats, rest = settle(runs)
        number = (rest["key"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(number, kind="stable")
        rest, number = rest[order], number[order]
        heads = np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1))
        parts = [dump(p) for p in np.split(rest, heads[1:])] if len(rest) else []
        numbers = number[heads].astype(np.int32).tolist()
        if len(repeats):
            parts.append(dump(repeats))
            numbers.append(-1)
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(parts, pa.binary()), pa.array([n < 0 for n in numbers])],
            names=["bucket", "runs", "repeats"],
        )

    return run


_RUN_SCHEMA = "open boolean, key long, doc long, start long, n int, lead int"


def _rows(runs: np.ndarray, open_: bool) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "open": np.full(len(runs), open_),
            "key": runs["key"].copy().view(np.int64),
            "doc": runs["doc"], "start": runs["start"], "n": runs["n"], "lead": runs["lead"],
        }
    )


def _merge_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats among a bucket's runs, and open runs: first of their kind, with others of the same anchor."""
    repeats, rest = settle(np.concatenate([load(r) for r in rows["runs"]]))
    return pd.concat([_rows(repeats, False), _rows(rest[_shared(rest["key"])], True)])


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for packed in batch["runs"]:
            runs = load(packed)
            yield _rows(runs, False).drop(columns="open").assign(print=runs["print"].copy().view(np.int64))


def _settled(length: int):
    """The bytes that packed repeats cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["runs"]:
                runs = load(packed)
                doc, start, stop = spans(runs["doc"], runs["start"], runs["start"] + runs["n"] + (length - 1))
                yield pd.DataFrame({"doc": doc, "start": start, "stop": stop})

    return run


def _merge_rows(packed: DataFrame) -> DataFrame:
    """As `_merge_bucket`, but row by row: for buckets too large for one task."""
    runs = packed.mapInPandas(_unpack, "key long, doc long, start long, n int, lead int, print long")
    first = runs.groupBy("key", "print").agg(F.min(F.struct("doc", "start")).alias("first"))
    kinds = first.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    known = first.join(kinds, "key").select("key", "print", "first", "kinds")
    joined = runs.join(known, ["key", "print"])
    is_first = (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start"))
    return (
        joined.filter(~is_first | (F.col("kinds") > 1))
        .select(is_first.alias("open"), "key", "doc", "start", "n", "lead")
    )


_CONTEXT = "key long, doc long, start long, lead int, bytes binary"


def _contexts(length: int):
    """The bytes of open runs, from their documents' texts."""

    def rows(out: list[list]) -> pa.RecordBatch:
        kinds = {"key": pa.int64(), "doc": pa.int64(), "start": pa.int64(), "lead": pa.int32(), "bytes": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [[] for _ in range(5)], 0
        for batch in batches:
            texts_, runs = batch.column(1), batch.column(2)
            key, start, n, lead = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "n", "lead"))
            ends = start + n + (length - 1)
            edges = runs.offsets.to_numpy()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                raw = texts_[k].as_py().encode("utf-8", "replace")
                own = slice(edges[k], edges[k + 1])
                cut = [raw[a:b] for a, b in zip(start[own].tolist(), ends[own].tolist(), strict=True)]
                for column, values in zip(out, (key[own].tolist(), [doc] * len(cut), start[own].tolist(), lead[own].tolist(), cut), strict=True):
                    column += values
                size += sum(map(len, cut)) + 100 * len(cut)
                if size >= CHUNK:
                    yield rows(out)
                    out, size = [[] for _ in range(5)], 0
        if out[0]:
            yield rows(out)

    return run


def _strings(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all contexts, first byte of every string, context of every string)."""
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    sizes = np.array([len(b) for b in rows["bytes"]], np.int64)
    counts = sizes - length + 1
    context = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, (np.cumsum(sizes) - sizes)[context] + inside, context


def _ranges(doc: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """(doc, start, stop): the bytes strings at these places cover; neighbouring ones in one row."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1) if len(doc) else np.zeros(0, np.int64)
    return pd.DataFrame({"doc": doc[new], "start": start[new], "stop": start[last] + length})


def _sort_group(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data, at, context = _strings(rows, length)
        return _repeated(rows, data, at, context, length)

    return run


def _repeated(rows: pd.DataFrame, data: np.ndarray, at: np.ndarray, context: np.ndarray, length: int) -> pd.DataFrame:
    """Strings equal to an earlier one: sorted among those with the same anchor at the same place."""
    begins = np.searchsorted(context, np.arange(len(rows)))
    inside = at - at[begins][context]
    doc, start = rows["doc"].to_numpy()[context], rows["start"].to_numpy()[context] + inside
    _, key = np.unique(rows["key"].to_numpy(), return_inverse=True)
    place = rows["lead"].to_numpy()[context] - inside
    group = key[context] * np.int64(length + 1) + place
    order, label = sort_equal(data, at, length, group)
    # The earliest of each class of equal strings stays.
    ranked = np.lexsort((start[order], doc[order], label))
    order, label = order[ranked], label[ranked]
    head = np.ones(len(order), bool)
    head[1:] = label[1:] != label[:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    later = (doc[order] != doc[first]) | (start[order] != start[first])
    return _ranges(doc[order][later], start[order][later], length)


def _hash_strings(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            data, at, context = _strings(rows, length)
            begins = np.searchsorted(context, np.arange(len(rows)))
            inside = at - at[begins][context]
            prints = [hashlib.blake2b(data[a : a + length].tobytes(), digest_size=16).digest() for a in at.tolist()]
            yield pd.DataFrame(
                {"print": prints, "doc": rows["doc"].to_numpy()[context], "start": rows["start"].to_numpy()[context] + inside}
            )

    return run


def _hot_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats among the strings of anchors that very many runs share, spread by string."""
    strings = contexts.mapInPandas(_hash_strings(length), "print binary, doc long, start long")
    first = strings.groupBy("print").agg(F.min("doc").alias("first_doc"))
    # Two steps, as minima of single numbers are combined before the shuffle without sorting.
    both = strings.join(first, "print")
    start = (
        both.filter("doc = first_doc").groupBy("print").agg(F.min("start").alias("first_start"), F.count(F.lit(1)).alias("n"))
    )
    return (
        both.join(start, "print")
        .filter("doc <> first_doc or start <> first_start")
        .select("doc", "start", (F.col("start") + length).alias("stop"))
    )


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, start, stop): byte ranges to remove; they may overlap. `docs` has doc and text, each doc once."""
    buckets = max(8, docs.count() // BUCKET_DOCS)
    packed = durable(docs.select("doc", "text").mapInArrow(_pack(length, buckets), _PACKED))
    dealt = packed.filter("not repeats")
    large = durable(
        dealt.groupBy("bucket").agg(F.sum(F.octet_length("runs")).alias("size")).filter(F.col("size") > BUCKET_BYTES)
    )
    merged = dealt.join(large, "bucket", "left_anti").groupBy("bucket").applyInPandas(_merge_bucket, _RUN_SCHEMA)
    if not large.isEmpty():
        merged = merged.unionByName(_merge_rows(dealt.join(large, "bucket", "left_semi")))
    merged = durable(merged)
    settled = packed.filter("repeats").mapInPandas(_settled(length), "doc long, start long, stop long")
    stop = (F.col("start") + F.col("n") + (length - 1)).alias("stop")
    ranges = settled.unionByName(merged.filter("not open").select("doc", "start", stop))
    open_ = merged.filter("open")
    fetched = (
        open_.groupBy("doc")
        .agg(F.collect_list(F.struct("key", "start", "n", "lead")).alias("runs"))
        .join(docs, "doc")
        .select("doc", "text", "runs")
    )
    contexts = durable(fetched.mapInArrow(_contexts(length), _CONTEXT))
    sizes = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    hot = durable(sizes.filter(F.col("size") > HOT_RUNS).select("key"))
    groups = max(1, -(-contexts.count() // GROUP_RUNS))
    sorted_ = (
        contexts.join(hot, "key", "left_anti")
        .withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(_sort_group(length), "doc long, start long, stop long")
    )
    ranges = ranges.unionByName(sorted_)
    if not hot.isEmpty():
        ranges = ranges.unionByName(_hot_repeats(contexts.join(hot, "key", "left_semi"), length))
    return ranges


def _kept(raw: bytes, starts: list[int], stops: list[int]) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, spans, kept bytes) of a text without spans that neither meet nor overlap."""
    kept = b"".join(raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)], strict=True))
    return len(raw), len(raw) - len(kept), len(starts), kept


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    out: list[tuple] = []
    size = 0

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=list(kinds))

    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            docs, texts_, ranges = batch.slice(at, SOME).columns
            # Where a list is null it has no values.
            flat, lengths = ranges.flatten(), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            start, stop = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            row, start, stop = spans(np.repeat(np.arange(len(lengths)), lengths), start, stop)
            edges = np.searchsorted(row, np.arange(len(lengths) + 1)).tolist()
            start, stop = start.tolist(), stop.tolist()
            for k, (doc, text) in enumerate(zip(docs.to_pylist(), texts_.to_pylist(), strict=True)):
                own = slice(edges[k], edges[k + 1])
                out.append((doc, *_kept(text.encode("utf-8", "replace"), start[own], stop[own])))
                size += out[-1][1] + 100
                if size >= CHUNK:
                    yield rows()
                    size = 0
    if out:
        yield rows()


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every document, `kept` being its remaining bytes.

    Texts are their UTF-8 bytes; a byte goes if a string of `length` bytes that covers it also
    starts earlier: in a document with a smaller id, or earlier in the same one. Strings don't
    cross documents and are judged on the input. Null text is empty. Rows of one id must be one
    text: of several texts, the one with the smallest hash is searched and cut, the others stay
    whole, as do rows with a null id. Repeated rows give equal rows. Other columns are ignored; an
    empty table gives no rows.
    """
    docs = texts(docs)
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 and doc_id is not null")
    twice = durable(ids.select("doc_id"))
    part = docs.filter("doc_id is not null")
    rest = docs.filter("doc_id is null")
    if not twice.isEmpty():
        some = part.join(twice, "doc_id", "left_semi").withColumn("mark", F.xxhash64("text"))
        least = some.groupBy("doc_id").agg(F.min("mark").alias("least"))
        some = some.join(least, "doc_id")
        rest = rest.unionByName(some.filter("mark <> least").select("doc_id", "text"))
        copies = some.filter("mark = least").select("doc_id", "text")
        part = part.join(twice, "doc_id", "left_anti").unionByName(copies)
        searched = part.dropDuplicates(["doc_id"])
    else:
        searched = part
    ranges = durable(repeated_ranges(searched.withColumnRenamed("doc_id", "doc"), length))
    listed = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    found = part.join(listed.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    whole = rest.withColumn("ranges", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"))
    return found.unionByName(whole).select("doc_id", "text", "ranges").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
