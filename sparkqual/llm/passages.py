"""Removing passages of WINDOW words that occur more than once, found with FM-indexes of shards.

1. Each window of words has an anchor, the smallest hash among its short grams, so equal windows have
   equal anchors. Neighbouring windows with one anchor in one place form a run of at most RUN windows.
   A run whose anchor occurs nowhere else holds no repeated window and is dropped; anchors are
   counted per task first, so a frequent one is sent once a task.
2. The words of the other runs are cut out of their documents, as segments that go to the shard of
   their anchor; equal segments are one, with its number of copies. Of an anchor with very many
   runs each window is a segment that goes by its own hash, so no shard gets them all.
3. A shard's distinct segments make up an FM-index, and all are streamed through it: backward search
   tells which of their windows occur at least twice in the shard, thus in the corpus. Words are
   compared as they are written; hashes only tell where they go.
4. The repeated windows of a document are merged, and their words are taken out of its text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkqual.llm.fm_index import FMIndex, repeated_windows
from sparkqual.llm.shingles import mix, word_hashes
from sparkqual.plans.durable import durable

WINDOW, GRAM = 35, 8
# Bytes of text a task works on at a time, of runs and of segments it holds.
CHUNK, HELD, SEGMENTS = 1 << 20, 8 << 20, 8 << 20
# Documents whose runs make up a bucket (expected), and words of the distinct segments of a shard.
BUCKET_DOCS, SHARD_WORDS = 4000, 1_000_000
# An anchor is frequent from this many runs on, and this share of all runs: at most as many as go into one.
FREQUENT_RUNS, FREQUENT_SHARE = 2000, 1e-7

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
# A run as it is packed; `runs` counts those of its anchor in a task.
_COLUMNS = {"key": "<u8", "doc": "<i8", "mark": "<i8", "start": "<u4", "n": "<u1", "runs": "<u4"}
_RUN = np.dtype(list(_COLUMNS.items()))


def pieces(raw: bytes, shared: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of a text, some at a time; each repeats the last `shared` words."""
    at, place, held = 0, 0, []
    while at < len(raw) or not place and not held:
        cut = _SPACE.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
        end = cut.start() if cut else len(raw)
        words = held + raw[at:end].split()
        yield place, words
        held = words[max(0, len(words) - shared) :]
        place += len(words) - len(held)
        if end >= len(raw):
            break
        at = end


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of `width` values from each place on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def runs_of(texts: list[str], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor) of the runs in some texts."""
    hashes, sizes = word_hashes(texts)
    if len(hashes) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    grams, have, power = hashes, 1, _ODD
    while have < gram:
        step = min(have, gram - have)
        grams = grams[: len(grams) - step] + np.uint64(pow(int(_ODD), step, 1 << 64)) * grams[step:]
        have += step
    grams = mix(grams)
    width = window - gram + 1
    least = _sliding_min(grams, width)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - window + 1, 0)
    own = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[own] + inside
    # A run ends where the text or the smallest gram changes, or where a place of it is passed.
    new = np.ones(len(at), bool)
    new[1:] = (inside[1:] == 0) | (least[at[1:]] != least[at[:-1]]) | (grams[at[:-1]] == least[at[1:]])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    return own[head], inside[head], n, least[at[head]]


def _doc_texts(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, int, int]], list[str]]]:
    """Texts, about CHUNK bytes at a time, with (document, mark, place of the first word)."""
    names, texts, size = [], [], 0
    for row in range(batch.num_rows):
        doc, mark, text = (batch.column(c)[row].as_py() for c in range(3))
        if len(text) <= CHUNK:
            parts = [(0, text)]
        else:
            long = pieces(text.encode("utf-8", "replace"), WINDOW - 1)
            parts = ((p, b" ".join(w).decode("utf-8", "replace")) for p, w in long)
        for place, part in parts:
            names.append((doc, mark, place))
            texts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield names, texts
                names, texts, size = [], [], 0
    if texts:
        yield names, texts


def _pack(buckets: int):
    """Runs of a task by bucket; those whose anchor the task has seen before go to bucket -1, as known to be shared."""

    def pack(runs: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(runs["key"], kind="stable")
        runs = runs[order]
        head = np.flatnonzero(np.r_[True, runs["key"][1:] != runs["key"][:-1]])
        count = np.diff(np.append(head, len(runs)))
        runs["runs"] = np.repeat(count, count)
        sent = runs[head]
        number = (sent["key"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(number, kind="stable")
        sent, number = sent[order], number[order]
        cut = np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1))
        parts = [dump(p) for p in np.split(sent, cut[1:])] if len(sent) else []
        shared = runs[runs["runs"] > 1]
        numbers = [*number[cut].astype(np.int64).tolist(), -1][: len(parts) + 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array([*parts, dump(shared)], pa.binary())], names=["bucket", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for names, texts in _doc_texts(batch):
                own, start, n, key = runs_of(texts, WINDOW, GRAM)
                if not len(own):
                    continue
                doc, mark, place = (np.array(x, np.int64) for x in zip(*names, strict=True))
                runs = np.zeros(len(own), _RUN)
                runs["key"], runs["doc"], runs["mark"], runs["n"] = key, doc[own], mark[own], n
                runs["start"] = place[own] + start
                held.append(runs)
                size += runs.nbytes
                if size >= HELD:
                    yield pack(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield pack(np.concatenate(held))

    return run


def dump(runs: np.ndarray) -> bytes:
    return b"".join(runs[c].tobytes() for c in _COLUMNS)


def load(packed: bytes) -> np.ndarray:
    n, at = len(packed) // _RUN.itemsize, 0
    runs = np.zeros(n, _RUN)
    for c, t in _COLUMNS.items():
        runs[c] = np.frombuffer(packed, t, n, at)
        at += n * np.dtype(t).itemsize
    return runs


_SHARED = "doc long, mark long, place long, key long, total long"


def _rows(runs: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """Start and number of windows share a number; `total` is -1 for runs, else that of their anchor."""
    place = runs["start"].astype(np.int64) << 8 | runs["n"]
    key = runs["key"].copy().view(np.int64)
    return pd.DataFrame({"doc": runs["doc"], "mark": runs["mark"], "place": place, "key": key, "total": total})


def _merge(frequent: float):
    """Runs of a bucket whose anchor another task has too, and the anchors with at least `frequent` runs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        runs = np.concatenate([load(r) for r in rows["runs"]])
        runs = runs[np.argsort(runs["key"], kind="stable")]
        head = np.flatnonzero(np.r_[True, runs["key"][1:] != runs["key"][:-1]])
        sent = np.diff(np.append(head, len(runs)))
        total = np.add.reduceat(runs["runs"].astype(np.int64), head)
        # Those with several in their task are listed there.
        new = runs[(np.repeat(sent, sent) > 1) & (runs["runs"] == 1)]
        hot = total >= frequent
        return pd.concat([_rows(new, np.full(len(new), -1)), _rows(runs[head][hot], total[hot])])

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for packed in batch["runs"]:
            runs = load(packed)
            yield _rows(runs, np.full(len(runs), -1))


_OCCURRENCE = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<u4")])
_SEGMENT = "route long, words binary, n int, copies long, where binary"


def _segments(frequent: np.ndarray):
    """Segments of the listed runs, equal ones of a task in one row with all their places."""

    def rows(found: dict) -> pa.RecordBatch:
        routes, words, n, where = [], [], [], []
        for (route, segment, count), places in found.items():
            routes.append(route)
            words.append(segment)
            n.append(count)
            where.append(np.array(places, _OCCURRENCE).tobytes())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(routes, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int32()),
                pa.array([len(w) // _OCCURRENCE.itemsize for w in where], pa.int64()), pa.array(where, pa.binary()),
            ],
            names=["route", "words", "n", "copies", "where"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(list)
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                doc, mark, text = (batch.column(c)[row].as_py() for c in range(3))
                runs = np.array(sorted(batch.column(3)[row].as_py()), np.int64).reshape(-1, 2)
                starts, counts, keys = (runs[:, 0] >> 8).tolist(), (runs[:, 0] & 255).tolist(), runs[:, 1].tolist()
                hot = np.isin(runs[:, 1], frequent).tolist()
                i = 0
                for place, words in pieces(text.encode("utf-8", "replace"), 2 * WINDOW):
                    while i < len(starts) and starts[i] + counts[i] + WINDOW - 1 <= place + len(words):
                        a, n = starts[i] - place, counts[i]
                        if hot[i]:
                            for k in range(n):
                                segment = b" ".join(words[a + k : a + k + WINDOW])
                                route = int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "little", signed=True)
                                places = found[route, segment, 1]
                                size += 24 + (0 if places else len(segment) + 400)
                                places.append((doc, mark, starts[i] + k))
                        else:
                            segment = b" ".join(words[a : a + n + WINDOW - 1])
                            places = found[keys[i], segment, n]
                            size += 24 + (0 if places else len(segment) + 400)
                            places.append((doc, mark, starts[i]))
                        i += 1
                    if size >= SEGMENTS:
                        yield rows(found)
                        found, size = defaultdict(list), 0
        if found:
            yield rows(found)

    return run


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """The windows of a shard's segments that occur twice, as bits."""
    numbers: dict[bytes, int] = {}
    segments = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in s.split(b" ")], np.int64) for s in rows["words"]]
    sizes = np.array([len(s) for s in segments], np.int64)
    index = FMIndex(segments, rows["copies"].to_numpy(), int(sizes.max()) + 1)
    mask = repeated_windows(index, sizes, WINDOW).view(np.int64)
    return pd.DataFrame({"route": rows["route"], "print": rows["print"], "mask": mask})[mask != 0]


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, mark, start, stop): repeated windows at the places of their segments, neighbouring ones in one row."""
    for batch in batches:
        if not len(batch):
            continue
        places = np.frombuffer(b"".join(batch["where"]), _OCCURRENCE)
        own = np.repeat(np.arange(len(batch)), [len(w) // _OCCURRENCE.itemsize for w in batch["where"]])
        bits = np.zeros((len(batch), 66), np.int8)
        mask = batch["mask"].to_numpy().astype("<i8").view(np.uint8).reshape(len(batch), 8)
        bits[:, 1:65] = np.unpackbits(mask, axis=1, bitorder="little")
        edge = np.diff(bits, axis=1)
        row, first = np.nonzero(edge == 1)
        after = np.nonzero(edge == -1)[1]
        # Each place takes the ranges of its segment.
        many = np.bincount(row, minlength=len(batch))
        begin = np.cumsum(many) - many
        copied = np.repeat(np.arange(len(own)), many[own])
        inner = np.arange(len(copied)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        at = begin[own[copied]] + inner
        start = places["start"].astype(np.int64)[copied]
        yield pd.DataFrame(
            {
                "doc": places["doc"][copied],
                "mark": places["mark"][copied],
                "start": start + first[at],
                "stop": start + after[at] + WINDOW - 1,
            }
        )


_DOC = ["doc", "mark"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, mark, text): rows with equal doc and mark have equal id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    return docs.select(
        id_.alias("doc_id"),
        F.coalesce(id_, F.lit(0)).alias("doc"),
        F.xxhash64(F.coalesce(id_.cast("string"), F.lit("null")), text).alias("mark"),
        text.alias("text"),
    )


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, mark, start, stop): ranges of words to remove; they may overlap. `docs` is `keyed`."""
    buckets = max(8, docs.count() // BUCKET_DOCS)
    docs = docs.select(*_DOC, "text")
    packed = durable(docs.mapInArrow(_pack(buckets), "bucket long, runs binary"))
    sent = packed.filter("bucket >= 0")
    rows = packed.agg(F.sum(F.octet_length("runs"))).first()[0] or 0
    frequent = max(FREQUENT_RUNS, rows / _RUN.itemsize * FREQUENT_SHARE)
    merged = durable(sent.groupBy("bucket").applyInPandas(_merge(frequent), _SHARED))
    hot = np.array([r["key"] for r in merged.filter("total >= 0").select("key").collect()], np.int64)
    known = packed.filter("bucket < 0").mapInPandas(_unpack, _SHARED)
    shared = merged.filter("total < 0").unionByName(known)
    listed = shared.groupBy(*_DOC).agg(F.collect_set(F.array("place", "key")).alias("runs"))
    wanted = docs.join(listed, _DOC).select(*_DOC, "text", "runs")
    found = durable(
        wanted.mapInArrow(_segments(hot), _SEGMENT).withColumn("print", F.xxhash64("words", "n"))
    )
    distinct = found.groupBy("route", "print", "words").agg(F.sum("copies").alias("copies"))
    words = found.agg(F.sum(F.col("n") + WINDOW - 1)).first()[0] or 0
    shards = max(8, -(-words // SHARD_WORDS))
    repeated = (
        distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_search, "route long, print long, mask long")
    )
    places = found.select("route", "print", "where").join(durable(repeated), ["route", "print"])
    return places.select("where", "mask").mapInPandas(_ranges, "doc long, mark long, start long, stop long")


def _kept(text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, removed words, kept words) of a text, from ranges in ascending order."""
    i, stop, gone, total, kept = 0, 0, 0, 0, []
    for place, words in pieces(text.encode("utf-8", "replace"), 0):
        total, at = place + len(words), place
        while at < total:
            # Words before `stop` go; ranges are taken up as they come.
            while i < len(ranges) and ranges[i][0] <= at:
                stop = max(stop, ranges[i][1])
                i += 1
            if stop > at:
                until = min(total, stop)
                gone += until - at
            else:
                until = min(total, ranges[i][0]) if i < len(ranges) else total
                kept += words[at - place : until - place]
            at = until
    return total, gone, b" ".join(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary()}
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for row in range(batch.num_rows):
            doc, text, ranges = (batch.column(c)[row].as_py() for c in range(3))
            out.append((doc, *_kept(text, sorted((r["start"], r["stop"]) for r in ranges or ()))))
            size += len(out[-1][3])
            if size >= CHUNK or row == batch.num_rows - 1:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))
                out, size = [], 0


def remove_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every document, `kept` being its remaining words with single blanks.

    Words are runs without blank or \\t to \\r. A word goes if a window of WINDOW words of its document
    that covers it also starts anywhere else: in another row, or elsewhere in the same text. Windows
    don't cross documents and are judged on the input. Null text has no words. Every row is a
    document, so repeated rows are copies of each other, also with a null id. Other columns are
    ignored; an empty table gives no rows. Long texts are worked on CHUNK bytes at a time.
    """
    docs = keyed(docs)
    ranges = durable(repeated_ranges(docs))
    listed = ranges.groupBy(*_DOC).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    joined = docs.join(listed, _DOC, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
