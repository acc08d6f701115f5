"""Ranked lexical search through max-sketches: bounds from sketches, then exact scores in their order.

1. Index: every document becomes a sketch. Its terms are hashed to one coordinate in each of ROWS
   rows, which keeps the largest frequency (the impact of a term grows with its frequency, and is
   worked out when the corpus' totals are known). It needs no statistics and serves all queries.
2. Bounds: the terms of a batch of queries are looked up in each sketch. A term counts with the
   smallest impact among its coordinates, which is never below its own.
3. Scores: the documents with the largest bounds are read and scored exactly; the k-th best score of a
   query is its threshold, and only documents whose bound reaches it are scored in the next rounds.
   The last round scores all that are left, so no document that belongs to the result is missed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkqual.llm.shingles import mix
from sparkqual.plans.durable import durable

# Rows of a sketch and coordinates of a row (a power of two).
ROWS, WIDTH = 2, 2048
# Frequencies are kept up to this one, which stands for all above; fixed value: the limit of an impact.
MOST, LIMIT = 255, 1_000_000
# Documents of each query that the rounds before the last score.
ROUNDS = (32, 1024)
# Bytes of queries that are searched together, and query terms looked up at a time.
BATCH_BYTES, SLOTS = 512 << 10, 8192
# Documents worked on at a time, and bytes of a text split at a time.
BLOCK, PIECE = 128, 1 << 20
# Rows to score (about 40 bytes each) that are broadcast; more are joined by document.
BROADCAST_ROWS = 500_000

# A-Z become a-z, other ASCII characters but digits and letters become blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text; a long one is split piece by piece."""
    folded = text.translate(_FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    counts: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def coordinates(terms) -> np.ndarray:
    """(ROWS, number of terms): where each term is in a sketch laid out row after row."""
    hashes = mix(np.fromiter(map(zlib.crc32, terms), np.uint64) * _BASE)
    bits = WIDTH.bit_length() - 1
    return np.stack([((hashes >> np.uint64(r * bits)) % np.uint64(WIDTH)).astype(np.int64) + r * WIDTH for r in range(ROWS)])


def sketches(counts: list[Counter]) -> list[bytes]:
    """A sketch of each document: which coordinates are used (a bit each), and their frequencies."""
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64)
    own = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    at = coordinates(chain.from_iterable(counts))
    order = np.argsort(tf, kind="stable")
    dense = np.zeros((len(counts), ROWS * WIDTH), np.uint8)
    for row in at:
        # Of several values for one place the last stays, thus the largest.
        dense[own[order], row[order]] = np.minimum(tf[order], MOST)
    used = dense > 0
    bits = np.packbits(used, axis=1)
    return [b.tobytes() + d[u].tobytes() for b, d, u in zip(bits, dense, used, strict=True)]


def impacts(sketch: list[bytes], size: np.ndarray) -> np.ndarray:
    """(coordinates, documents): largest impact there; `size` is a document's m."""
    width = ROWS * WIDTH // 8
    used = np.unpackbits(np.frombuffer(b"".join(s[:width] for s in sketch), np.uint8)).astype(bool)
    tf = np.frombuffer(b"".join(s[width:] for s in sketch), np.uint8).astype(np.int64)
    each = np.repeat(size, [len(s) - width for s in sketch])
    dense = np.zeros(len(used), np.int64)
    dense[used] = np.where(tf < MOST, 1_000_000_000 * tf // (1000 * tf + 8 * each), LIMIT)
    return np.ascontiguousarray(dense.reshape(len(sketch), -1).T)


class Queries:
    """A batch of queries: their terms, and (when the corpus is known) weights."""

    def __init__(self, texts: list[bytes]):
        self.terms: dict[bytes, int] = {}
        slots = [[self.terms.setdefault(t, len(self.terms)) for t in term_counts(x)] for x in texts]
        self.of = [set(s) for s in slots]
        self.slot = np.fromiter(chain.from_iterable(slots), np.int64)
        self.query = np.repeat(np.arange(len(texts)), [len(s) for s in slots])
        self.at = coordinates(self.terms)
        self.count = len(texts)
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, docs: int, found: dict[int, int]) -> None:
        """Weights from the number of documents that have each term."""
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * docs + 2) / (2 * found.get(i, 0) + 1))) for i in range(len(self.terms))], np.int64
        )

    def bounds(self, impact: np.ndarray) -> np.ndarray:
        """(queries, documents): no score is above its bound."""
        out = np.zeros((self.count, impact.shape[1]), np.int64)
        for a in range(0, len(self.slot), SLOTS):
            slot, query = self.slot[a : a + SLOTS], self.query[a : a + SLOTS]
            most = reduce(np.minimum, (impact[row[slot]] for row in self.at)) * self.weight[slot][:, None]
            heads = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            out[query[heads]] += np.add.reduceat(most, heads, axis=0)
        return out

    def score(self, counts: Counter, size: int, query: int) -> int:
        """The exact score of a document for one query, given the frequencies of all query terms in it."""
        return sum(
            int(self.weight[i]) * (1_000_000_000 * tf // (1000 * tf + 8 * size)) for i, tf in counts.items() if i in self.of[query]
        )


_INDEX = "doc_id long, mark long, n long, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            counts = [term_counts(t.as_py() or b"") for t in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1),
                    pa.array([c.total() for c in counts], pa.int64()), pa.array(sketches(counts), pa.binary()),
                ],
                names=["doc_id", "mark", "n", "sketch"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text binary): rows with equal id and text are told apart nowhere."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text")
    )


def build_index(docs: DataFrame) -> DataFrame:
    """A sketch of every document: (doc_id, mark, n, sketch), n being its number of terms; stored."""
    return durable(keyed(docs).mapInArrow(_sketch, _INDEX))


def _having(terms: dict[bytes, int]):
    """How many documents of a task have each query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(terms), np.int64)
        for batch in batches:
            for text in batch.column(0):
                has = term_counts(text.as_py() or b"").keys() & terms.keys()
                found[[terms[t] for t in has]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some])], names=["term", "n"])

    return run


_PAIR = "query int, doc_id long, mark long, bound long"


def _pairs(query: np.ndarray, doc: np.ndarray, mark: np.ndarray, bound: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query.astype(np.int32)), pa.array(doc, pa.int64(), mask=~known),
            pa.array(mark, pa.int64()), pa.array(bound, pa.int64()),
        ],
        names=["query", "doc_id", "mark", "bound"],
    )


def _blocks(queries: Queries, docs: int, length: int, batches: Iterator[pa.RecordBatch]):
    """Bounds of all queries for some documents at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            ids = part.column(0)
            n = part.column(2).to_numpy(zero_copy_only=False)
            bound = queries.bounds(impacts(part.column(3).to_pylist(), 10 + 90 * n * docs // length))
            known = np.array(ids.is_valid().to_numpy(zero_copy_only=False))
            yield ids.fill_null(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), known, bound


def _largest(queries: Queries, docs: int, length: int, most: int):
    """Of the documents of a task those with the largest bounds, `most` for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((queries.count, 0), np.int64)
        held = [np.zeros((queries.count, 0), t) for t in (np.int64, np.int64, bool)]
        for doc, mark, known, bound in _blocks(queries, docs, length, batches):
            best = np.concatenate([best, bound], axis=1)
            held = [
                np.concatenate([h, np.broadcast_to(x, bound.shape)], axis=1) for h, x in zip(held, (doc, mark, known), strict=True)
            ]
            if best.shape[1] > most:
                top = np.argpartition(-best, most - 1, axis=1)[:, :most]
                best = np.take_along_axis(best, top, axis=1)
                held = [np.take_along_axis(h, top, axis=1) for h in held]
        query, at = np.nonzero(best)
        yield _pairs(query, held[0][query, at], held[1][query, at], best[query, at], held[2][query, at])

    return run


def _reaching(queries: Queries, docs: int, length: int, least: np.ndarray):
    """All pairs whose bound reaches the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, mark, known, bound in _blocks(queries, docs, length, batches):
            query, at = np.nonzero(bound >= least[:, None])
            yield _pairs(query, doc[at], mark[at], bound[query, at], known[at])

    return run


def _scores(queries: Queries, docs: int, length: int):
    """Exact scores of documents for the queries listed with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                doc, mark, text, wanted = (batch.column(c)[row].as_py() for c in range(4))
                counts = term_counts(text or b"")
                size = 10 + 90 * counts.total() * docs // length
                some = {queries.terms[t]: counts[t] for t in counts.keys() & queries.terms.keys()}
                out += [(q, doc, mark, queries.score(some, size, q)) for q in wanted]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["query", "doc_id", "mark", "score"],
            )

    return run


def _score(docs: DataFrame, pairs: DataFrame, queries: Queries, number: int, length: int) -> DataFrame:
    """Stored scores of pairs; texts are read again, of the listed documents only."""
    wanted = durable(pairs.groupBy("doc_id", "mark").agg(F.collect_set("query").alias("wanted")))
    size = wanted.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("wanted")).alias("pairs")).first()
    side = wanted.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "wanted")
    if size["rows"] + (size["pairs"] or 0) <= BROADCAST_ROWS:
        side = F.broadcast(side)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    found = keyed(docs).join(side, same).select("doc_id", "mark", "text", "wanted")
    return durable(found.mapInArrow(_scores(queries, number, length), "query int, doc_id long, mark long, score long"))


def _first(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first rows of each query; no task gets more than `most` of a query from another one."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return rows.withColumn("rank", place).filter(F.col("rank") <= most)


def _best(rows: DataFrame, most: int) -> DataFrame:
    return _first(rows, most, F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("mark"))


def _search_batch(docs: DataFrame, index: DataFrame, queries: Queries, number: int, length: int, k: int) -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of each query of a batch."""
    having = keyed(docs).select("text").mapInArrow(_having(queries.terms), "term long, n long")
    found = having.groupBy("term").agg(F.sum("n").alias("n")).collect()
    queries.weigh(number, {r["term"]: r["n"] for r in found})
    top = index.mapInArrow(_largest(queries, number, length, ROUNDS[0]), _PAIR).distinct()
    order = (F.desc("bound"), F.asc_nulls_first("doc_id"), F.asc("mark"))
    scored = _score(docs, _first(top, ROUNDS[0], *order), queries, number, length)

    def thresholds() -> np.ndarray:
        least = np.ones(queries.count, np.int64)
        for row in _best(scored, k).filter(F.col("rank") == k).collect():
            least[row["query"]] = max(1, row["score"])
        return least

    left = None
    for most in (*ROUNDS[1:], None):
        least = thresholds()
        if left is None:
            left = durable(index.mapInArrow(_reaching(queries, number, length, least), _PAIR).distinct())
        else:
            limits = F.element_at(F.array(*[F.lit(int(x)) for x in least]), F.col("query") + 1)
            left = left.filter(F.col("bound") >= limits)
        known = scored.select("query", F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct()
        same = (left["query"] == known["query"]) & left["doc_id"].eqNullSafe(F.col("_doc")) & (left["mark"] == F.col("_mark"))
        left = durable(left.join(known, same, "left_anti"))
        if left.isEmpty():
            break
        more = left if most is None else _first(left, most, *order)
        scored = durable(scored.unionByName(_score(docs, more, queries, number, length)))
    return _best(scored.filter("score > 0"), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    `docs` has doc_id and text, `items` item_id and text; `index` may be an earlier `build_index(docs)`.
    Equal scores come by ascending doc_id, null first. Null text has no terms. Each row of `docs` is a
    document of its own, also with a repeated or null id; rows of one item_id (nulls too) are one item
    with the terms of all. Other columns are ignored. Empty tables, or items without known
    terms, give no rows. Queries are searched in batches of BATCH_BYTES, each known to the driver.
    """
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    totals = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), text.cast("binary").alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    out = []
    for b in range(batches if totals["length"] else 0):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b).collect()
        texts: dict[int | None, bytes] = {}
        for row in rows:
            texts[row["item_id"]] = texts.get(row["item_id"], b"") + b" " + bytes(row["text"])
        queries = Queries(list(texts.values()))
        if not len(queries.slot):
            continue
        ids = spark.createDataFrame(list(enumerate(texts)), "query int, item_id long")
        found = _search_batch(docs, index, queries, totals["docs"], totals["length"], k)
        out.append(found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return durable(reduce(DataFrame.unionByName, out))
