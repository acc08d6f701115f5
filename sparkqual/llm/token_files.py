"""Writing token ids to files in document order, and reading them back.

The file format: rows of (part, segment, data). A segment holds whole documents in ascending
order of their id: a table of (doc_id, tokens), then the ids as blocks of the range coder, each
with its own checksum. Segments of a part follow one another by number, parts follow doc_id. Every
segment is read by itself, so a lost task costs its segments only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkqual.llm.range_coder import decode, encode
from sparkqual.llm.tables import texts
from sparkqual.llm.tokens import encoder
from sparkqual.llm.workers import enter
from sparkqual.plans.durable import checkpoint_root

# Tokens of a segment (one document more at most), documents of a part (expected).
SEGMENT, PART_DOCS = 2 << 20, 10_000
# Segments whose place (24 bytes each) is broadcast to those that read them; more are joined by number.
BROADCAST_SEGMENTS = 1_000_000


def new_folder(spark: SparkSession) -> str:
    """A folder nobody has used, below the shared one."""
    return f"{checkpoint_root(spark)}/token_files/{uuid.uuid4().hex}"


def segment(docs: list[tuple[int | None, bytes]]) -> bytes:
    """Documents (doc_id, ids as little-endian unsigned 32-bit integers) as bytes; a null id inverts its length."""
    table = np.array([(0, ~(len(ids) // 4)) if d is None else (d, len(ids) // 4) for d, ids in docs], "<i8").tobytes()
    ids = np.frombuffer(b"".join([ids for _, ids in docs]), "<u4")
    return struct.pack("<II", len(docs), zlib.crc32(table)) + table + encode(ids)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, which of them are null, tokens of each, all ids); every checksum must hold."""
    if len(data) < 8:
        raise ValueError("not a segment of documents")
    n, check = struct.unpack_from("<II", data)
    table = data[8 : 8 + 16 * n]
    if len(table) != 16 * n or zlib.crc32(table) != check:
        raise ValueError("the segment's table of documents is damaged")
    docs = np.frombuffer(table, "<i8").reshape(n, 2)
    ids = decode(data[8 + 16 * n :])
    null = docs[:, 1] < 0
    tokens = np.where(null, ~docs[:, 1], docs[:, 1])
    if int(tokens.sum()) != len(ids):
        raise ValueError("the segment's documents and ids differ in length")
    return docs[:, 0], null, tokens, ids


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Encode all texts, each followed by `end_id`, to files in `path`, ascending by doc_id.

    Null text is empty; null ids come first; rows of one id follow each other by text; other
    columns are ignored; an empty table writes no segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        part, number, held, size = context.partitionId() if context else 0, 0, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                coded = code.ids(some.column(1).to_pylist())
                for doc_id, ids in zip(some.column(0).to_pylist(), coded, strict=True):
                    held.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT:
                        yield row(part, number, size, held)
                        number, held, size = number + 1, [], 0
        if held:
            yield row(part, number, size, held)

    def row(part: int, number: int, size: int, held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()),
             pa.array([segment(held)], pa.binary())],
            names=["part", "segment", "tokens", "data"],
        )

    docs = texts(docs)
    parts = max(1, -(-docs.count() // PART_DOCS))
    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    # Coded ids don't compress further.
    ordered.mapInArrow(run, "part int, segment int, tokens long, data binary").write.option(
        "compression", "uncompressed"
    ).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; `start` counts the ids of all documents before it."""
    rows = spark.read.parquet(path)
    # A part's offset comes from the parts before it: one row per part, not per segment, is ordered as a whole.
    parts = rows.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.select("part", "segment", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("local"))
        .join(parts, "part")
        .select("part", "segment", (F.col("local") + F.col("offset")).alias("first"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token_files.read")
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, null, tokens, ids = read_segment(data.as_py())
                ends = np.cumsum(tokens)
                raw = ids.astype("<u4").tobytes()
                pieces = [raw[4 * (e - n) : 4 * e] for n, e in zip(tokens.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=null), pa.array(first + ends - tokens), pa.array(pieces, pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    if rows.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    found = rows.select("part", "segment", "data").join(starts, ["part", "segment"])
    return found.select("first", "data").mapInArrow(run, "doc_id long, start long, ids binary")
