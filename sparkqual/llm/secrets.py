"""Secrets in texts: fixed patterns, and strings that look random to two character models.

Both models are first-order Markov chains over the characters of tokens. One is trained on
strings labelled random (values the patterns found), one on ordinary words and identifiers (all
other text but long tokens). A long token whose log-likelihood ratio is above a threshold is a secret too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkqual.llm.tables import texts
from sparkqual.llm.workers import enter

KINDS = ("assign", "access", "hex", "markov")
# Characters a token can have; 0 stands for any other, thus for a token's end.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
# Shortest token the models judge, and the log-likelihood ratio (nats) from which it is a secret.
MIN_TOKEN = 16
THRESHOLD = 12.0
# Every character counts as seen this often by either model, and a character's successors are
# smoothed with this many that follow the model's shares of all characters.
PRIOR, SMOOTHING = 0.5, 20.0
# Texts that a worker holds as strings at once; results leave it in batches of as many.
_TEXTS = 200

_STATE = np.zeros(256, np.int64)
_STATE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A longest run of hex digits is one match; runs under 16 fail.
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")

Span = tuple[str, int, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end, start of the value) by the fixed patterns, ordered by start, then kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    if len(found) > 1:
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def _pairs(text: str) -> np.ndarray:
    """How often a state follows another, over a whole text."""
    states = _STATE[np.frombuffer(text.encode(errors="replace"), np.uint8)]
    states = np.concatenate([[0], states, [0]])
    return np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, _TEXTS) for k in range(0, batch.num_rows, _TEXTS))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, random, ordinary) of a task's texts."""
    enter("secrets.train")
    random, ordinary = np.zeros(STATES * STATES, np.int64), np.zeros(STATES * STATES, np.int64)
    for batch in batches:
        for part in _slices(batch):
            rest, values = [], []
            for text in part.column(0).to_pylist():
                spans, at = base_spans(text), 0
                for _, start, end, value in spans:
                    rest.append(text[at : max(at, start)])
                    values.append(text[value:end])
                    at = max(at, end)
                rest.append(text[at:] if at else text)
            # Long tokens are what is to be judged, so they are no samples of ordinary ones.
            ordinary += _pairs(_TOKEN.sub(" ", "\n".join(rest)))
            if values:
                random += _pairs("\n".join(values))
    seen = np.flatnonzero(random + ordinary)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int32)), pa.array(random[seen]), pa.array(ordinary[seen])],
        names=["pair", "random", "ordinary"],
    )


def train(docs: DataFrame, prior: float = PRIOR) -> np.ndarray:
    """Log-likelihood ratio random : ordinary for each state after each other.

    Counts come from all documents, summed by task and then by pair; at most STATES^2 rows reach
    the driver. Rare pairs fall back on how frequent the second character is; without any labelled
    string the random model is uniform.
    """
    counted = (
        docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .mapInArrow(_pair_counts, "pair int, random long, ordinary long")
        .groupBy("pair")
        .agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary"))
        .collect()
    )
    logs = []
    for kind in ("random", "ordinary"):
        n = np.zeros(STATES * STATES)
        for row in counted:
            n[row["pair"]] += row[kind]
        n = n.reshape(STATES, STATES)[:, 1:]  # a token's end tells nothing
        share = (n.sum(axis=0) + prior) / (n.sum() + prior * n.shape[1])
        logs.append(np.log((n + SMOOTHING * share) / (n.sum(axis=1, keepdims=True) + SMOOTHING)))
    ratio = np.zeros((STATES, STATES))
    ratio[:, 1:] = logs[0] - logs[1]
    return ratio


def score(token: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio of an ASCII token; above 0 it is more likely random."""
    states = _STATE[np.frombuffer(token.encode(), np.uint8)]
    return float(ratio[0, states[0]] + ratio[states[:-1], states[1:]].sum())


def spans_of(text: str, ratio: np.ndarray, threshold: float = THRESHOLD) -> list[Span]:
    """Base spans, and tokens that the models take for random; of one that base spans cut, each long piece."""
    base = base_spans(text)
    added: list[Span] = []
    for m in _TOKEN.finditer(text):
        at = m.start()
        pieces = []
        for _, start, end, _ in base:
            if at < end and start < m.end():
                pieces.append((at, start))
                at = end
        pieces.append((at, m.end()))
        for start, end in pieces:
            if end - start >= MIN_TOKEN and score(text[start:end], ratio) >= threshold:
                added.append(("markov", start, end, start))
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))) if added else base


def scan(docs: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every document.

    Offsets are code points, the end exclusive; spans are ordered by start, then kind. Spans of
    the patterns may overlap; those of the models don't overlap them. Null or empty text has no
    spans; null ids stay; repeated rows are scanned once each; other columns are ignored; an empty
    table gives no rows. `ratio` defaults to models trained on these documents.
    """
    ratio = train(docs) if ratio is None else ratio
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets.scan")
        for batch in chain.from_iterable(map(_slices, batches)):
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b, _ in spans_of(t, ratio, threshold)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(item))], names=["doc_id", "spans"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def redact(docs: DataFrame, mask: str = "[secret]", ratio: np.ndarray | None = None) -> DataFrame:
    """`docs` with each secret in `text` replaced by `mask`, overlapping ones by a single one.

    All columns and rows stay; where a text changes, `n_chars` (if there) is counted anew. Null text stays null.
    """
    ratio = train(docs) if ratio is None else ratio

    def clean(text: str | None) -> str | None:
        spans = spans_of(text, ratio) if text else []
        if not spans:
            return text
        parts, at = [], 0
        for _, start, end, _ in spans:
            if start >= at:
                parts += [text[at:start], mask]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets.redact")
        for batch in chain.from_iterable(map(_slices, batches)):
            at = batch.schema.get_field_index("text")
            was = batch.column(at).to_pylist()
            now = [clean(t) for t in was]
            out = batch.set_column(at, batch.schema.field(at), pa.array(now, batch.column(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                counts = [c if a == b else len(b) for a, b, c in zip(was, now, batch.column(n).to_pylist(), strict=True)]
                out = out.set_column(n, batch.schema.field(n), pa.array(counts, batch.column(n).type))
            yield out

    return docs.mapInArrow(run, docs.schema)
