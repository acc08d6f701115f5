"""Language of texts and of spans in mixed texts.

Every word gets a score for each language: log-likelihood of its character trigrams. The scripts
of its letters narrow the candidates first. Viterbi's algorithm finds the labelling of all words
with the highest sum of scores less a penalty for each change of language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparkqual.llm.tables import texts
from sparkqual.llm.workers import enter

# Documents of each language a model is fitted on (expected; all of a language that has fewer).
SAMPLE = 3000
# Trigrams are counted in so many slots.
SLOTS = 1 << 18
# Log-likelihood a change of language costs.
SWITCH = 12.0
# A language is a candidate for a script that this share of its letters has.
SCRIPT_SHARE = 0.01
# Characters of texts judged together (a longer text is judged by itself).
TOGETHER = 4 << 20
# Words a worker keeps scores of.
CACHE = 500_000

# First code points of runs of letters, and the script from there on.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])

_RUN = re.compile(r"[^\W\d_]+")
_EDGE = "\x02"


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    found = _RUN.findall(text)
    # Numerals such as a half or a superscript two are word characters, but no letters.
    if not all(map(str.isalpha, found)):
        found = [w for run in found for w in ([run] if run.isalpha() else _letters(run))]
    return found


def _letters(run: str) -> list[str]:
    return ["".join(g) for is_letter, g in groupby(run, str.isalpha) if is_letter]


def places_of(text: str) -> Iterator[tuple[int, int]]:
    """(first, after the last) code point of each of `words_of(text)`."""
    for run in _RUN.finditer(text):
        at = run.start()
        for is_letter, g in groupby(run[0], str.isalpha):
            n = sum(1 for _ in g)
            if is_letter:
                yield at, at + n
            at += n


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of all trigrams, first trigram of each word, script of each word's first letter)."""
    joined = _EDGE + _EDGE.join(words) + _EDGE
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    lower = points  # words come lower-cased
    mixed = (lower[:-2] * 0x9E3779B1 + lower[1:-1] * 0x85EBCA6B + lower[2:] * 0xC2B2AE35) & 0xFFFFFFFF
    slots = (mixed ^ (mixed >> 15)) & (SLOTS - 1)
    # A word of n letters has n trigrams from its edge on; the next word's first starts after them.
    keep = np.ones(len(slots), bool)
    keep[starts[1:] - 1] = False
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    script = _SCRIPT[np.maximum(np.searchsorted(_STARTS, points[starts + 1], "right") - 1, 0)]
    return slots[keep], first, script


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n, script) of a task's texts; a slot of -1 counts letters of a script."""
    enter("language.train")
    total: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.lower())
            if not words:
                continue
            slots, _, script = _trigrams(words)
            if lang not in total:
                total[lang] = np.zeros(SLOTS, np.int32)
                scripts[lang] = np.zeros(len(_NAMES), np.int64)
            np.add.at(total[lang], slots, 1)
            scripts[lang] += np.bincount(script, minlength=len(_NAMES))
    for lang, counts in total.items():
        seen = np.flatnonzero(counts)
        kinds = np.flatnonzero(scripts[lang])
        size = len(seen) + len(kinds)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * size),
                pa.array(np.concatenate([seen, np.full(len(kinds), -1)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(seen)), kinds]).astype(np.int32)),
                pa.array(np.concatenate([counts[seen], scripts[lang][kinds]]).astype(np.int64)),
            ],
            names=["lang", "slot", "script", "n"],
        )


@dataclass
class Model:
    """Languages, log-likelihood by slot (only seen ones) and language, candidates by script."""

    langs: list[str]
    slots: np.ndarray
    logs: np.ndarray
    unseen: np.ndarray
    candidates: np.ndarray

    def table(self) -> np.ndarray:
        full = np.tile(self.unseen, (SLOTS, 1)).astype(np.float32)
        full[self.slots] = self.logs
        return full


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the scores on about `sample` documents of each non-null `lang`, chosen by their id's hash.

    A language's share is `sample` over its count of documents, so no rows are gathered to choose
    them; trigrams are counted where the rows are. Texts without letters add nothing. Without any
    labelled document the model has no languages.
    """
    labelled = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = labelled.join(F.broadcast(sizes), "lang").filter(place < F.lit(sample) / F.col("rows"))
    counted = (
        chosen.select("lang", "text")
        .mapInArrow(_count, "lang string, slot int, script int, n long")
        .groupBy("lang", "slot", "script")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(counted["lang"].unique())
    grams = counted[counted["slot"] >= 0]
    slots = np.sort(grams["slot"].unique()).astype(np.int64)
    n = np.zeros((len(slots), len(langs)))
    n[np.searchsorted(slots, grams["slot"]), np.searchsorted(langs, grams["lang"])] = grams["n"]
    size = n.sum(axis=0) + 0.5 * (len(slots) + 1)
    letters = np.zeros((len(_NAMES), len(langs)))
    kinds = counted[counted["slot"] < 0]
    letters[kinds["script"], np.searchsorted(langs, kinds["lang"])] = kinds["n"]
    candidates = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return Model(
        list(langs), slots, np.log((n + 0.5) / size).astype(np.float32), np.log(0.5 / size).astype(np.float32),
        candidates & (letters > 0),
    )


class Scorer:
    """Scores of words by language, kept between batches of a worker."""

    def __init__(self, model: Model):
        self.model, self.logs = model, model.table()
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, less the best one of the word; languages of other scripts get the worst.

        A word in a script of no language tells nothing: all its scores are 0.
        """
        slots, first, script = _trigrams(words)
        scores = np.add.reduceat(self.logs[slots], first, axis=0)
        allowed = self.model.candidates[script]
        lowest = scores.min(axis=1, keepdims=True) - np.float32(5)
        scores = np.where(allowed, scores, lowest)
        scores[~allowed.any(axis=1)] = 0
        return scores - scores.max(axis=1, keepdims=True)

    def rows(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.at})
        if new:
            added = np.concatenate([self.word_scores(new[k : k + 50_000]) for k in range(0, len(new), 50_000)])
            start = len(self.at)
            self.at.update(zip(new, range(start, start + len(new)), strict=True))
            if start + len(new) > len(self.scores):
                grown = np.zeros((2 * (start + len(new)), added.shape[1]), np.float32)
                grown[:start] = self.scores[:start]
                self.scores = grown
            self.scores[start : start + len(new)] = added
        return self.scores[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word: `scores` holds the words of all texts one after another.

    All texts take a step at a time, longest first; ties stay in a language, then take the first.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = lengths[order]
    k = scores.shape[1]
    switched = np.zeros((len(scores), k), bool)
    best_before = np.zeros(len(scores), np.int16)
    active = np.searchsorted(-longest, -np.arange(1, int(longest[0]) + 1 if len(longest) else 1), "right")
    last = np.zeros((len(lengths), k), np.float32)
    state = np.zeros((int(active[0]) if len(active) else 0, k), np.float32)
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        if n < len(state):
            last[n : len(state)] = state[n:]
            state = state[:n]
        if t:
            best = state.argmax(axis=1)
            limit = state[np.arange(n), best][:, None] - np.float32(switch)
            worse = state < limit
            switched[at] = worse
            best_before[at] = best
            state = np.where(worse, limit, state)
        state = state + scores[at]
    last[: len(state)] = state
    path = np.zeros(len(scores), np.int16)
    current = last.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        here = current[:n]
        path[at] = here
        if t:
            current[:n] = np.where(switched[at, here], best_before[at], here)
    return path


def _parts(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of rows that are judged together."""
    group = np.cumsum(lengths) // TOGETHER
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    return list(zip(heads.tolist(), np.diff(np.append(heads, len(lengths))).tolist(), strict=True))


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<start int, end int, lang string>>"


def detect(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every document.

    Spans hold the code points from the first to after the last letter of words in one language.
    `lang_pred` is the language of most letters, ties to the first by name; `score` its share of the
    letters. Null text, text without letters, or a model without languages give `und`, 0 and no
    spans. Null ids stay, repeated rows are judged once each, other columns are ignored.
    """
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language.detect")
        scorer = Scorer(model)
        for batch in batches:
            for k, n in _parts(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)):
                part = batch.slice(k, n)
                found = judge(part.column(1).to_pylist(), scorer)
                langs, shares, spans = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs), pa.array(shares), pa.array(spans, pa.list_(item))],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    def judge(found: list[str], scorer: Scorer) -> list[tuple[str, float, list]]:
        names = scorer.model.langs
        if not names:
            return [("und", 0.0, [])] * len(found)
        if len(scorer.at) > CACHE:
            scorer.reset()
        split = [words_of(t.lower()) for t in found]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for ws in split for w in ws]
        if not words:
            return [("und", 0.0, [])] * len(found)
        path = viterbi(scorer.rows(words), lengths, switch)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        text_of = np.repeat(np.arange(len(split)), lengths)
        weight = np.bincount(text_of * len(names) + path, letters, len(split) * len(names)).reshape(len(split), -1)
        out, at = [], 0
        for k, n in enumerate(lengths.tolist()):
            if not n:
                out.append(("und", 0.0, []))
                continue
            own, best = path[at : at + n], int(weight[k].argmax())
            out.append((names[best], float(weight[k, best] / weight[k].sum()), spans_of(found[k], own, names)))
            at += n
        return out

    def spans_of(text: str, path: np.ndarray, names: list[str]) -> list[dict]:
        changes = np.flatnonzero(np.diff(path)) + 1
        if not len(changes):
            start = next(places_of(text))[0]
            end = len(text) - next(k for k, c in enumerate(reversed(text)) if c.isalpha())
            return [{"start": start, "end": end, "lang": names[path[0]]}]
        places = list(places_of(text))
        firsts = [0, *changes.tolist()]
        lasts = [*(changes - 1).tolist(), len(path) - 1]
        # Lower-casing can split a word in rare scripts; the last place then stands for the rest.
        top = len(places) - 1
        return [
            {"start": places[min(a, top)][0], "end": places[min(b, top)][1], "lang": names[path[a]]}
            for a, b in zip(firsts, lasts, strict=True)
        ]

    return texts(docs).mapInArrow(run, SCHEMA)
