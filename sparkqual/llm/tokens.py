"""Token ids of whole texts by a public tokenizer, with a cache of chunks between spaces.

Both vocabularies split a text into words first and encode each word by itself, so a chunk
that starts at a space has the same ids wherever it stands. Chunks not seen before go to the
`tokenizers` library. Texts where this doesn't hold in full (characters outside Latin
script, runs of spaces, strings of special tokens) go to the library as a whole.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import accumulate, chain, islice, pairwise
from operator import attrgetter

import numpy as np
import public_tokenizers

from sparkqual.llm.workers import kept

# Chunks and words that a worker keeps (about 200 bytes each). The first ones are kept, as most of what
# comes later comes once; where more than this share of chunks is unknown, the cache starts anew.
CACHE, UNKNOWN = 500_000, 0.3

_LATIN = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ]*")
# What a lower-casing vocabulary splits such a text into, once lower-cased (letters may leave the range above).
_OTHER = r"\x00-\x40\x5b-\x60\x7b-©«-´¶-¹»-¿×÷"
_PIECES = re.compile(rf"[^{_OTHER}]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼-¾]|[!-/:-@\[-`{{-~¡-©«-±´¶-¸»¿×÷]+")
# The kind of each character up to U+00FF: space, letter, digit, mark.
_KINDS = np.array(
    [0 if chr(c).isspace() else 1 if chr(c).isalpha() else 2 if chr(c).isnumeric() else 3 for c in range(256)], np.uint8
)
_LOOSE_SPACE = re.compile(r" (?=\s|\Z)")
# Bytes as the characters that byte-level vocabularies write them with: printable ones stand for themselves,
# the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + n for n, b in enumerate(_HIDDEN)}
_WORDS = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+| ?[.,;:!?]+|\n(?!\n)")
_LETTERS = re.compile(rf" ?[{_LATIN}]+")
_ID = attrgetter("id")


def _pieces(text: str) -> list[str]:
    """The pieces of a lower-cased text."""
    try:
        raw = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return _PIECES.findall(text)
    if len(raw) < 2 or "'" in text:
        return _PIECES.findall(text)
    # A space where the kind changes and before each digit; what is between spaces is a piece.
    kinds = _KINDS.take(raw)
    edge = kinds[1:] != kinds[:-1]
    edge |= kinds[1:] == 2
    place = np.arange(len(raw))
    place[1:] += np.cumsum(edge)
    spaced = np.full(int(place[-1]) + 1, ord(" "), np.uint8)
    spaced[place] = raw
    return spaced.tobytes().decode("latin-1").split()


class Encoder:
    """Encodes whole texts; `lower` vocabularies lower-case and drop white space."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.lower = self.tokenizer.normalizer is not None
        # Ids of a chunk by itself, of a chunk after a space, of a word.
        self.whole: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.unknown = 0.0

    def _library(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _model(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters (perhaps after a space), which no rule before the model changes or splits."""
        tokenize, space = self.tokenizer.model.tokenize, chr(_BYTES[ord(" ")])
        written = [
            w.replace(" ", space) if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in words
        ]
        tokens = list(map(tokenize, written))
        ids = np.fromiter(map(_ID, chain.from_iterable(tokens)), "<u4").tobytes()
        ends = [0, *accumulate(4 * len(t) for t in tokens)]
        return [ids[a:b] for a, b in pairwise(ends)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; where a chunk is made of plain words, each word is coded once."""
        plain = [c for c in chunks if _LETTERS.fullmatch(c)]
        ids = dict(zip(plain, self._model(plain), strict=True))
        parts = {}
        for chunk in chunks:
            if chunk not in ids:
                found = _WORDS.findall(chunk)
                parts[chunk] = found if sum(map(len, found)) == len(chunk) else [chunk]
        words = {w: self.words.get(w) for found in parts.values() for w in found}
        missing = [w for w, known in words.items() if known is None]
        letters = [w for w in missing if _LETTERS.fullmatch(w)]
        others = [w for w in missing if not _LETTERS.fullmatch(w)]
        coded = dict(zip(letters + others, self._model(letters) + self._library(others), strict=True))
        words.update(coded)
        self._keep(self.words, coded)
        ids.update((chunk, b"".join([words[w] for w in found])) for chunk, found in parts.items())
        return [ids[c] for c in chunks]

    def _keep(self, cache: dict[str, bytes], coded: dict[str, bytes]) -> None:
        room = CACHE - len(self.whole) - len(self.spaced) - len(self.words)
        cache.update(coded if len(coded) <= room else islice(coded.items(), max(0, room)))

    def _split(self, text: str) -> list[str] | None:
        """Chunks that are coded alike wherever they stand, or None if the text has none."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return None
        if self.lower:
            return _pieces(text.lower())
        return None if _LOOSE_SPACE.search(text) else text.split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self.unknown > UNKNOWN and len(self.whole) + len(self.spaced) + len(self.words) >= CACHE:
            self.whole, self.spaced, self.words = {}, {}, {}
        collect = gc.isenabled()
        gc.disable()  # the cache holds no cycles, and searching it for some takes long
        try:
            return self._ids(texts)
        finally:
            if collect:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        main, space = (self.whole, "") if self.lower else (self.spaced, " ")
        split = [self._split(t) for t in texts]
        odd = [k for k, chunks in enumerate(split) if chunks is None]
        odd_ids = dict(zip(odd, self._library([texts[k] for k in odd]), strict=True))
        coded, gaps = [], []
        new: set[str] = set()
        first: set[str] = set()
        for chunks in split:
            found = list(map(main.get, chunks or ()))
            if chunks and not self.lower:
                found[0] = self.whole.get(chunks[0])
                if found[0] is None:
                    first.add(chunks[0])
            missing = [] if all(found) else [k for k, ids in enumerate(found) if ids is None]
            if missing:
                new.update([chunks[k] for k in missing[found[0] is None and not self.lower :]])
            coded.append(found)
            gaps.append(missing)
        fresh = []
        for words, cache, before in ((list(first), self.whole, ""), (list(new), main, space)):
            fresh.append(dict(zip(words, self._chunks([before + w for w in words]), strict=True)))
            self._keep(cache, fresh[-1])
        out = []
        for n, (chunks, found, missing) in enumerate(zip(split, coded, gaps, strict=True)):
            for k in missing:
                found[k] = fresh[1 if k or self.lower else 0][chunks[k]]
            out.append(odd_ids[n] if chunks is None else b"".join(found))
        self.unknown = sum(map(len, gaps)) / max(1, sum(map(len, coded)))
        return out


def encoder(name: str) -> Encoder:
    """A worker process's encoder, with its cache, until the worker runs another step."""
    return kept(f"encoder {name}", lambda: Encoder(name))
