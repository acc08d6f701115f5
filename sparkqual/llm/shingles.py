"""Sets of hashed word shingles, computed for many texts at a time."""

from __future__ import annotations

import numpy as np

# Odd multipliers with well-mixed bits.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _bytes_table() -> np.ndarray:
    """A 64-bit value for each byte; A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _bytes_table()
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text). Words are runs without space or \\t to \\r; A-Z count as a-z."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, len(inside)))
    place = np.arange(len(inside)) - np.repeat(heads, lengths)
    terms = _BYTES[data[inside]] * _powers_to(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(terms, heads) + lengths.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    words = np.searchsorted(inside[heads], ends)
    return hashes, np.diff(np.concatenate([[0], words]))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words, sorted.

    A text with fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    words, counts = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: n - k] = rolled[: n - k] * _MIX + words[k:]
    rolled = mix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            short = np.zeros(1, np.uint64)
            for w in words[at : at + count]:
                short = short * _MIX + w
            out.append(mix(short + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
