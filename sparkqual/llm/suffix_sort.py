"""Deep-shallow sorting of byte strings: multikey quicksort first, blind tries for the rest."""

from __future__ import annotations

import numpy as np

# Bytes compared by the shallow sort: rounds of eight.
ROUND, ROUNDS = 8, 3


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in the same order; past the end they are 0."""
    wide = np.concatenate([data, np.zeros(ROUND, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        wide = (wide[:-shift] << np.uint64(8 * shift)) | wide[shift:]
    return wide[: len(data)]


class BlindTrie:
    """Strings of one length; inner nodes keep only the byte that tells their branches apart.

    A string goes down comparing single bytes, is compared in full with the string at the leaf it
    reaches, and branches off where the two first differ.
    """

    def __init__(self):
        self.root: list | None = None

    def add(self, string: bytes, number: int) -> None:
        if self.root is None:
            self.root = [-1, string, [number]]
            return
        node = self.root
        while node[0] >= 0:
            branches = node[1]
            node = branches.get(string[node[0]]) or next(iter(branches.values()))
        if node[1] == string:
            node[2].append(number)
            return
        size = len(string)
        differ = int.from_bytes(node[1], "big") ^ int.from_bytes(string, "big")
        at = size - (differ.bit_length() + 7) // 8
        above, node, leaf = None, self.root, node
        while 0 <= node[0] < at:
            above, node = node, node[1][string[node[0]]]
        if node[0] == at:
            node[1][string[at]] = [-1, string, [number]]
            return
        inner = [at, {leaf[1][at]: node, string[at]: [-1, string, [number]]}]
        if above is None:
            self.root = inner
        else:
            above[1][string[above[0]]] = inner

    def classes(self) -> list[list[int]]:
        """Numbers of equal strings together, in the order of the strings."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.append(node[2])
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def sort_equal(data: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, label): strings data[start : start + length] in order, equal ones with the same label.

    With `group`, only strings of the same group are compared; groups come in ascending order.
    Strings must lie in the data.
    """
    n = len(starts)
    order = np.arange(n) if group is None else np.argsort(group, kind="stable")
    bounds = np.zeros(n, bool)
    if n:
        bounds[0] = True
    if group is not None and n:
        bounds[1:] = group[order][1:] != group[order][:-1]
    words = words_at(data)
    depth = 0
    while depth < min(ROUND * ROUNDS, length):
        # Only parts with several strings are split further.
        part = np.cumsum(bounds) - 1
        sizes = np.bincount(part) if n else np.zeros(0, np.int64)
        open_ = np.flatnonzero(sizes[part] > 1) if n else np.zeros(0, np.int64)
        if not len(open_):
            return order, np.cumsum(bounds) - 1
        key = _word(words, starts[order[open_]], length, depth)
        inner = np.lexsort((key, part[open_]))
        order[open_] = order[open_][inner]
        key, own = key[inner], part[open_]
        bounds[open_[1:]] |= (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        depth += ROUND
    if depth < length:
        _pairs(words, starts, length, depth, order, bounds)
        _deep(data.tobytes(), starts, length, depth, order, bounds)
    return order, np.cumsum(bounds) - 1


def _word(words: np.ndarray, starts: np.ndarray, length: int, depth: int) -> np.ndarray:
    """Eight bytes of each string from `depth` on, fewer at its end."""
    key = words[starts + depth]
    return key >> np.uint64(8 * (ROUND - length + depth)) if length - depth < ROUND else key


def _pairs(words: np.ndarray, starts: np.ndarray, length: int, depth: int, order: np.ndarray, bounds: np.ndarray) -> None:
    """Order the parts of two strings that agree to `depth`, all of them at once."""
    heads = np.flatnonzero(bounds)
    left = heads[np.diff(heads, append=len(bounds)) == 2]
    while depth < length and len(left):
        x, y = (_word(words, starts[order[left + k]], length, depth) for k in (0, 1))
        bounds[left[x != y] + 1] = True
        swapped = left[y < x]
        order[swapped], order[swapped + 1] = order[swapped + 1], order[swapped]
        left = left[x == y]
        depth += ROUND


def _deep(raw: bytes, starts: np.ndarray, length: int, depth: int, order: np.ndarray, bounds: np.ndarray) -> None:
    """Order the parts of more strings that agree to `depth`, each by a blind trie."""
    heads = np.flatnonzero(bounds)
    sizes = np.diff(heads, append=len(bounds))
    heads, sizes = heads[sizes > 2], sizes[sizes > 2]
    for a, b in zip(heads.tolist(), (heads + sizes).tolist(), strict=True):
        members = order[a:b].tolist()
        places = starts[order[a:b]].tolist()
        trie = BlindTrie()
        for member, place in zip(members, places, strict=True):
            trie.add(raw[place + depth : place + length], member)
        at = a
        for same in trie.classes():
            bounds[at] = True
            order[at : at + len(same)] = same
            at += len(same)
