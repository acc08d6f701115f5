"""Token ids in blocks, each coded by an adaptive context-mixing range coder.

A block starts from an empty model and has its own checksum, so it is read alone. Its ids are
numbered in the order they first occur; the numbers are coded. Two models predict the next
number: the one that last followed the two numbers before (order 2), and the one that last
followed the number before (order 1). Each keeps counts of how the next id was found - by order
2, by order 1, among the ids seen (order 0), or new - for each run of successes it has had; the
two sets of counts are mixed with a weight that follows the better one. Where neither prediction
holds, order-0 counts of the ids seen drive the coder; new ids stand before the code as they are.

All blocks of a call take each step together, as arrays; one block's code doesn't depend on others.
To take few steps in numpy, counts stand in fields of one integer: a multiplication sums them up,
and a subtraction compares all of them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Tokens of a block (fields below have room for so many); blocks coded together.
BLOCK, LANES = 1024, 2048
# Order-2 contexts are hashed to so many slots; successes in a row are counted up to LEVELS - 1.
SLOTS, LEVELS = 1024, 8
_MAGIC = b"TIDC\x03"
# The whole range, what counts as little, and a word.
_WHOLE, _SHORT, _WORD = float(1 << 48), float(1 << 32), float(1 << 16)
# Four fields of 16 bits: ones, and their highest bits.
_ONES, _GUARDS, _FIRST_GUARDS = 0x0001000100010001, -0x7FFF7FFF7FFF8000, 0x0000800080008000


def _pack(*counts: int) -> int:
    return sum(c << 16 * k for k, c in enumerate(counts))


_MORE = np.array([1 << 16 * k for k in range(4)], np.int64)
# Order-0 counts form a tree of four levels. A node has the sums of the counts of its first 1 to 5 of 6
# children (at the lowest level, of 5 numbers) in fields of 12 bits, of which the highest stays free.
_RADIX, _LEVEL, _NODES = (6, 6, 6, 5), (0, 1, 7, 43), 259
_FIELDS, _FIELD_GUARDS = sum(1 << 12 * k for k in range(5)), sum(1 << 12 * k + 11 for k in range(5))
# By a child's place: where the sum of those before it stands, and what one count more adds to the node.
_UNDER = np.array([63, 0, 12, 24, 36, 48])
_ADDS = np.array([sum(1 << 12 * k for k in range(d, 5)) for d in range(6)], np.int64)
# By number: node and child on each level, highest first.
_SPAN = np.array([[180], [30], [5], [1]])
_CHILD = np.arange(1080) // _SPAN % np.array(_RADIX)[:, None]
_NODE = np.arange(1080) // (_SPAN * np.array(_RADIX)[:, None]) + np.array(_LEVEL)[:, None]
_SHIFT, _STEP, _FIELD = _UNDER[_CHILD], _ADDS[_CHILD], 12 * _CHILD[3]


class _Writer:
    """Range encoder of each lane: intervals of 48 bits, written in words of 16; floats hold them exactly."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, _WHOLE)
        # Word by word, a column for each lane; a word may hold a carry until the end.
        self.words, self.n = np.zeros((2 * steps + 8, lanes), np.uint32), np.zeros(lanes, np.int64)

    def interval(self, lanes: np.ndarray | slice, below: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        self.low[lanes] += below * unit
        self.range[lanes] = width * unit

    def settle(self, n: int) -> None:
        """Move out a word wherever little range is left."""
        while len(move := np.flatnonzero(self.range[:n] < _SHORT)):
            low, at = self.low[move], self.n[move]
            word = np.floor(low * (1 / _SHORT))
            self.words[at, move] = word
            self.low[move] = (low - word * _SHORT) * _WORD
            self.range[move] *= _WORD
            self.n[move] = at + 1

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.n))
        for _ in range(3):
            word = np.floor(self.low * (1 / _SHORT))
            self.words[self.n, lanes] = word
            self.low = (self.low - word * _SHORT) * _WORD
            self.n += 1
        words = self.words[: int(self.n.max(initial=0))]
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> 16
        words = np.ascontiguousarray(words.T.astype("<u2"))
        return [w[:n].tobytes() for w, n in zip(words, self.n.tolist(), strict=True)]


class _Reader:
    """Range decoder of each lane; `low` is the code's place in its interval."""

    def __init__(self, payloads: list[np.ndarray]):
        lanes = len(payloads)
        words = np.zeros((lanes, max([len(p) for p in payloads], default=0) + 8), np.uint16)
        for k, p in enumerate(payloads):
            words[k, : len(p)] = p
        self.words = np.ascontiguousarray(words.T)
        self.low = self.words[0] * _SHORT + self.words[1] * _WORD + self.words[2]
        self.range, self.n = np.full(lanes, _WHOLE), np.full(lanes, 3, np.int64)

    def target(self, lanes: np.ndarray | slice, total: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Where each code lies in its interval; a code outside it, or an empty interval, is damage."""
        at = self.low[lanes] / unit
        if not np.all(at < total):
            raise ValueError("a block is damaged")
        return at.astype(np.int64)

    def interval(self, lanes: np.ndarray | slice, below: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        self.low[lanes] -= below * unit
        self.range[lanes] = width * unit

    def settle(self, n: int) -> None:
        while len(move := np.flatnonzero(self.range[:n] < _SHORT)):
            at = self.n[move]
            self.low[move] = self.low[move] * _WORD + self.words[np.minimum(at, len(self.words) - 1), move]
            self.range[move] *= _WORD
            self.n[move] = at + 1


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, new) of each id in its row: ids are numbered in the order they first occur."""
    numbers, new = np.empty(ids.shape, np.int16), np.empty(ids.shape, bool)
    steps = np.arange(ids.shape[1])
    for k in range(0, len(ids), 64):  # some rows at a time stay near the processor
        some = ids[k : k + 64]
        order = np.argsort(some, axis=1, kind="stable")
        ranked = np.take_along_axis(some, order, axis=1)
        head = np.ones(some.shape, bool)
        head[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        first = np.empty(some.shape, np.int64)
        place = np.maximum.accumulate(np.where(head, steps, 0), axis=1)
        np.put_along_axis(first, order, np.take_along_axis(order, place, axis=1), axis=1)
        new[k : k + 64] = first == steps
        seen = np.cumsum(new[k : k + 64], axis=1, dtype=np.int16) - np.int16(1)
        numbers[k : k + 64] = np.take_along_axis(seen, first, axis=1)
    return numbers, new


def _run(coder: _Writer | _Reader, lengths: np.ndarray, numbers: np.ndarray, new: np.ndarray | None) -> np.ndarray:
    """Code the numbers of all lanes, longest first, a row for each step; the ids each lane has seen.

    To read, `new` is None and `numbers` is filled.
    """
    lanes, steps = len(lengths), int(lengths.max(initial=0))
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    every = np.arange(lanes)
    at2, at1, at_level, at_tree = every * SLOTS, every * BLOCK, every * LEVELS, every * _NODES
    # What followed a context, and how often in a row: 8 * number + level.
    next2, next1 = np.zeros(lanes * SLOTS, np.int16), np.zeros(lanes * BLOCK, np.int16)
    # Counts of the four outcomes, 16 bits each.
    found2, found1 = np.full(lanes * LEVELS, _pack(8, 2, 4, 2)), np.full(lanes * LEVELS, _pack(2, 8, 4, 2))
    found2[::LEVELS], found1[::LEVELS] = _pack(1, 2, 4, 4), _pack(2, 1, 4, 4)
    weight = np.full(lanes, 8, np.int64)
    tree, used, tally = np.zeros(lanes * _NODES, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t, n in enumerate(active.tolist()):
        one = at1[:n] + last[:n]
        two = at2[:n] + ((last[:n] * 0x9E3779B1 + before[:n] * 0x85EBCA77 >> 22) & (SLOTS - 1))
        state2, state1 = next2.take(two).astype(np.int64), next1.take(one).astype(np.int64)
        guess2, level2, guess1, level1 = state2 >> 3, state2 & 7, state1 >> 3, state1 & 7
        from2, from1 = at_level[:n] + level2, at_level[:n] + level1
        by2, by1 = found2.take(from2), found1.take(from1)
        w = weight[:n]
        mixed = by2 * w + by1 * (16 - w)
        sums = mixed * _ONES
        total = sums >> 48
        unit = np.floor(coder.range[:n] / total)
        if new is None:
            at = coder.target(slice(n), total, unit)
            kind = np.bitwise_count((at * _ONES + _GUARDS - sums) & _FIRST_GUARDS).astype(np.int64)
        else:
            number = numbers[t, :n].astype(np.int64)
            kind = 2 + new[t, :n].astype(np.int64)
            kind[(guess1 == number) & (level1 > 0)] = 1
            kind[(guess2 == number) & (level2 > 0)] = 0
        shift = kind << 4
        width = (mixed >> shift) & 0xFFFF
        coder.interval(slice(n), ((sums >> shift) & 0xFFFF) - width, width, unit)
        seen, rest = np.flatnonzero(kind == 2), np.flatnonzero(kind > 1)
        if new is None:
            number = np.where(kind == 0, guess2, np.where(kind == 1, guess1, used[:n]))
        if len(seen):
            counted = tally[seen]
            unit = np.floor(coder.range[seen] / counted)
            if new is None:
                number[seen], below, count = _find(tree, at_tree[seen], coder.target(seen, counted, unit))
            else:
                below, count = _place(tree, at_tree[seen], number[seen])
            coder.interval(seen, below, count, unit)
        if new is None:
            numbers[t, :n] = number
        if len(rest):
            own = number[rest]
            node = _NODE.take(own, axis=1) + at_tree[rest]
            tree[node] = tree.take(node) + _STEP.take(own, axis=1)
            tally[rest] += 1
            used[:n] += kind == 3
        coder.settle(n)
        # The model that gave the outcome more of its counts gains weight.
        share2 = (by2 >> shift & 0xFFFF) * (by1 * _ONES >> 48)
        share1 = (by1 >> shift & 0xFFFF) * (by2 * _ONES >> 48)
        weight[:n] = np.minimum(np.maximum(w + np.sign(share2 - share1), 1), 15)
        more = _MORE.take(kind)
        found2[from2], found1[from1] = by2 + more, by1 + more
        base = number << 3
        next2[two] = np.where(guess2 == number, np.minimum(state2 + 1, base + 7), base + 1).astype(np.int16)
        next1[one] = np.where(guess1 == number, np.minimum(state1 + 1, base + 7), base + 1).astype(np.int16)
        before[:n], last[:n] = last[:n], number
    return used


def _place(tree: np.ndarray, lanes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of all numbers below, own count) of a number in each lane's tree."""
    held = tree.take(_NODE.take(number, axis=1) + lanes)
    under = (held >> _SHIFT.take(number, axis=1)) & 0x7FF
    to = (held[3] >> _FIELD.take(number)) & 0x7FF
    return under.sum(axis=0), to - under[3]


def _find(tree: np.ndarray, lanes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, counts of all numbers below, own count) of the number that holds count `at` of each lane's tree."""
    left, number = at, np.zeros(len(at), np.int64)
    for level in range(4):
        held = tree.take(lanes + _LEVEL[level] + number)
        digit = np.bitwise_count((left * _FIELDS + _FIELD_GUARDS - held) & _FIELD_GUARDS).astype(np.int64)
        under = (held >> _UNDER.take(digit)) & 0x7FF
        left = left - under
        number = number * _RADIX[level] + digit
    return number, at - left, ((held >> 12 * digit) & 0x7FF) - under


def encode(ids: np.ndarray) -> bytes:
    """A stream of unsigned 32-bit ids as one segment of blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    lengths = np.full(blocks, BLOCK, np.int64)
    if n % BLOCK:
        lengths[-1] = n % BLOCK
    bits = max(1, int(ids.max(initial=0)).bit_length())
    size = -(-bits // 8)
    payloads: list[bytes] = []
    for k in range(0, blocks, LANES):
        some = ids[k * BLOCK : (k + LANES) * BLOCK]
        lanes = -(-len(some) // BLOCK)
        # Ids of two bytes are sorted faster.
        square = np.zeros(lanes * BLOCK, np.uint16 if bits <= 16 else np.uint32)
        square[: len(some)] = some
        square = square.reshape(lanes, BLOCK)
        numbers, new = _numbered(square)
        new &= np.arange(BLOCK) < lengths[k : k + lanes, None]
        coder = _Writer(lanes, BLOCK)
        used = _run(coder, lengths[k : k + lanes], np.ascontiguousarray(numbers.T), np.ascontiguousarray(new.T))
        fresh = square[new].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]
        ends = np.cumsum(used)
        for code, m, e in zip(coder.finish(), used.tolist(), ends.tolist(), strict=True):
            payloads.append(struct.pack("<H", m) + fresh[e - m : e].tobytes() + code)
    # A block's checksums are those of its ids and of its code.
    raw = memoryview(ids.astype("<u4").tobytes())
    sums = [zlib.crc32(raw[4 * k * BLOCK : 4 * (k + 1) * BLOCK]) for k in range(blocks)]
    codes = [zlib.crc32(p) for p in payloads]
    head = struct.pack("<BI", bits, blocks)
    rows = [(m, len(p), c, d) for m, p, c, d in zip(lengths.tolist(), payloads, sums, codes, strict=True)]
    head += np.array(rows, "<u4").tobytes()
    return b"".join([_MAGIC, struct.pack("<I", zlib.crc32(head)), head, *payloads])


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; every checksum must hold."""
    if data[:5] != _MAGIC or len(data) < 14:
        raise ValueError("not a segment of token ids")
    check, bits, blocks = struct.unpack_from("<IBI", data, 5)
    begin = 14 + 16 * blocks
    if len(data) < begin or zlib.crc32(data[9:begin]) != check:
        raise ValueError("the segment's table of blocks is damaged")
    table = np.frombuffer(data, "<u4", 4 * blocks, 14).reshape(blocks, 4).astype(np.int64)
    lengths, ends = table[:, 0], begin + np.cumsum(table[:, 1])
    if len(data) != (int(ends[-1]) if blocks else begin):
        raise ValueError("the segment's length is wrong")
    payloads = [data[e - s : e] for s, e in zip(table[:, 1].tolist(), ends.tolist(), strict=True)]
    for k, (payload, row) in enumerate(zip(payloads, table.tolist(), strict=True)):
        if zlib.crc32(payload) != row[3]:
            raise ValueError(f"block {k} is damaged")
    out = np.zeros((blocks, BLOCK), "<u4")
    for k in range(0, blocks, LANES):
        out[k : k + LANES] = _decoded(payloads[k : k + LANES], lengths[k : k + LANES], -(-bits // 8))
    raw = memoryview(out).cast("B") if blocks else b""
    for k, (length, _, crc, _) in enumerate(table.tolist()):
        if zlib.crc32(raw[4 * k * BLOCK : 4 * (k * BLOCK + length)]) != crc:
            raise ValueError(f"block {k} is damaged")
    return out.reshape(-1)[: int(lengths.sum())]


def _decoded(payloads: list[bytes], lengths: np.ndarray, size: int) -> np.ndarray:
    """The ids of blocks whose new ids have `size` bytes."""
    count = np.array([struct.unpack_from("<H", p)[0] if len(p) > 1 else BLOCK + 1 for p in payloads], np.int64)
    begin = 2 + size * count
    if np.any(count > BLOCK) or any(len(p) < b or (len(p) - b) % 2 for p, b in zip(payloads, begin.tolist(), strict=True)):
        raise ValueError("a block is damaged")
    fresh = b"".join([p[2:b] for p, b in zip(payloads, begin.tolist(), strict=True)])
    whole = np.zeros((int(count.sum()), 4), np.uint8)
    whole[:, :size] = np.frombuffer(fresh, np.uint8).reshape(-1, size)
    table = np.zeros((len(payloads), BLOCK), "<u4")
    table[np.arange(BLOCK) < count[:, None]] = whole.reshape(-1).view("<u4")
    numbers = np.zeros((BLOCK, len(payloads)), np.int16)
    coder = _Reader([np.frombuffer(p, "<u2", offset=b) for p, b in zip(payloads, begin.tolist(), strict=True)])
    with np.errstate(divide="ignore", invalid="ignore"):  # damage is told from the quotient
        used = _run(coder, lengths, numbers, None)
    if np.any(used != count):
        raise ValueError("a block is damaged")
    for k in range(0, len(table), 64):
        table[k : k + 64] = np.take_along_axis(table[k : k + 64], numbers[:, k : k + 64].T.astype(np.int64), axis=1)
    return table
