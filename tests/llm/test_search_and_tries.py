"""The conversation trie, lexical search and passage removal against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkqual.llm import lexical_search, passages, prefix_trie
from sparkqual.llm.fm_index import FMIndex, repeated_windows, suffix_order

TURNS = "conv_id long, turn long, role string, text string, conv long, depth long, k1 long, n string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        rebuilt[c] = convs.get(base, [])[:h] + own[h:]
    members, kids = defaultdict(list), Counter()
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not kids[node]
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversation_rows():
    rng = random.Random(1)
    rows = []
    for c in [*range(60), -7, -5, -3, 2**62, -(2**63)]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "ü", None, "bb"])))
    # A deep conversation, and those of its family that share its first turns.
    for c in (500, 501, 502, 503, 504):
        rows += [(c, t, "user", f"turn {t}" if t < 90 or c % 2 else f"other {t}") for t in range(130)]
    rows += [(70, None, "user", "first"), (70, None, "assistant", "second"), (70, 1, "user", "x"), (70, 1, "user", "x")]
    rows += [(None, 1, "user", "no conversation"), (90, 1, "user", "long " * 50_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [2, 4, 32])
def test_trie_matches_brute_force(spark, band):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 1, 1, "n") for r in rows], TURNS)
    found = prefix_trie.conversation_trie(df, band)
    assert found.columns == TRIE
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == trie_of(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = spark.createDataFrame([(3, None, None, None, 1, 1, 1, "n")], TURNS)
    assert sorted(map(tuple, prefix_trie.conversation_trie(one).collect()), key=lambda r: r[:2]) == trie_of([(3, None, None, None)])


def test_end_checksums_join_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    ends = spark.createDataFrame([(k, k, c) for k in (1, 2) for c in range(-300, 900)], "k1 long, k2 long, conv long")
    want = hashlib.sha256(",".join(map(str, range(-300, 900))).encode()).hexdigest()
    assert sorted(map(tuple, prefix_trie.end_checksums(ends).collect())) == [(1, 1, want), (2, 2, want)]


def test_totals_explode_within_bands(spark):
    """The rows that a level explodes to are at most a band for each node."""
    nodes = spark.createDataFrame([(1, d, 1) for d in range(1000)], "conv long, depth long, v long")
    paths = spark.createDataFrame([(1, d, d, d) for d in range(1000)], "conv long, depth long, k1 long, k2 long")
    found = prefix_trie.subtree_totals(nodes, paths, ["v"], 8)
    assert {(r.k1, r.v) for r in found.collect()} == {(d, 1000 - d) for d in range(1000)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(docs, items, k):
    terms = [(d, Counter(folded(t))) for d, t in docs]
    number = sum(1 for _, c in terms if c)
    length = sum(c.total() for _, c in terms)
    has = Counter(t for _, c in terms for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(folded(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for d, c in terms:
            score = 0
            for t in words & c.keys():
                w = math.floor(1000 * math.log((2 * number + 2) / (2 * has[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * number // length)))
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        for rank, (score, known, d) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, d if known else None, -score))
    return sorted(out, key=str)


def search_tables(prose):
    rng = random.Random(3)
    docs = [(i, prose(rng.randint(1, 120), i, 900)) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(300, 330)]  # ties
    docs += [(400, "Moron " * 700), (401, "moron"), (402, None), (403, ""), (404, "... ,;"), (None, prose(40, 5, 900))]
    docs += [(405, "Äpfel äpfel İx3 a_b"), (7, docs[7][1]), (7, "again " + prose(30, 9, 900)), (406, prose(400_000, 11, 900))]
    items = [(i, prose(rng.randint(1, 30), 1000 + i, 900)) for i in range(25)]
    items += [(50, docs[7][1]), (51, "moron äpfel İx3 b"), (52, None), (53, "unheard-of qqqq"), (None, "moron again"), (51, "a")]
    return docs, items


ITEM = "item_id long, text string, query int, mark long"


@pytest.mark.parametrize("batch,rounds", [(512 << 10, (32, 1024)), (600, (1, 3))])
def test_search_matches_brute_force(spark, docs_of, prose, monkeypatch, batch, rounds):
    monkeypatch.setattr(lexical_search, "BATCH_BYTES", batch)
    monkeypatch.setattr(lexical_search, "ROUNDS", rounds)
    monkeypatch.setattr(lexical_search, "SLOTS", 50)
    docs, items = search_tables(prose)
    found = lexical_search.search(docs_of(docs), spark.createDataFrame([(*i, 1, 1) for i in items], ITEM), 10)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == ranked(docs, items, 10)


def test_search_of_nothing(spark, docs_of):
    items = spark.createDataFrame([(1, "word", 1, 1)], ITEM)
    assert lexical_search.search(docs_of([]), items).count() == 0
    assert lexical_search.search(docs_of([(1, None), (2, "")]), items).count() == 0
    assert lexical_search.search(docs_of([(1, "word")]), items.limit(0)).count() == 0
    # One document holds the term, yet its weight is not 0.
    assert [tuple(r) for r in lexical_search.search(docs_of([(1, "word")]), items).collect()] == ranked([(1, "word")], [(1, "word")], 10)


def test_bounds_are_never_below_scores(prose):
    docs = [lexical_search.term_counts(prose(n, n, 3000).encode()) for n in (5, 50, 500, 5000)]
    queries = lexical_search.Queries([prose(30, 100 + i, 3000).encode() for i in range(20)])
    queries.weigh(4, {i: 1 + i % 4 for i in range(len(queries.terms))})
    size = np.array([50, 100, 200, 800])
    bounds = queries.bounds(lexical_search.impacts(lexical_search.sketches(docs), size))
    for d, counts in enumerate(docs):
        some = {queries.terms[t]: n for t, n in counts.items() if t in queries.terms}
        exact = [queries.score(some, int(size[d]), q) for q in range(queries.count)]
        assert (bounds[:, d] >= exact).all()
    # A sketch is tight for a document with few terms.
    assert bounds[:, 0].sum() < bounds[:, 2].sum()


def test_terms_of_long_texts_are_split(monkeypatch, prose):
    text = (prose(3000, 1) + ";A-B " * 500).encode()
    whole = lexical_search.term_counts(text)
    monkeypatch.setattr(lexical_search, "PIECE", 100)
    assert lexical_search.term_counts(text) == whole == Counter(t.encode() for t in folded(text.decode()))


def test_index_finds_repeated_windows():
    for seed in range(60):
        rng = random.Random(seed)
        width, symbols = rng.choice([3, 5, 35]), rng.choice([2, 3, 50, 1000])
        base = [rng.randint(1, symbols) for _ in range(200)]
        made = []
        for _ in range(rng.randint(1, 30)):
            n = max(1, width + rng.randint(-2, 27))
            at = rng.randint(0, 200 - n)
            some = base[at : at + n] if rng.random() < 0.6 else [rng.randint(1, symbols) for _ in range(n)]
            if rng.random() < 0.5:
                some = [*some[: n // 2], rng.randint(1, symbols), *some[n // 2 + 1 :]]
            made.append(tuple(some))
        copies = Counter(made)
        segments = list(copies)
        windows = Counter()
        for s in segments:
            for i in range(len(s) - width + 1):
                windows[s[i : i + width]] += copies[s]
        index = FMIndex([np.array(s) for s in segments], np.array([copies[s] for s in segments]), 64)
        mask = repeated_windows(index, np.array([len(s) for s in segments]), width)
        want = [sum(1 << i for i in range(len(s) - width + 1) if windows[s[i : i + width]] > 1) for s in segments]
        assert mask.tolist() == want


def test_index_counts_occurrences():
    rng = np.random.default_rng(0)
    segments = [rng.integers(1, 4, 40) for _ in range(30)]
    index = FMIndex(segments, np.ones(30, int), 64)
    for length in (1, 2, 5, 20):
        pattern = segments[3][4 : 4 + length]
        low, high = np.zeros(1, int), np.array([len(index.text)])
        number = index.text[index.begin[3] + 4 : index.begin[3] + 4 + length]
        for symbol in number[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        want = sum((s[i : i + length] == pattern).all() for s in segments for i in range(40 - length + 1))
        assert high[0] - low[0] == want
    text = rng.integers(0, 3, 300)
    order = suffix_order(text, 16)
    keys = [tuple(text[i : i + 16]) for i in order]
    assert keys == sorted(keys)


def without_passages(rows, window=35):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(b" ".join(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), words in zip(rows, texts, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[b" ".join(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), kept))
    return sorted(out, key=str)


def passage_rows(prose):
    shared = prose(60, 77)
    rows = [(i, prose(100 + i, i)) for i in range(40)]
    rows += [(100 + i, f"{prose(5 + i % 40, 200 + i)} {shared} {prose(i % 50, 300 + i)}") for i in range(60)]
    rows += [(200 + i, prose(50, 400)) for i in range(8)]  # copies
    rows += [(300, "a " * 200), (301, "b " * 35), (302, "b " * 36), (303, "a b " * 60), (304, prose(34, 500)), (305, prose(34, 500))]
    rows += [(306, prose(35, 501)), (307, prose(35, 501).replace(" ", "\n\t ")), (308, prose(35, 501).upper())]
    rows += [(309, None), (310, ""), (311, " \t\n"), (None, prose(80, 502)), (None, prose(80, 502)), (312, " ".join(["x"] * 90))]
    rows += [(313, prose(90, 503)), (313, prose(90, 503)), (313, prose(90, 504)), (314, prose(20_000, 505) + " " + shared)]
    return rows


@pytest.mark.parametrize("frequent,chunk,held", [(2000, 1 << 20, 8 << 20), (3, 300, 2000), (10, 5000, 1)])
def test_passages_match_brute_force(docs_of, prose, monkeypatch, frequent, chunk, held):
    for name, value in (("FREQUENT_RUNS", frequent), ("CHUNK", chunk), ("HELD", held), ("SEGMENTS", held)):
        monkeypatch.setattr(passages, name, value)
    rows = passage_rows(prose)
    found = passages.remove_passages(docs_of(rows))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept"]
    got = sorted(((r[0], r[1], r[2], bytes(r[3])) for r in found.collect()), key=str)
    assert got == without_passages(rows)


def test_passages_of_nothing(docs_of):
    assert passages.remove_passages(docs_of([])).count() == 0
    assert [tuple(r)[:3] for r in passages.remove_passages(docs_of([(1, None)])).collect()] == [(1, 0, 0)]
