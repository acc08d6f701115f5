from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sparkqual.llm import ngram_join, substrings
from sparkqual.llm.components import components
from sparkqual.llm.shingles import shingle_sets
from sparkqual.llm.suffix_sort import BlindTrie, sort_equal


def words_of(text, width):
    words = (text or "").encode().lower().split()
    if len(words) >= width:
        return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    return {tuple(words)} if words else set()


def brute_components(rows, width, percent):
    """{doc_id: (set size, component)} of rows with distinct ids."""
    sets = {k: words_of(t, width) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAb \t\n\x0b\x1fé", max_size=14), max_size=6))
def test_shingle_sets(found):
    sets = shingle_sets(found, 2)
    assert [len(s) for s in sets] == [len(words_of(t, 2)) for t in found]
    for a, x in zip(sets, found, strict=True):
        for b, y in zip(sets, found, strict=True):
            assert len(np.intersect1d(a, b)) == len(words_of(x, 2) & words_of(y, 2))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs_of, prose, width, percent):
    base, other = prose(120, 1), prose(200, 2)
    passage = prose(60, 3)
    texts = [None, "", " \t", "one two", "ONE  two", "one two three", base, base.upper(), base]
    texts += [edited(base, k, k % 4) for k in range(25)]  # a group of near copies, some only by chain
    texts += [edited(other, 100 + k, k % 9) for k in range(25)]
    texts += [f"{passage} {prose(30 + k, 40 + k)}" for k in range(12)]  # shared passage, not similar
    texts += [prose(4000, 9), edited(prose(4000, 9), 1, 20), "same " * 300, "same " * 299 + "x"]
    rows = list(enumerate(texts))
    want = brute_components(rows, width, percent)
    docs = docs_of([*rows[::-1], (6, base), (None, base), (None, None)])
    found = ngram_join.ngram_join(docs, width, percent).collect()
    assert len(found) == len(rows) + 3
    for doc, n, component in found:
        if doc is None:
            assert component is None
        else:
            assert (n, component) == want[doc], doc


def brute_links(rows, width, percent):
    """{doc_id: documents linked with it} of rows with distinct ids."""
    sets = {k: words_of(t, width) for k, t in rows}
    alike = lambda a, b: a & b and 100 * len(a & b) >= percent * len(a | b)
    return {k: {i for i, b in sets.items() if i != k and alike(a, b)} for k, a in sets.items()}


@pytest.mark.parametrize("width,percent,block", [(4, 85, 1000), (5, 80, 3)])
def test_all_links(docs_of, prose, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SIDE", block)
    base, other, long = prose(120, 1), prose(200, 2), prose(3000, 3)
    texts = [None, "", "one two", "ONE  two", base, base.upper(), *[edited(base, k, k % 4) for k in range(30)]]
    texts += [edited(other, 100 + k, k % 9) for k in range(30)] + [edited(long, 200 + k, 60) for k in range(5)]
    rows = list(enumerate(texts))
    want = brute_links(rows, width, percent)
    groups = brute_components(rows, width, percent)
    # Pairs in one group that aren't similar, and more links in it than its stars have.
    assert any(0 < len(want[k]) < sum(g[1] == groups[k][1] for g in groups.values()) - 1 for k in want)
    found, members, links = ngram_join.ngram_links(docs_of([*rows, (6, texts[6]), (None, base)]), width, percent)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(rows) + 2 and [r[3] for r in got if r[0] is None] == [None]
    assert {r[0]: r[1:] for r in got if r[0] is not None} == {k: (*groups[k], len(want[k])) for k in want}
    ids = {}
    for c, doc in members.collect():
        ids.setdefault(c, set()).add(doc)
    pairs = {frozenset((a, b)) for c in ids.values() for a in c for b in c if a != b}
    pairs |= {frozenset((a, b)) for q, c in links.collect() for a in ids[q] for b in ids[c]}
    assert pairs == {frozenset((k, i)) for k, linked in want.items() for i in linked}


def test_links_of_ids_with_several_texts(docs_of, prose):
    a, b = prose(50, 1), prose(50, 2)
    found = ngram_join.ngram_links(docs_of([(1, a), (5, a), (5, a), (5, b), (9, b), (11, prose(50, 3))]))[0].collect()
    assert sorted((r[0], r[2], r[3]) for r in found) == [(1, 1, 1), (5, 1, 1), (5, 1, 1), (5, 1, 1), (9, 1, 1), (11, 11, 0)]
    assert ngram_join.ngram_links(docs_of([]))[0].collect() == []


def test_rows_of_one_id_with_different_texts_tie_their_groups(docs_of, prose):
    a, b = prose(50, 1), prose(50, 2)
    found = ngram_join.ngram_join(docs_of([(1, a), (5, a), (5, b), (9, b), (11, prose(50, 3))])).collect()
    assert sorted((r[0], r[2]) for r in found) == [(1, 1), (5, 1), (5, 1), (9, 1), (11, 11)]
    assert ngram_join.ngram_join(docs_of([])).collect() == []


def test_hot_queries_are_spread(docs_of, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "LONG", 70)
    base, long = prose(80, 1), prose(300, 5)
    rows = [(k, edited(base, k, 1)) for k in range(40)] + [(k, edited(long, k, 3 + k % 20)) for k in range(50, 80)]
    found = ngram_join.ngram_join(docs_of(rows)).collect()
    want = brute_components(rows, 4, 85)
    assert {r[0]: (r[1], r[2]) for r in found} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=8), st.sampled_from([50, 80, 85, 100]))
def test_t_occurrence_search(sets, percent):
    query, *candidates = [np.array(sorted(s), np.int64) for s in [*sets, sets[0]]]
    want = [
        k for k, c in enumerate(candidates)
        if 100 * len(np.intersect1d(query, c)) >= percent * len(np.union1d(query, c))
    ]
    assert sorted(ngram_join.similar_to(query, candidates, percent)) == want


@pytest.mark.parametrize("links", [[], [(1, 1)], [(k, k + 1) for k in range(20)], [(0, k) for k in range(1, 30)], [(9, 3), (3, 9), (7, 8), (8, 1)]])
def test_components(spark, links):
    found = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {k: k for pair in links for k in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_deep_shallow_sorting(data):
    parts = data.draw(st.lists(st.sampled_from([b"abab" * 9, b"\x00\xff", b"abac", b"ab" * 20, b"zq"]), min_size=1, max_size=9))
    raw = b"".join(parts)
    length = data.draw(st.sampled_from([1, 3, 8, 13, 24, 25, 40]))
    if len(raw) < length:
        return
    starts = np.array(data.draw(st.lists(st.integers(0, len(raw) - length), max_size=60)), np.int64)
    group = np.array([data.draw(st.integers(0, 1)) for _ in starts], np.int64)
    order, label = sort_equal(np.frombuffer(raw, np.uint8), starts, length, group)
    ranked = [(group[k], raw[starts[k] : starts[k] + length]) for k in order]
    assert sorted(order.tolist()) == list(range(len(starts))) and ranked == sorted(ranked)
    for k in range(1, len(ranked)):
        assert (ranked[k] == ranked[k - 1]) == (label[k] == label[k - 1])


def test_blind_trie():
    strings = [bytes(random.Random(k).choices(b"ab", k=12)) for k in range(200)]
    trie = BlindTrie()
    for k, s in enumerate(strings):
        trie.add(s, k)
    classes = trie.classes()
    assert [strings[c[0]] for c in classes] == sorted(set(strings))
    assert all(len({strings[k] for k in c}) == 1 for c in classes)
    assert BlindTrie().classes() == []


def brute_cut(rows, length):
    """{doc_id: (bytes, removed, spans, kept)} of rows with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(raw[k : k + length])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def cut_cases(prose):
    passage, base = prose(40, 1), prose(150, 2)
    texts = [None, "", "short", "é" * 49, "é" * 50, "é" * 51, "a" * 1000, "ab" * 300, base, base, edited(base, 1, 5)]
    texts += [f"{prose(10, 20 + k)} {passage} {prose(10, 40 + k)}" for k in range(12)]
    texts += [passage, passage + passage, prose(30, 3) + "\n" + passage[:99], passage[5:104], passage[5:105]]
    texts += [base[:300] + "—" + base[300:], prose(5000, 7), "x" + prose(5000, 7), (prose(9, 9) + " ") * 30]
    random.Random(4).shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("way", ["packed", "by row", "by string", "small chunks", "cut texts"])
def test_remove_repeats(docs_of, prose, monkeypatch, way):
    if way == "by row":
        monkeypatch.setattr(substrings, "BUCKET_BYTES", 0)
    if way == "by string":
        monkeypatch.setattr(substrings, "HOT_RUNS", 2)
    if way == "small chunks":
        for name in ("BUCKET_DOCS", "GROUP_RUNS"):
            monkeypatch.setattr(substrings, name, 2)
    if way == "cut texts":
        monkeypatch.setattr(substrings, "CHUNK", 333)
        monkeypatch.setattr(substrings, "SOME", 3)
    rows = cut_cases(prose)
    found = substrings.remove_repeats(docs_of(rows[::-1])).collect()
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in found} == brute_cut(rows, 100)


def test_texts_are_cut_without_loss():
    raw = bytes(range(256)) * 9000
    parts = substrings.overlapping(raw, 100)
    assert max(len(p) for _, p in parts) < substrings.CHUNK + 100
    starts = [at + k for at, p in parts for k in range(len(p) - 99)]
    assert starts == list(range(len(raw) - 99))
    assert all(raw[at : at + len(p)] == p for at, p in parts)


@pytest.mark.parametrize("length", [7, 20, 33])
def test_other_lengths(docs_of, prose, length):
    rows = [(k, t[:200] if t else t) for k, t in cut_cases(prose)]
    found = substrings.remove_repeats(docs_of(rows), length).collect()
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in found} == brute_cut(rows, length)


def test_repeated_and_null_ids(docs_of, prose):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, prose(60, 3)), (None, a), (None, None)]
    found = [(r[0], r[1], r[2], hashlib.sha256(bytes(r[4])).hexdigest()) for r in substrings.remove_repeats(docs_of(rows)).collect()]
    assert len(found) == len(rows)
    assert {r[2] for r in found if r[0] in (1, 3, None)} == {0}
    assert [r[2] for r in found if r[0] == 2] == [len(a)]
    assert substrings.remove_repeats(docs_of([])).collect() == []


def test_phrases_that_recur_by_chance_leave_few_runs_open():
    rng = random.Random(5)
    phrases = ["".join(rng.choices("abcdefghij ", k=24)) for _ in range(1000)]
    texts = ["".join(rng.choices(phrases, k=100)).encode() for _ in range(100)]
    runs = substrings.runs_of(texts, list(range(100)), 100)
    _, rest = substrings.settle(runs)
    _, counts = np.unique(rest["key"], return_counts=True)
    assert counts[counts > 1].sum() < 0.05 * len(runs)


def test_settled_runs():
    rng = np.random.default_rng(3)
    runs = np.zeros(400, substrings._RUN)
    for column, most in (("key", 60), ("print", 3), ("doc", 5), ("start", 9)):
        runs[column] = rng.integers(0, most, 400)
    repeats, rest = substrings.settle(runs)
    first = {}
    for r in runs:
        kind, place = (int(r["key"]), int(r["print"])), (int(r["doc"]), int(r["start"]))
        first[kind] = min(place, first.get(kind, place))
    assert {(int(r["key"]), int(r["print"])): (int(r["doc"]), int(r["start"])) for r in rest} == first and len(rest) == len(first)
    later = sorted(r.item() for r in runs if first[int(r["key"]), int(r["print"])] != (r["doc"], r["start"]))
    assert sorted(r.item() for r in repeats) == later


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-2, 2), st.integers(0, 30), st.integers(1, 9)), max_size=20))
def test_spans(ranges):
    doc, start, size = (np.array([r[k] for r in ranges], np.int64) for k in range(3))
    found = list(zip(*(c.tolist() for c in substrings.spans(doc, start, start + size)), strict=True))
    covered = {(d, k) for d, s, n in ranges for k in range(s, s + n)}
    assert {(d, k) for d, s, e in found for k in range(s, e)} == covered
    assert found == sorted(found) and all(a[0] != b[0] or a[2] < b[1] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("top", [1, 85, 255, 256, 40_000])
def test_runs_are_packed_and_unpacked(top):
    rng = np.random.default_rng(top)
    runs = np.zeros(50, substrings._RUN)
    for column in ("key", "print"):
        runs[column] = rng.integers(0, 2**63, 50)
    runs["doc"], runs["start"] = rng.integers(-(2**63), 2**63 - 1, 50), rng.integers(0, 2**31, 50)
    runs["n"], runs["lead"] = rng.integers(0, top + 1, 50), rng.integers(0, top + 1, 50)
    assert (substrings.load(substrings.dump(runs)) == runs).all()
    assert len(substrings.load(substrings.dump(runs[:0]))) == 0
