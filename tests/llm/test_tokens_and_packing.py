from __future__ import annotations

import time
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparkqual.llm import language, ngram_join, packing, range_coder, secrets, token_files, tokens
from sparkqual.llm.tokens import Encoder

ODD = [
    "", " ", "  a", "a  b", "a \n b", "don't we'll 'tis x's", "\n\nfoo\n", "<|endoftext|> a", "ABC's  ²", "½ cup",
    "x y", "éé", "A.B,,c 12ab!? '' 's", "a\r\nb\tc \td", " \n", "ŉ İ ı K ſ ǅ", "日本 語", "Ωmega ς", "\x00a\x1fb", "\x0b a", "a" * 5000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_library(name, prose):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    mine = Encoder(name)
    found = ODD + [prose(300, k) + ".\nÉté, d'où?" for k in range(5)]
    for _ in range(2):  # the second time from the cache
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in found]
        assert mine.ids(found) == want


_encoders: dict[str, Encoder] = {}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aB'é s\n\t.,7! ñ-_<|>")), max_size=25))
def test_cached_ids_of_any_mix(name, text):
    mine = _encoders.setdefault(name, Encoder(name))
    want = mine.tokenizer.encode(text, add_special_tokens=False).ids
    assert mine.ids([text]) == [np.array(want, "<u4").tobytes()]


def check_packed(rows, length):
    """Offsets without gaps, every id once, padding only up to a power of two; gives ids by document."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
        assert at == length or at & (at - 1) == 0
        assert at <= length
    out = {}
    for doc, pieces in documents.items():
        pieces.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces[:-1]]))
        assert all(r["doc_tokens"] == len(ids) // 4 for r in pieces)
        out[doc] = ids
    return out


def test_pack(docs_of, prose):
    texts = [None, "", *ODD, *[prose(n, n) for n in (5, 50, 700, 701, 702, 6000)]]
    docs = docs_of([(k, t) for k, t in enumerate(texts)] + [(None, "no id")])
    found = check_packed([r.asDict() for r in packing.pack(docs, length=64).collect()], 64)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert found[k] == want
    assert None in found
    assert packing.pack(docs.filter("false")).count() == 0


def test_pack_repeated_rows(docs_of, prose):
    docs = docs_of([(1, prose(30, 1))] * 3).coalesce(1)
    rows = packing.pack(docs, length=64).collect()
    assert sum(r["length"] for r in rows) == 3 * rows[0]["doc_tokens"]


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    for _ in range(200):
        packer = packing.Packer(16, 0)
        packer.levels[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def after(h, levels=packer.levels, size=size):
            n = levels[1:16].copy()
            if h:
                n[h - 1] -= 1
            if h + size < 16:
                n[h + size - 1] += 1
            return int((n**2).sum())

        allowed = [h for h in range(16 - size + 1) if h == 0 or packer.levels[h]]
        assert after(packer.level_for(size)) == min(map(after, allowed))


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_open_sequences_are_bounded(limit):
    packer = packing.Packer(16, 100, limit)
    for k in range(200):
        packer.add(k, bytes(4 * (9 + k % 5)))
        assert packer.levels.sum() <= limit
    packer.finish()
    rows = [
        dict(zip(("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"), r, strict=True))
        for r in packer.take()
    ]
    assert len(check_packed(rows, 16)) == 200


@settings(max_examples=40, deadline=None)
@given(
    st.one_of(
        st.lists(st.integers(0, 2**32 - 1), max_size=300),
        st.lists(st.integers(0, 3), max_size=3000),
        st.lists(st.sampled_from([7, 7, 7, 49407, 2**32 - 1, 0]), max_size=2500),
    )
)
def test_range_coder_round_trip(ids):
    ids = np.array(ids, "<u4")
    assert np.array_equal(range_coder.decode(range_coder.encode(ids)), ids)


def test_range_coder_learns_and_checks():
    ids = np.tile(np.arange(50, dtype="<u4"), 400)
    data = range_coder.encode(ids)
    assert len(data) < len(ids) / 4
    for at in (3, 11, 20, len(data) // 2):
        broken = bytearray(data)
        broken[at] ^= 0x41
        with pytest.raises(ValueError):
            range_coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        token_files.read_segment(token_files.segment([(1, b"\0\0\0\0")])[:-1] + b"x")


def test_blocks_are_independent():
    a, b = (np.random.default_rng(k).integers(0, 60, 1024).astype("<u4") for k in (1, 2))
    alone, both = range_coder.encode(b), range_coder.encode(np.concatenate([a, b]))
    assert alone[14 + 16 :] == both[-len(alone[14 + 16 :]) :]


def every_change(data, read):
    """Every byte changed in two ways, and every end cut off, is told as damage."""
    for at in range(len(data)):
        for flip in (0x01, 0xFF):
            broken = bytearray(data)
            broken[at] ^= flip
            with pytest.raises(ValueError):
                read(bytes(broken))
        with pytest.raises(ValueError):
            read(data[:at])


def test_no_damage_goes_unseen():
    every_change(token_files.segment([(1, b"\0\0\0\0")]), token_files.read_segment)
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 120):
        every_change(range_coder.encode(rng.integers(0, 9, n).astype("<u4")), range_coder.decode)
    data = token_files.segment([(None, b"\7\0\0\0" * 1100), (-(1 << 63), b"\1\0\0\0" * 1000)])
    for at in range(0, len(data), 7):
        broken = bytearray(data)
        broken[at] ^= 0x10
        with pytest.raises(ValueError):
            token_files.read_segment(bytes(broken))


def test_damaged_code_ends(monkeypatch):
    """Also without checksums of the code, the decoder ends: with an error, or with ids whose checksum fails."""
    monkeypatch.setattr(range_coder.zlib, "crc32", lambda *_: 0)
    rng = np.random.default_rng(6)
    for n in (1, 2, 40, 1500):
        ids = rng.integers(0, 9, n).astype("<u4")
        data = range_coder.encode(ids)
        begin = 14 + 16 * -(-n // range_coder.BLOCK)
        for at in range(begin, len(data), max(1, n // 40)):
            for flip in (0x01, 0x80, 0xFF):
                broken = bytearray(data)
                broken[at] ^= flip
                try:
                    range_coder.decode(bytes(broken))
                except ValueError:
                    pass


def test_least_and_null_ids_differ(spark, docs_of):
    path = token_files.new_folder(spark)
    token_files.write(docs_of([(None, "none"), (-(1 << 63), "least"), (0, "zero")]), path)
    found = sorted((r["start"], r["doc_id"]) for r in token_files.read(spark, path).collect())
    assert [d for _, d in found] == [None, -(1 << 63), 0]


def test_cache_is_bounded_and_follows_the_texts(monkeypatch, prose):
    monkeypatch.setattr(tokens, "CACHE", 150)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        code = tokens.Encoder(name)
        for seed in range(12):
            texts = [prose(60, seed + k, 2000) + ". Foo, bar" for k in range(3)]
            want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            assert code.ids(texts) == want
            assert len(code.whole) + len(code.spaced) + len(code.words) <= 150
        # Texts of other words push out what is kept.
        texts = [f"{prose(30, 99, 50)} {k}" for k in range(3)]
        for _ in range(2):
            code.ids(["änders Ümlaute çedille naïve " * 3])
            code.ids(texts)
        assert code.unknown < 0.3


def test_a_worker_keeps_one_steps_tables():
    """Workers are used again: a later step finds no memory taken by an earlier step's encoder."""
    code = tokens.encoder("word_bpe_49k.json")
    assert tokens.encoder("word_bpe_49k.json") is code
    left = weakref.ref(code)
    del code
    list(language._count(iter([])))
    assert left() is None
    left = weakref.ref(tokens.encoder("byte_bpe_50k.json"))
    assert left() is tokens.encoder("byte_bpe_50k.json")
    ngram_join._decide(80)(pd.DataFrame({"q": [], "c": [], "apart": []}), pd.DataFrame({"class": [], "shingles": []}))
    assert left() is None
    left = weakref.ref(tokens.encoder("byte_bpe_50k.json"))
    list(secrets._pair_counts(iter([])))
    assert left() is None


def test_coding_an_id_takes_little_work():
    """Both ways together cost at most a few compressions of the same ids (six and more of them before)."""
    rng = np.random.default_rng(7)
    ids = np.minimum(rng.zipf(1.2, 1 << 20), 40_000).astype("<u4")
    work, raw = [], ids.tobytes()

    def seconds(run):
        begin = time.process_time()
        run()
        return time.process_time() - begin

    for _ in range(3):
        coder = seconds(lambda: range_coder.decode(range_coder.encode(ids)))
        work.append(coder / seconds(lambda: zlib.compress(raw, 6)))
    assert min(work) < 4


def test_ids_wider_than_a_word_and_many_blocks(monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 3)
    rng = np.random.default_rng(8)
    for top in (1, 200, 70_000, (1 << 32) - 1):
        for n in (range_coder.BLOCK * 3, range_coder.BLOCK * 7 + 5):
            ids = rng.integers(0, top, n, endpoint=True).astype("<u4")
            ids[::2] = ids[0]
            assert np.array_equal(range_coder.decode(range_coder.encode(ids)), ids)


def test_marks_beside_known_words_are_not_coded_anew(monkeypatch):
    """A lower-casing vocabulary codes words and runs of marks once, however they are joined."""
    code, asked = Encoder("word_bpe_49k.json"), []
    model, library = code._model, code._library
    monkeypatch.setattr(code, "_model", lambda words: asked.extend(words) or model(words))
    monkeypatch.setattr(code, "_library", lambda words: asked.extend(words) or library(words))
    code.ids(["alpha beta *** ### 7"])
    del asked[:]
    text = "alpha*** (beta) ###alpha 7beta### Alpha###7***"
    assert code.ids([text]) == [np.array(code.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sorted(asked) == ["(", ")"]


def test_pieces_follow_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    marks = [chr(c) for c in range(0x20, 0x250) if tokens._PLAIN.fullmatch(chr(c))]
    found = [f"a{m}b{m}{m}!{m}7{m}Z{m}" for m in marks] + ["it's 'tis x''s !'re we'll'd 12½ ȺƏ's ½''ve"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in found]
    assert Encoder("word_bpe_49k.json").ids(found) == want
