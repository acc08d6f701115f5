"""The pipeline, stage by stage, against brute force on a small corpus with clashing column names."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_dedup import brute_components, edited
from test_texts import ENGLISH, GERMAN, brute_leaks, plain_spans, shuffled
from test_tokens_and_packing import check_packed
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    base = [shuffled(ENGLISH if k % 2 else GERMAN, k, 60 + k) for k in range(20)]
    items = [(k, shuffled(ENGLISH, 200 + k, 30)) for k in range(4)]
    texts = [*base, *[edited(base[0], k, 1) for k in range(6)], base[3], base[3], None, "", " 12 -- 34 ", "日本語"]
    texts += [f"{shuffled(ENGLISH, 300 + k, 25)} {items[k][1]} {shuffled(ENGLISH, 400 + k, 25)}" for k in range(3)]
    texts += [shuffled(ENGLISH, 500, 30) + " password = 'abcdefghijkl0' " + shuffled(ENGLISH, 501, 30)]
    texts += [shuffled(GERMAN, 502, 30) + " deadbeefdeadbeef00 AKIA" + "Z9" * 8, shuffled(ENGLISH, 503, 5000)]
    rows = [(k, t, "en" if t and t.isascii() else "de", "s", len(t or ""), "key", "x") for k, t in enumerate(texts)]
    rows += [(5, base[5], "de", "s", 9, "key", "x"), (None, shuffled(ENGLISH, 600, 50), None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc_key string, _key string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, schema, rows, items


def test_stages(spark, corpus):
    folder, _, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near_duplicates", "decontaminate", "secrets", "pack"]

    def held(df):
        assert df.columns == columns
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    kept = [(k, t) for k, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    docs = stage["language"](spark, docs, folder)
    assert held(docs) == sorted(kept, key=str)

    found = brute_components([(k, t) for k, t in dict(kept).items() if k is not None], 5, 80)
    kept = [(k, t) for k, t in dict(kept).items() if k is None or found[k][1] == k]
    docs = stage["near_duplicates"](spark, docs, folder)
    assert held(docs) == sorted(kept, key=str)

    leaks = {k for k, _ in brute_leaks(kept, items, 80)}
    assert len(leaks) == 3
    kept = [(k, t) for k, t in kept if k not in leaks]
    docs = stage["decontaminate"](spark, docs, folder)
    assert held(docs) == sorted(kept, key=str)

    def masked(text):
        out, at = "", 0
        for _, start, end in plain_spans(text):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        return out + text[at:]

    kept = [(k, masked(t)) for k, t in kept]
    docs = stage["secrets"](spark, docs, folder)
    assert held(docs) == sorted(kept, key=str) and any("[secret]" in t for _, t in kept)
    assert {r["n_chars"] for r in docs.collect() if r["text"] and "[secret]" in r["text"]} == {
        len(t) for _, t in kept if "[secret]" in t
    }

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in kept}
    pieces = [r.asDict() for r in corpus_pipeline.packing.pack(docs).collect()]
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in check_packed(pieces, 1024).items()} == want
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in whole} == set(want)
    assert sum(r["length"] for r in whole) == sum(map(len, want.values()))


def test_nothing_left(spark, corpus, tmp_path):
    folder, schema, *_ = corpus
    spark.createDataFrame([(1, None, None, None, None, None, None)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_workers_get_few_texts_at_once(spark, docs_of):
    """Neither an executor nor its workers hold the texts of a whole task; a session's own limit stays."""
    text = "word " * 1000
    docs = docs_of([(k, text) for k in range(1500)]).coalesce(1)
    stage = dict(corpus_pipeline.STAGES)

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    try:
        spark.conf.unset(limit)
        assert stage["secrets"](spark, docs, "").count() == 1500
        got = [r["n"] for r in docs.mapInArrow(rows, "n long").collect()]
        assert sum(got) == 1500 and max(got) * len(text) < 4 << 20
        spark.conf.set(limit, "64m")
        stage["secrets"](spark, docs, "")
        assert spark.conf.get(limit) == "64m"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
