"""Every registered query of the training-data operators: columns, their order and types, and SQL where there is some."""

from __future__ import annotations

import pytest

import compare
from sparkqual.llm import suite

SF_DIR = "/root/testdata/sf0.001"
LONG, TEXT = "bigint", "string"
# The contract: these columns come first, in this order.
COLUMNS = {
    "op1_pack": {
        "doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG,
    },
    "op2_secrets": {"doc_id": LONG, "n_assign": LONG, "n_access": LONG, "n_hex": LONG, "base_sha256": TEXT, "spans": TEXT},
    "op3_token_files": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op4_ngram_join": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
    "op5_neighbours": {"query_id": LONG, "rank": "int", "vec_id": LONG, "score": "double"},
    "op6_toxicity": {"doc_id": LONG, "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_language": {"doc_id": LONG, "held_out": "boolean", "lang_pred": TEXT, "score": "double"},
    "op8_substrings": {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT},
    "op9_url_filter": {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT},
    "op10_decontaminate": {"doc_id": LONG, "item_id": LONG},
    "op11_prefix_trie": {
        "conv_id": LONG, "depth": LONG, "parent_conv_id": LONG, "n_convs": LONG, "n_children": LONG, "n_leaves": LONG,
        "saved_tokens": LONG, "ends_sha256": TEXT,
    },
    "op12_lexical_search": {"item_id": LONG, "rank": "int", "doc_id": LONG, "score": LONG},
    "op13_passages": {"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept_sha256": TEXT},
}


def test_all_are_registered():
    assert list(suite.all_queries()) == list(COLUMNS)
    assert set(suite.all_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    found = suite.all_queries()[name](spark, SF_DIR)
    types = [(f.name, f.dataType.simpleString()) for f in found.schema]
    assert types[: len(COLUMNS[name])] == list(COLUMNS[name].items())
    if name in suite.all_sql():
        assert compare.compare(spark, compare.oracle(SF_DIR), name, lambda *_: found, suite.all_sql()[name], SF_DIR) == ""
    else:
        assert found.count() > 0
