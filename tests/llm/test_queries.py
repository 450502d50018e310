"""Registered queries over the smallest tables: names, contract columns and counts."""

import os

import pytest

import __spark_entry__
from rankweave.llm import queries

DIR = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_ann": ["query_id", "rank", "vec_id", "score"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_html_extract": ["page_id", "url", "text", "n_chars"],
    "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_line_dedup": ["doc_id"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}
#: Columns must be of these types, whatever else a query returns.
TYPES = {"doc_id": "bigint", "n_tokens": "bigint", "query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double", "predicted": "int", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "n_chars": "bigint", "n_words": "bigint", "n_removed": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean", "held_out": "boolean", "base_failed": "boolean"}


def test_registered():
    assert set(CONTRACT) == set(queries.QUERIES) and set(CONTRACT) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="tables absent")
@pytest.mark.parametrize("name", ["op1_byte_bpe", "op3_quality", "op4_mixing", "op5_html_extract", "op6_substring_dedup", "op7_line_dedup", "op8_quality_rules", "op9_langid", "op10_minhash", "op11_periodic_runs", "op13_lm_score"])
def test_contract_columns(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    assert df.columns[: len(CONTRACT[name])] == CONTRACT[name]
    kinds = dict(df.dtypes)
    assert all(kinds[c] == TYPES[c] for c in CONTRACT[name] if c in TYPES)
    table = "pages" if name.startswith("op5") else "documents"
    assert df.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
