"""Registered queries over whole tables: columns, types and one row for each row of the table."""

import pytest

from civicframe.llm.registry import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": {"doc_id": "bigint"}, "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "op6_sentencepiece": {"doc_id": "bigint"},
    "op7_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}, "op9_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_sha256": "string"},
    "op12_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries()[name](spark, DATA)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.count()
    table = spark.read.parquet(f"{DATA}/{'pages' if name == 'op13_warc' else 'documents'}.parquet")
    if name not in ("op1_substring_dedup", "op6_sentencepiece"):
        assert rows == table.count()
        return
    known = {r[0] for r in table.select("doc_id").collect()}
    assert rows > 0 and {r[0] for r in df.select("doc_id").collect()} <= known
