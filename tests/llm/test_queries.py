import pytest

import __spark_entry__
import corpus_pipeline
from fleetgauge.llm import queries
from tests.compare import connect, duckdb_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    columns, rows = spark_rows(queries.queries()[name](spark, SF))
    expected_columns, expected = duckdb_rows(connect(SF), queries.oracle_sql()[name])
    assert columns == expected_columns and rows == expected and len(rows) > 0


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.partition("_")[0] for name in found if name.startswith("op")}
    assert found["pipeline"] is corpus_pipeline.run


def test_stages_keep_columns_and_only_drop_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.schema == docs.schema, name
        assert kept.exceptAll(docs).count() == 0, name
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(packed.select(key).collect()) == sorted(whole.select(key).collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
