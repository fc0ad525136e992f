import os

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from cytoquilt.llm import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_and_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert before >= counts[0] == counts[1] >= counts[2] == counts[3]
    assert docs.select("doc_id").distinct().count() == counts[3]


def test_registered():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_edge_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, further columns and an empty table run through every stage."""
    from fixtures import SCHEMA, edge_rows

    docs = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for name, rows in (("full", docs), ("none", docs.where("false"))):
            stage(spark, rows, SF).write.parquet(f"file://{tmp_path}/{name}{k}")
        none = spark.read.parquet(f"file://{tmp_path}/none{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/full{k}")
        assert none.count() == 0 and none.columns == docs.columns and docs.count() > 0
        if k < 4:
            assert docs.columns == [c.strip("`") for c in ("doc_id", "text", "source", "_a", "bucket", "count", "id", "odd name")]
