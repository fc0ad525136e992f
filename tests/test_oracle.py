"""Registered queries against their SQL. All of them with ALL_QUERIES=1, else a few of each kind."""

import os

import pytest

import __spark_entry__ as entry_module
from check import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
FEW = (
    "cell_totals", "candidate_cells", "second_pass_cleanup", "dataset_audit", "module_scores", "match_text", "metadata_filling",
    "receptor_flags", "rules_raw", "series_bundles_attached", "strata_sample", "cluster_labels", "label_transfer", "gdt_overlap",
    "grouped_quantiles_histogram_path",
)
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else FEW)
def test_query_agrees_with_sql(spark, name):
    result, _ = compare(spark, connect(SF), name, QUERIES[name], ORACLE.get(name), SF)
    assert result.startswith(("ok", "rows-only")), result


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
