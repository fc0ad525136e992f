import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoquilt.operators import metadata, ordering, quantiles, sampling


def skewed(spark, n=3000, parts=4):
    """One group holds most rows."""
    rows = [(i, "hot" if i % 3 else f"g{i % 11}", float((i * 7919) % 1009)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, grp string, v double").repartition(parts)


def test_row_number_matches_brute_force(spark):
    df = skewed(spark)
    out = ordering.grouped_row_number(df, ["grp"], [F.col("id")], F.floor(F.col("id") / 100), "rn").toPandas()
    pdf = df.toPandas().sort_values("id")
    pdf["rn"] = pdf.groupby("grp").cumcount() + 1
    assert out.set_index("id")["rn"].sort_index().tolist() == pdf.set_index("id")["rn"].sort_index().tolist()


def test_min_rank_matches_pandas(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("v")))
    out = ordering.distributed_min_rank(df, "v", "r").toPandas().set_index("id")["r"].sort_index()
    want = df.toPandas().set_index("id")["v"].sort_index().rank(method="min").astype(int)
    assert out.tolist() == want.tolist()


@pytest.mark.parametrize("n", [1, 50, 999, 1500, 10_000])
def test_group_sample_sizes_and_partition_invariance(spark, n):
    picks = []
    for parts in (1, 8):
        s = sampling.per_group_sample(skewed(spark, parts=parts), ["grp"], n, ["id"], 42)
        picks.append({(r["grp"], r["id"]) for r in s.collect()})
    assert picks[0] == picks[1]
    sizes = skewed(spark).groupBy("grp").count().toPandas().set_index("grp")["count"]
    got = pd.Series([g for g, _ in picks[0]]).value_counts()
    assert got.to_dict() == {g: min(n, c) for g, c in sizes.items()}


def test_both_ways_of_group_sampling_agree(spark):
    df = skewed(spark)
    direct = sampling.per_group_sample(df, ["grp"], 40, ["id"], 7)
    hashed = ordering.take_lowest_hash(df.withColumn("_w", F.lit(40)), ["grp"], ["id"], 7, "_w")
    assert {r["id"] for r in direct.collect()} == {r["id"] for r in hashed.collect()}


def test_fixed_sample_is_whole_when_small(spark):
    assert sampling.fixed_sample(skewed(spark, 30), 100, ["id"]).count() == 30
    assert sampling.fixed_sample(skewed(spark), 100, ["id"]).count() == 100


def test_strata_targets_stay_within_budget(spark):
    df = skewed(spark).withColumn("c", F.col("id") % 4)
    out = sampling.strata_targets(df, ["grp", "c"], 100, 60).toPandas()
    assert out["target_cells"].sum() <= 100 or (out["target_cells"] == 1).all()
    assert (out["target_cells"] >= 1).all() and (out["target_cells"] <= out["cells"]).all()


def test_top_one_per_key_is_cut_before_the_shuffle(spark):
    df = metadata.keep_first(skewed(spark), ["grp"], ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before
    assert {r["id"] for r in df.collect()} == set(skewed(spark).toPandas().groupby("grp")["id"].min())


def test_quantiles_match_numpy(spark):
    df = skewed(spark)
    probs = {"a": 0.01, "b": 0.5, "c": 0.977, "lo": 0.0, "hi": 1.0}
    out = quantiles.grouped_quantiles(df, ["grp"], "v", probs).toPandas().set_index("grp")
    for grp, rows in df.toPandas().groupby("grp"):
        for name, p in probs.items():
            assert out.loc[grp, name] == pytest.approx(np.quantile(rows["v"], p))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(-50, 50), st.integers(1, 4)), min_size=1, max_size=40))
def test_weighted_quantiles_match_repeated_rows(spark, rows):
    df = spark.createDataFrame(rows, "grp string, v double, w int")
    out = quantiles.grouped_quantiles(df, ["grp"], "v", {"m": 0.5, "q": 0.3}, "w").toPandas().set_index("grp")
    for grp in {r[0] for r in rows}:
        full = np.repeat([r[1] for r in rows if r[0] == grp], [r[2] for r in rows if r[0] == grp])
        assert out.loc[grp, "m"] == pytest.approx(np.quantile(full, 0.5), abs=1e-9)
        assert out.loc[grp, "q"] == pytest.approx(np.quantile(full, 0.3), abs=1e-9)


def test_systematic_sample_restarts_per_chunk(spark):
    df = spark.range(100).withColumnRenamed("id", "pos")
    got = sorted(r[0] for r in sampling.systematic_sample(df, 35, 40, "pos").collect())
    assert got == [0, 35, 40, 75, 80]


def test_ranks_and_quantiles_of_skewed_and_nan_values(spark):
    rows = [("a", float(v)) for v in [0] * 300 + list(range(50)) + [1e300, float("inf")]] + [("b", float("nan"))] * 5 + [("b", 1.0)] * 3
    df = spark.createDataFrame(rows, "grp string, v double").repartition(4)
    out = quantiles.grouped_quantiles(df, ["grp"], "v", {"m": 0.5, "hi": 1.0, "q": 0.9}).toPandas().set_index("grp")
    a = np.array([v for g, v in rows if g == "a"])
    assert out.loc["a", "m"] == np.quantile(a, 0.5) and out.loc["a", "hi"] == np.inf and out.loc["a", "q"] == pytest.approx(np.quantile(a, 0.9))
    assert np.isnan(out.loc["b", "m"]) and np.isnan(out.loc["b", "hi"])
    ranks = ordering.distributed_min_rank(df.where("grp = 'a'"), "v", "r").toPandas()
    assert dict(zip(ranks["v"], ranks["r"])) == {v: int((a < v).sum()) + 1 for v in a}


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_both_ways_of_a_group_sample_draw_the_same_rows(spark, n):
    df = spark.range(3000).selectExpr("id", "id % 2 as grp").repartition(3)
    got = {r["id"] for r in sampling.per_group_sample(df, ["grp"], n, ["id"]).collect()}
    order = df.withColumn("h", ordering.seeded_hash(["id"], 42)).toPandas().sort_values(["h", "id"])
    assert got == set(order.groupby("grp").head(n)["id"])


def test_written_tables_can_be_removed(spark):
    from cytoquilt import session

    df = session.materialize(spark.range(5).toDF("x"))
    assert df.count() == 5
    session.drop_materialized(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0]).count()
