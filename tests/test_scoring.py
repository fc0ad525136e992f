import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoquilt.operators import embedding, hvg, quantiles, scoring
from cytoquilt.operators.ordering import seeded_hash

N_CELLS, GENES = 40, [f"TRAV{i}" for i in range(3)] + ["TRBC1", "TRDC", "TRDV2"] + [f"G{i}" for i in range(60)]


@pytest.fixture
def data(frame):
    rng = np.random.default_rng(11)
    dense = rng.poisson(0.6, size=(N_CELLS, len(GENES))).astype(float)
    dense[3] = 0  # a cell without any count
    rows = [(f"c{i}", g, float(dense[i, j])) for i in range(N_CELLS) for j, g in enumerate(GENES) if dense[i, j]]
    counts = frame(rows, "cell_id string, gene string, count double")
    obs = frame([(f"c{i}", f"k{i % 3}", f"s{i % 2}") for i in range(N_CELLS)], "cell_id string, leiden string, source_gse_id string")
    var = frame([(g,) for g in GENES], "gene string")
    return dense, counts, obs, var


def log_norm(dense):
    total = dense.sum(axis=1, keepdims=True)
    return np.log1p(np.divide(dense * 1e4, total, out=np.zeros_like(dense), where=total > 0))


def test_scores_against_dense_reference(spark, data):
    dense, counts, obs, var = data
    values = log_norm(dense)
    means = pd.Series(values.mean(axis=0), index=GENES)
    cut = means.round(12).rank(method="min") // int(np.round(len(means) / 24))
    digest = {r["gene"]: r["h"] for r in var.select("gene", seeded_hash(["gene"], 1).alias("h")).collect()}
    modules = {"tra": [g for g in GENES if g.startswith("TRAV")], "trb": ["TRBC1"], "trd": ["TRDC", "TRDV2"]}
    modules["trab"] = sorted(modules["tra"] + modules["trb"])
    want = {}
    for name, genes in modules.items():
        ctrl = set()
        for b in set(cut[genes]):
            pool = sorted(cut[cut == b].index, key=lambda g: digest[g])[:2]
            ctrl |= set(pool) - set(genes)
        idx = [GENES.index(g) for g in genes]
        cdx = [GENES.index(g) for g in sorted(ctrl)]
        want[name] = values[:, idx].mean(axis=1) - (values[:, cdx].mean(axis=1) if cdx else 0)
    out = scoring.score_cells(obs, counts, var, scoring.find_modules(var), control_size=2, digits=12).toPandas().set_index("cell_id")
    for name in want:
        assert np.allclose([out.loc[f"c{i}", f"{name}_score"] for i in range(N_CELLS)], want[name])
    assert np.allclose(out["trd_minus_trab"], out["trd_score"] - out["trab_score"])
    assert out.loc["c3", "trd_score"] == 0


def test_constant_score_scales_to_zero(frame):
    df = frame([(1.5, 0.0), (1.5, 2.0)], "trd_score double, trab_score double")
    out = scoring.add_scaled_scores(df).toPandas().sort_values("trab_score")
    assert out["trd_score_scaled"].tolist() == [0, 0] and out["trab_score_scaled"].tolist() == [0, 1]
    assert out["trd_minus_trab_scaled"].tolist() == [0, -1]


def test_modules_must_not_be_empty(frame):
    with pytest.raises(ValueError):
        scoring.require_modules(scoring.find_modules(frame([("TRAC",)], "gene string")), ("tra", "trd"))


def test_moments_and_clipped_variance_against_dense(data):
    dense, counts, obs, _ = data
    moments = hvg.batch_moments(counts, obs, "source_gse_id").toPandas()
    norm = hvg.normalized_variance(counts, obs, "source_gse_id").toPandas().set_index(["source_gse_id", "gene"])["norm_variance"]
    for s in (0, 1):
        x = dense[s::2]
        got = moments[moments["source_gse_id"] == f"s{s}"].set_index("gene")
        for j, g in enumerate(GENES):
            if g in got.index:
                assert got.loc[g, "mean"] == pytest.approx(x[:, j].mean())
                assert got.loc[g, "variance"] == pytest.approx(x[:, j].var(ddof=1))
        fitted = hvg._trend(got.reset_index(), "source_gse_id", 0.3).set_index("gene")
        for g in got.index:
            if fitted.loc[g, "constant"]:
                continue
            reg, mean = fitted.loc[g, "reg_std"], got.loc[g, "mean"]
            clipped = np.minimum(x[:, GENES.index(g)], reg * math.sqrt(len(x)) + mean)
            want = ((clipped - mean) ** 2).sum() / ((len(x) - 1) * reg**2)
            assert norm[(f"s{s}", g)] == pytest.approx(want, rel=1e-6)


def test_local_quadratic_recovers_a_parabola():
    x = np.linspace(-2, 2, 60)
    assert np.allclose(hvg.local_quadratic(x, 3 + x - 2 * x**2, np.array([-1.0, 0.3])), [0.0, 3.12])


def test_variable_gene_selection_fails_when_short(data):
    _, counts, obs, var = data
    chosen = hvg.select_variable_genes(counts, obs, var, "source_gse_id", 10)
    assert chosen.count() == 10
    with pytest.raises(ValueError):
        hvg.select_variable_genes(counts, obs, var, "source_gse_id", 1000)


def test_latent_space_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    batch = np.arange(60) % 2
    x[batch == 1] += 10
    df = spark.createDataFrame([(i, x[i].tolist(), int(batch[i])) for i in range(60)], "i int, v array<double>, b int")
    got = np.array(embedding.latent_space(df, "v", 2, "b").orderBy("i").toPandas()["latent"].tolist())
    c = x.copy()
    for k in (0, 1):
        c[batch == k] -= c[batch == k].mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T), atol=1e-6)


def test_gene_vectors_and_clusters(spark, frame):
    v = frame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 9.0), ("b", "zz", 4.0)], "cell_id string, gene string, value double")
    rows = {r["cell_id"]: r["features"] for r in embedding.gene_vectors(v, ["x", "y"]).collect()}
    assert rows == {"a": [1.0, 2.0], "b": [0.0, 9.0]}
    pts = spark.range(40).select("id", F.array(F.when(F.col("id") < 20, 0.0).otherwise(50.0), F.col("id") / 100).alias("v"))
    out = embedding.embedding_clusters(pts, "v", 2).toPandas().sort_values("id")["leiden"].tolist()
    assert len(set(out[:20])) == 1 and len(set(out[20:])) == 1 and out[0] != out[-1]


def test_summary_with_own_quantiles_covers_every_score(spark):
    from workload import scoring as queries

    sf = "/root/testdata/sf0.001"
    out = queries.score_summary_histogram_path(spark, sf)
    assert {*queries.STATS, "p10", "p25", "p75", "p90", "p999"} <= set(out.columns)
    assert sorted(r["score_name"] for r in out.collect()) == sorted([*queries.RAW, *queries.SCALED])


def test_distinct_scores_are_ranged_by_their_number(spark, monkeypatch):
    """Twelve times the rows of a task are laid out in as many ranges, not in the session's partitions."""
    monkeypatch.setattr("cytoquilt.session.ROWS_PER_TASK", 1000)
    seen = []
    offsets = quantiles.bucket_offsets
    monkeypatch.setattr(quantiles, "bucket_offsets", lambda df, *rest: seen.append(df) or offsets(df, *rest))
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    df = spark.range(6001).select((F.col("id") / 10).alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    got = {r["score_name"]: r for r in scoring.score_summary(df, ["a", "b"]).collect()}
    assert seen[0].where("score_name = 'a'").groupBy("_part").count().agg(F.max("count")).first()[0] <= 1500
    assert [spark.conf.get(k) for k in keys] == before
    assert [got["a"][k] for k in ("n_cells", "p05", "median", "max")] == pytest.approx([6001, 30, 300, 600])
    assert [got["b"][k] for k in ("n_cells", "p05", "median", "max")] == [6001, 0, 0, 1]
