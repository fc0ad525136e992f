import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquilt.operators import alignment, audit, cleanup, extract, matrix

COUNTS = "gse_id string, cell_id string, gene string, count double"
VAR = "gse_id string, gene_pos int, gene string, symbol string"
PANELS = {"t": ("CD3D", "TRAC"), "gd": ("TRDC",), "nk": ("NKG7", "GNLY"), "nk_strong": ("GNLY",), "contam": ("LYZ",)}


@pytest.fixture
def small(frame):
    var = frame(
        [("A", 0, "g0", "GRCh38_TRAC"), ("A", 1, "g1", "trac"), ("A", 2, "g2", "CD3D"), ("A", 3, "g3", "LYZ"), ("A", 4, "g4", "ACTB"),
         ("B", 0, "h0", "TRDC"), ("B", 1, "h1", "NKG7"), ("B", 2, "h2", "GNLY"), ("B", 3, "h3", "ACTB")], VAR)
    counts = frame(
        [("A", "a1", "g0", 2.0), ("A", "a1", "g1", 9.0), ("A", "a1", "g4", 5.0), ("A", "a2", "g4", 10.0),
         ("B", "b1", "h1", 1.0), ("B", "b1", "h2", 3.0), ("B", "b2", "h3", 4.0)], COUNTS)
    obs = frame([("A", "a1"), ("A", "a2"), ("A", "empty"), ("B", "b1"), ("B", "b2")], "gse_id string, cell_id string")
    return obs, counts, var


def test_profile_uses_first_gene_and_mean_of_logs(small):
    out = {r["cell_id"]: r for r in extract.marker_profile(*small, PANELS).collect()}
    # first TRAC only (g0 = 2), two T genes in this dataset, total 16
    assert out["a1"]["t_hits"] == 1
    assert out["a1"]["t_score"] == pytest.approx(math.log1p(2e4 / 16) / 2)
    assert out["b1"]["nk_score"] == pytest.approx((math.log1p(1e4 / 4) + math.log1p(3e4 / 4)) / 2)
    assert (out["empty"]["total"], out["empty"]["t_score"], out["empty"]["n_genes"]) == (0, 0, 0)
    assert out["b1"]["t_score"] == 0  # dataset B has no T gene


def test_log_of_mean_differs_from_mean_of_logs(frame, small):
    obs, counts, var = small
    one = cleanup.group_scores(
        obs.where("gse_id = 'B'"), counts.where("gse_id = 'B'"), var.where("gse_id = 'B'"), {"x": ("NKG7", "GNLY"), "none": ("QQQ",)},
        mito=F.lit(False),
    )
    row = one.where("cell_id = 'b1'").first()
    assert row["x_score"] == pytest.approx(math.log1p(1e4 * (4 / 2) / 4))
    assert row["none_score"] == 0


def test_availability_counts_genes_per_dataset(small):
    obs, _, var = small
    got = {(r[0], r[1]): r[2] for r in extract.availability_table(obs, var, PANELS).collect()}
    assert got[("A", "T")] == 2 and got[("B", "T")] == 0 and got[("B", "NK")] == 2


def _candidate(frame, **kw):
    base = dict(t_hits=0, gd_hits=0, nk_hits=0, nk_strong_hits=0, t_score=0.0, gd_score=0.0, nk_score=0.0, contam_score=0.0, label="zzz")
    base.update(kw)
    ddl = ", ".join(f"{k} {'int' if k.endswith('hits') else 'string' if k == 'label' else 'double'}" for k in base)
    df = frame([tuple(base.values())], ddl, 1)
    return extract.select_candidates(df, ["label"]).first()


@pytest.mark.parametrize(
    "kw, keep, reason",
    [
        (dict(t_hits=1), True, "marker_only"),
        (dict(nk_hits=2), False, "marker_only"),
        (dict(nk_hits=2, nk_strong_hits=1), True, "marker_only"),
        (dict(t_score=0.60), True, "marker_only"),
        (dict(t_score=0.5999), False, "marker_only"),
        (dict(gd_score=0.35), True, "marker_only"),
        (dict(nk_score=0.80), True, "marker_only"),
        (dict(t_hits=1, contam_score=1.25), False, "marker_only"),
        (dict(t_hits=2, contam_score=1.25), True, "marker_only"),
        (dict(t_hits=1, contam_score=1.2499), True, "marker_only"),
        (dict(t_hits=1, label="Monocyte"), False, "marker_only"),
        (dict(label="unknown"), True, "annotation_only"),
        (dict(t_hits=1, label="T cell"), True, "annotation_and_marker"),
        (dict(t_hits=1, label="B cell; T cell"), True, "annotation_and_marker"),
    ],
)
def test_keep_rule_boundaries(frame, kw, keep, reason):
    row = _candidate(frame, **kw)
    assert (row["keep"], row["selection_reason"]) == (keep, reason)


def test_negative_in_another_column_still_counts(frame):
    df = frame([("T cell", "Monocyte"), ("x", "Monocyte")], "a string, b string", 1)
    keep, against = extract.annotation_flags(["a", "b"])
    assert sorted(tuple(r) for r in df.select(keep.alias("k"), against.alias("n")).collect()) == [(False, True), (True, True)]


@pytest.mark.parametrize(
    "kw, reason",
    [
        (dict(contam_score=1.5, selection_reason="annotation_only"), "obvious_non_tnk"),
        (dict(contam_score=1.4999, selection_reason="annotation_only"), "kept"),
        (dict(contam_score=1.5, selection_reason="marker_only"), "kept"),
        (dict(contam_score=2.0, t_score=1.5, nk_score=1.5), "high_conf_doublet"),
        (dict(contam_score=2.0, t_score=1.4999, nk_score=1.5), "kept"),
    ],
)
def test_first_pass_boundaries(frame, kw, reason):
    base = dict(t_hits=0, gd_hits=0, nk_hits=0, nk_strong_hits=0, t_score=0.0, gd_score=0.0, nk_score=0.0, contam_score=0.0, selection_reason="marker_only")
    base.update(kw)
    ddl = ", ".join(f"{k} {'int' if k.endswith('hits') else 'string' if k == 'selection_reason' else 'double'}" for k in base)
    assert cleanup.first_pass_decisions(frame([tuple(base.values())], ddl, 1)).first()["remove_reason"] == reason


@pytest.mark.parametrize(
    "kw, reason",
    [
        (dict(), "kept"),
        (dict(n_genes=99), "low_quality"),
        (dict(total=149.0), "low_quality"),
        (dict(n_genes=199, pct_mt=0.30), "low_quality"),
        (dict(n_genes=200, pct_mt=0.90), "kept"),
        (dict(contam_score=1.75), "extreme_phase1_contam"),
        (dict(contam_score=1.75, t_score=0.51), "kept"),
        (dict(myeloid_score=1.20), "myeloid_conflict"),
        (dict(myeloid_score=1.20, bcell_score=1.20), "myeloid_conflict"),
        (dict(myeloid_score=1.20, bcell_score=1.21), "bcell_conflict"),
        (dict(myeloid_score=1.1999), "kept"),
        (dict(epithelial_score=1.00), "epithelial_conflict"),
        (dict(platelet_score=1.00, t_score=0.75), "kept"),
        (dict(platelet_score=1.11, t_score=0.75, erythroid_score=0.9), "platelet_conflict"),
        (dict(platelet_score=1.50, t_hits=2), "kept"),
    ],
)
def test_second_pass_boundaries(frame, kw, reason):
    base = dict(t_hits=0, gd_hits=0, nk_hits=0, nk_strong_hits=0, n_genes=500, total=1000.0, pct_mt=0.0, t_score=0.0, gd_score=0.0, nk_score=0.0,
                contam_score=0.0, myeloid_score=0.0, bcell_score=0.0, epithelial_score=0.0, erythroid_score=0.0, platelet_score=0.0)
    base.update(kw)
    ddl = ", ".join(f"{k} {'int' if k.endswith('hits') or k == 'n_genes' else 'double'}" for k in base)
    assert cleanup.second_pass_reasons(frame([tuple(base.values())], ddl, 1)).first()["remove_reason"] == reason


def test_value_sanity_reasons(frame):
    rows = [("ok", 1.0), ("nan", float("nan")), ("inf", float("inf")), ("neg", -1.0), ("big", 200.0), ("both", 300.0), ("both", -1.0)]
    got = {r["cell_id"]: r["sanity_reason"] for r in cleanup.value_sanity(frame(rows, "cell_id string, count double"), limit=100).collect()}
    assert got == {
        "ok": "kept", "nan": "invalid_matrix_values", "inf": "invalid_and_extreme", "neg": "invalid_matrix_values",
        "big": "extreme_library_size", "both": "invalid_and_extreme",
    }


def test_gene_filter_fails_when_nothing_is_left(frame):
    counts = frame([("c", "g", 1.0)], "cell_id string, gene string, count double")
    summary = cleanup.gene_summary(frame([("g",)], "gene string"), cleanup.cells_per_gene(counts, counts), 2)
    with pytest.raises(ValueError):
        cleanup.keep_detected_genes(counts, summary)


@pytest.mark.parametrize(
    "state, args",
    [
        ("scaled_or_integrated_X", (True, 1.0, False, None, False, None)),
        ("raw_like_X", (False, 0.98, False, None, False, None)),
        ("recoverable_counts_layer", (False, 0.9799, True, 0.98, True, 1.0)),
        ("recoverable_raw_slot", (False, 0.5, True, 0.9, True, 0.98)),
        ("normalized_or_noninteger_X", (False, 0.5, False, None, False, None)),
        ("unreadable_or_unknown", (None, None, False, None, False, None)),
    ],
)
def test_audit_states(spark, state, args):
    kinds = ("boolean", "double") * 3
    cols = [F.lit(a).cast(k) for a, k in zip(args, kinds, strict=True)]
    assert spark.range(1).select(audit.classify_state(*cols)["state_label"]).first()[0] == state


def test_pseudo_counts_round_trip_and_refusal(frame):
    rng = np.random.default_rng(0)
    raw = [(f"c{i}", f"g{j}", float(v)) for i in range(20) for j, v in enumerate(rng.integers(0, 9, 12)) if v]
    totals = {}
    for c, _, v in raw:
        totals[c] = totals.get(c, 0) + v
    logs = frame([(c, g, math.log1p(v * 1e4 / totals[c])) for c, g, v in raw], "cell_id string, gene string, count double")
    obs = frame([(c, i, t) for i, (c, t) in enumerate(totals.items())], "cell_id string, cell_pos int, nCount double")
    out, median = matrix.inverse_log_counts(logs, obs, "nCount")
    assert median == pytest.approx(1e4)
    assert sorted(tuple(r) for r in out.select("cell_id", "gene", "count").collect()) == sorted(raw)
    same, median = matrix.inverse_log_counts(logs.withColumn("count", F.col("count") / 2), obs, "nCount")
    assert not 9500 <= median <= 10500
    with pytest.raises(ValueError):
        matrix.inverse_log_counts(logs, obs.withColumn("nCount", F.when(F.col("cell_pos") > 0, F.col("nCount"))), "nCount")


def test_rescue_needs_every_gene(frame):
    raw = frame([("c", "g1", 2.0), ("c", "g2", 3.0)], "cell_id string, gene string, count double")
    assert alignment.rescue_counts(raw, frame([("g2",)], "gene string")).count() == 1
    with pytest.raises(ValueError):
        alignment.rescue_counts(raw, frame([("g3",)], "gene string"))
