import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquilt.functions.barcodes import alignment_key
from cytoquilt.functions.labels import pool_from_suffix
from cytoquilt.operators import metadata, rules, tcr
from cytoquilt.plans import intake, jobs


@pytest.fixture
def cohort(frame):
    """Two datasets with raw counts; the genes carry real symbols."""
    rng = np.random.default_rng(9)
    genes = ["CD3D", "TRAC", "TRBC1", "TRAV1", "TRBV2", "TRDC", "TRDV1", "NKG7", "GNLY", "KLRD1", "LYZ", "MS4A1", "FOXP3", "CD4", "CD8A", "MT-CO1"]
    genes += [f"G{i}" for i in range(160)]
    counts, obs = [], []
    for k in range(60):
        gse = "A" if k < 40 else "B"
        cell = f"{gse}__c{k}"
        lam = np.full(len(genes), 3.0)
        if k % 3:
            lam[:7] = 0
        if k % 7 == 0:
            lam[7:10] = 20
        drawn = rng.poisson(lam)
        counts += [(gse, cell, g, float(v)) for g, v in zip(genes, drawn) if v]
        obs.append((gse, cell, f"donor{k % 4}", "T cell" if k % 10 == 0 else "other", k % 3, k, "blood" if k % 2 else "na"))
    return (
        frame(counts, "gse_id string, cell_id string, gene string, count double"),
        frame(obs, "gse_id string, cell_id string, donor string, cell_type string, leiden int, cell_pos int, tissue string"),
        frame([(i, g) for i, g in enumerate(genes)], "gene_pos int, gene string"),
        genes,
    )


def test_extract_then_clean(spark, cohort, frame):
    counts, obs, var, genes = cohort
    dvar = var.crossJoin(obs.select("gse_id").distinct()).withColumn("symbol", F.col("gene"))
    out = jobs.extract(counts, obs, dvar)
    summary = {r["gse_id"]: r for r in out["summary"].collect()}
    assert summary["A"]["input_n"] == 40 and summary["B"]["input_n"] == 20
    assert out["cells"].count() == sum(r["candidate_n"] for r in summary.values())
    assert out["counts"].select("cell_id").distinct().count() == out["cells"].count()
    assert "donor_label" in out["cells"].columns and out["availability"].count() == 10

    first = jobs.cleanup_first(out["counts"], out["cells"], var, 5)
    total = first["summary"].first()
    assert total["cells_before"] == total["cells_after"] + total["cells_removed_total"]
    assert total["genes_before"] == len(genes) == total["genes_after"] + total["genes_removed"]
    assert first["counts"].select("gene").distinct().count() == total["genes_after"]

    cells = first["cells"].drop("remove_reason", "remove", "remove_doublet", "remove_off_target", "total", "n_genes")
    svar = var.withColumn("symbol", F.col("gene"))
    second = jobs.cleanup_second(first["counts"], cells, svar, 5, every_n=10, chunk=30)
    reasons = {r["remove_reason"]: r["cells"] for r in second["reasons"].collect()}
    assert sum(reasons.values()) == cells.count()
    assert second["cells"].count() == reasons.get("kept", 0)
    assert {r["cell_pos"] % 10 for r in second["sampled"].collect()} <= {0}


def test_score_and_annotate(spark, cohort):
    counts, obs, var, _ = cohort
    cells = obs.withColumns({"source_gse_id": F.col("gse_id"), "leiden": F.col("leiden").cast("string")})
    scored = jobs.score(counts, cells, var, control_size=5)
    assert scored["summary"].count() == 8 and scored["by_cluster"].count() == 3 and scored["by_dataset"].count() == 2
    lo, hi = scored["scores"].agg(F.min("trd_score_scaled"), F.max("trd_score_scaled")).first()
    assert (lo, hi) == (0.0, 1.0)
    flagged = tcr.receptor_flags(scored["scores"])
    out = jobs.annotate(flagged, counts, var.withColumn("symbol", F.col("gene")))
    assert out["clusters"].count() == 3 and out["cells"].count() == 60
    assert out["changes"].where("old_label = 'NA'").count() == 0
    assert sum(r["n_cells"] for r in out["by_tissue"].collect()) == 60


RULES = {
    "sample_per_gse": 3, "random_seed": 1, "unknown_label": "unknown", "ignore_if_contains": [],
    "global_exact_map": {"control": "healthy"}, "global_regex_rules": [{"pattern": "tumou?r", "value": "disease", "reason": "tumour"}],
    "gse_default_map": {}, "gse_specific_rules": {"B": [{"fields": ["sample_id"], "pattern": "^hd[0-9]", "value": "healthy", "reason": "HD"}]},
}


def test_rule_jobs(frame):
    obs = frame([("A" if i < 9 else "B", f"A||c{i}", f"c{i}", f"hd{i}", " ") for i in range(12)], "source_gse_id string, metadata_key string, obs_name string, sample_id string, library_id string")
    meta = frame([(f"A||c{i}", "Control" if i < 5 else "x", "GSM5", "tumor" if i == 6 else None, "p") for i in range(8)],
                 "metadata_key string, condition string, library_id string, sample_type string, donor_patient string")
    fill = ("library_id",)
    bundles = frame([("A", "GSM5", "t", "tumour | b", 0)], "gse_id string, gsm string, title string, bundle string, pos long")
    out = jobs.apply_rules(obs, meta, RULES, rules.DISEASE, fill=fill)
    got = {r["obs_name"]: r["disease_status_corrected"] for r in out["cells"].collect()}
    assert got["c0"] == "healthy" and got["c6"] == "disease" and got["c7"] == "unknown" and got["c11"] == "unknown"
    by = {r["source_gse_id"]: r for r in out["by_dataset"].collect()}
    assert by["A"]["cell_n"] == 9 and by["A"]["original_blank"] == 1 and by["B"]["corrected_unknown"] == 3
    assert out["unknown_examples"].count() == 6
    with_series = jobs.apply_rules(obs, meta, RULES, rules.DISEASE, bundles, fill=fill)["cells"]
    assert {r["obs_name"]: r["disease_status_corrected"] for r in with_series.collect()}["c7"] == "disease"
    review = jobs.audit_rules(obs, meta, RULES, rules.DISEASE, fill=fill)
    assert review["cells"].count() == 6
    assert all(r["disease_status_corrected"] == "healthy" for r in review["cells"].where("source_gse_id = 'B'").collect())
    assert review["distinct_values"].count() > 0


def test_metadata_join_refuses_bad_keys(frame):
    obs = frame([(1, "a"), (2, "")], "k int, s string")
    good = frame([(1, "x"), (2, "y"), (3, "z")], "k int, sample_id string")
    out = metadata.join_one_to_one(obs, good, ["k"], {"sample_id": "s"})
    assert sorted(tuple(r) for r in out.select("k", "sample_id").collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="unmatched"):
        metadata.join_one_to_one(obs, good.where("k <> 2"), ["k"])
    with pytest.raises(ValueError, match="duplicate"):
        metadata.join_one_to_one(obs, good.union(good), ["k"])
    with pytest.raises(ValueError, match="unmatched"):
        metadata.join_one_to_one(frame([(1, "a"), (None, "b")], "k int, s string"), good, ["k"])


def test_rescue_from_inputs(frame):
    raw = frame([(f"AC{b}-1-{s}", g, 2.0, b, s) for b in "GTA" for s in ("s1", "s2") for g in ("CD3D", "TRAC", "LINC01", "G1")],
                "cell_id string, gene string, count double, b string, s string")
    cells = raw.select("cell_id", F.concat(F.lit("AC"), "b", F.lit("-1")).alias("barcode"), F.col("s").alias("sample")).distinct()
    cells = cells.withColumn("alignment_key", alignment_key("barcode", "sample"))
    current = cells.select(F.concat(F.lit("now_"), "alignment_key").alias("cell_id"), "alignment_key").where("alignment_key <> 'ACA-1__s2'")
    genes = frame([("CD3D",), ("G1",)], "gene string")
    settings = jobs.RescueSettings(2, 2, 50.0)
    out = jobs.rescue_from_inputs(raw.drop("b", "s"), cells, current, genes, settings, dry_run=False)
    report = out["cells_report"].first()
    assert (report["only_current"], report["only_rebuilt"], report["keys_unique"], report["set_equal"]) == (0, 1, True, False)
    assert out["genes_report"].first()["current_subset_of_rebuilt"]
    assert out["repaired"].count() == 10 and {r["cell_id"][:4] for r in out["repaired"].collect()} == {"now_"}
    dry = jobs.rescue_from_inputs(raw.drop("b", "s"), cells, current, genes, settings)
    assert "repaired" not in dry


def test_prepare_cells_resolves_aliases_and_duplicates(frame):
    obs = frame(
        [("x_AAAC-1", 0, "D1", None, "CASS", "old"), ("y_AAAC-1", 1, "", "lung", "", "old"), ("y_AAAC-1", 2, "D2", "lung", "", "old")],
        "name string, pos int, patient string, Tissue string, TRB_cdr3 string, leiden string",
    )
    repair = intake.Repair(always={"Sorted_gdT": "True"}, if_all_blank={"condition": "none given", "tissue": "never"})
    rows = {r["cell_id"]: r for r in intake.prepare_cells(obs, "DS1", "name", "pos", 2, repair).collect()}
    assert set(rows) == {"DS1__x_AAAC-1", "DS1__y_AAAC-1", "DS1__y_AAAC-1__dup1"}
    one = rows["DS1__x_AAAC-1"]
    assert (one["source_gse_id"], one["barcodes"], one["barcode_core"], one["donor_id"], one["tissue"]) == ("DS1", "AAAC-1", "AAAC", "D1", "")
    assert (one["sample_id"], one["project name"], one["assay_type"], one["Sorted_gdT"], one["condition"]) == ("DS1", "DS1", "scRNA", "True", "none given")
    assert one["has_any_ab_tcr"] and one["TCRseq"] == "yes" and rows["DS1__y_AAAC-1"]["TCRseq"] == "no"
    assert "leiden" not in one.asDict() and one["TRG_c_gene"] == ""


def test_intake_builder_and_candidate_metadata(frame):
    cells = frame([("lib_AAAC-1", "P1", "TRB:x;TRA:y", "cl1", 0), ("lib_GGGG-2", "P2", "", "cl2", 1)], "name string, patient string, pairs string, clone string, row_ord int")
    spec = intake.IntakeSpec(
        "GSE9",
        {
            "barcode": lambda df: F.substring_index("name", "_", -1),
            "sample_id": lambda df: F.col("patient"),
            "library_id": lambda df: pool_from_suffix("name", ["poolA", "poolB"]),
        },
        platform_id="GPL1",
    )
    staged = cells.withColumns({n: f(cells) for n, f in spec.columns.items()})
    table = intake.paired_text_receptors(staged, "pairs", "clone")
    built = intake.build_cells(cells, spec, table)
    rows = {r["cell_id"]: r for r in built.collect()}
    assert set(rows) == {"poolA:AAAC-1", "poolB:GGGG-2"}
    assert rows["poolA:AAAC-1"]["TRA_cdr3"] == "y" and rows["poolA:AAAC-1"]["tcr_availability"] == "yes"
    base = intake.base_metadata(built)
    assert len(base.columns) == 38 and base.first()["age"] == ""
    candidates = base.select("gse_id", "cell_id", F.lit("S9").alias("sample_label"))
    final = intake.candidate_metadata(candidates, base, ["cell_id", "sampleid", "TCRseq", "not_there"])
    got = {r["cell_id"]: (r["sampleid"], r["not_there"]) for r in final.collect()}
    assert got["poolA:AAAC-1"] == ("P1", "")
    with pytest.raises(ValueError):
        intake.build_cells(cells, intake.IntakeSpec("G", {}))


def test_audit_job(frame):
    registry = frame([("A",), ("B",), ("Z",)], "gse_id string")
    counts = frame([("A", "X", 1.0), ("A", "X", 3.0), ("B", "X", 0.5), ("B", "layer:counts", 2.0)], "gse_id string, matrix string, count double")
    obs = frame([("A",), ("A",), ("B",)], "gse_id string")
    var = frame([("A", 0, "TRAC"), ("A", 1, "TRAC"), ("B", 0, "ENSG1")], "gse_id string, gene_pos int, symbol string")
    out = jobs.audit(registry, counts, obs, var, obs_columns={"A": ["patient", "sample"], "B": ["batch"]})
    rows = {r["gse_id"]: r for r in out["audit"].collect()}
    assert [rows[g]["category"] for g in "ABZ"] == ["A", "B", "C"]
    assert rows["A"]["duplicate_var_names"] == 1 and rows["A"]["donor_fields"] == "patient" and rows["B"]["library_fields"] == "batch"
    assert rows["B"]["gene_naming_style"] == "ensembl_like" and rows["Z"]["state_label"] == "unreadable_or_unknown"
    cover = {r["field_type"]: (r["datasets_with_field"], r["datasets_without_field"]) for r in out["field_coverage"].collect()}
    assert cover["donor_fields"] == (1, 2)
