import pytest

from cytoquilt.operators import tcr, validate

CONTIG = "sample_id string, barcode string, chain string, cdr3 string, cdr3_nt string, v_gene string, umis string, reads int, row_ord long"


@pytest.fixture
def contigs(frame):
    return frame(
        [
            ("S1", "AAAC-1", "TRA", "", "", "va0", "3", 9, 1),
            ("S1", "AAAC-1", "TRA", "CA1", "nt1", "va1", "3", 10, 2),
            ("S1", "AAAC-1", "tra", "CA2", "nt2", "va2", "2", 99, 3),
            ("S1", "AAAC-1", "TRB", "CB1", "nt", "vb1", "bad", 5, 4),
            ("S2", "AAAC-1", "TRG", "CG1", "nt", "vg1", "4", 5, 5),
            ("S2", "AAAC-1", "TRD", "CD1", "", "vd1", "4", 5, 6),
            ("S2", "GGGG-1", "Multi", "x", "", "v", "4", 5, 7),
            ("S2", "nan", "TRA", "x", "", "v", "4", 5, 8),
        ],
        CONTIG,
    )


def test_best_contig_and_first_values(contigs):
    best = {(r["sample_id"], r["barcode_core"]): r for r in tcr.canonical_receptors(contigs).collect()}
    assert set(best) == {("S1", "AAAC"), ("S2", "AAAC")}
    one = best[("S1", "AAAC")]
    assert (one["TRA_cdr3"], one["TRA_v"], one["TRA_umis"], one["TRA_reads"], one["TRB_umis"]) == ("CA1", "va1", 3, 10, 0)
    first = {(r["sample_id"], r["barcode_core"]): r for r in tcr.canonical_receptors(contigs, rule="first").collect()}[("S1", "AAAC")]
    assert (first["TRA_cdr3"], first["TRA_v"], first["TRA_umis"], first["TRA_reads"]) == ("CA1", "va0", 3, 99)


def test_merge_never_crosses_samples_or_fans_out(frame, contigs):
    obs = frame(
        [("S1", "AAAC-1", 1), ("S2", "aaac-1-0", 2), ("S3", "AAAC-1", 3), (" S1 ", "TTTT-1", 4)], "sample_id string, barcode string, i int"
    )
    table = tcr.canonical_receptors(contigs)
    chains = ("TRA", "TRB", "TRG", "TRD")
    out = tcr.receptor_flags(tcr.merge_receptors(obs, table, chains))
    rows = {r["i"]: r for r in out.collect()}
    assert len(rows) == 4
    assert rows[1]["has_TRA_TRB_paired"] and not rows[1]["has_any_gd_tcr"]
    assert rows[2]["has_TRG_TRD_paired"] and not rows[2]["has_any_ab_tcr"]
    assert rows[3]["TCRseq"] == "no" and rows[3]["TRA_cdr3"] == "" and rows[3]["TRA_umis"] == 0
    report = {r["sample_id"]: r for r in validate.receptor_sanity(obs, out, table, "sample_id").collect()}
    assert report["S3"]["paired_fraction"] == 0 and not report["S3"]["suspicious"]


def test_zero_text_does_not_count_as_receptor(frame):
    obs = frame([("S", "AC-1")], "sample_id string, barcode string")
    cols = {c: "0" for c in tcr.text_columns(("TRA", "TRB"))} | {c: 0 for c in tcr.number_columns(("TRA", "TRB"))}
    table = frame([("S", "AC", *cols.values())], "sample_id string, barcode_core string, " + ", ".join(f"{c} {'string' if v == '0' else 'int'}" for c, v in cols.items()))
    assert tcr.merge_receptors(obs, table).first()["TCRseq"] == "no"


def test_flags_from_upstream_text(frame):
    df = frame([("", "true", "B", "no"), ("A", "0", "", "Detected"), ("", "", "", "")], "TRA_cdr3 string, has_TRA string, TRB_cdr3 string, TCRseq string", 1)
    got = sorted((r["has_TRA_TRB_paired"], r["has_any_ab_tcr"], r["TCRseq"]) for r in tcr.receptor_flags(df).collect())
    assert got == [(False, False, "no"), (False, True, "yes"), (True, True, "yes")]


def test_productive_gd(contigs):
    assert [r["chain"] for r in tcr.productive_gd(contigs).collect()] == ["TRG"]


def test_wide_layout_falls_back_to_second_column(frame):
    wide = frame([(" S1", "x_AAAC-1", "nan", "second", "7", "bad")], "sample string, cell string, `a.1` string, `a.2` string, n1 string, n2 string", 1)
    fields = {"TRA_cdr3": ["a.1", "a.2"], "TRA_umis": ["n1"], "TRB_umis": ["n2"], "TRB_v": ["not_there"]}
    row = tcr.standardize_wide(wide, "sample", "cell", fields).first()
    assert (row["sample_id"], row["barcode_core"], row["TRA_cdr3"], row["TRA_umis"], row["TRB_umis"], row["TRB_v"]) == ("S1", "AAAC", "second", 7, 0, "")
