import gzip
import json

import pytest
from pyspark.sql import functions as F

from cytoquilt.operators import rules as R
from cytoquilt.sinks import writers
from cytoquilt.sources import series_matrix, tables, tenx

MTX = "%%MatrixMarket matrix coordinate integer general\n%made up\n3 2 4\n1 1 5\n2 1 1\n3 2 2\n1 2 0\n"
FEATURES = "ENSG1\tTRAC\tGene Expression\nENSG2\tTRAC\tGene Expression\nAB1\tCD3\tAntibody Capture\n"


def write(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    if zipped:
        with gzip.open(path, "wt") as h:
            h.write(text)
    else:
        path.write_text(text)
    return str(path)


@pytest.mark.parametrize("zipped", [False, True])
def test_triplet_orientation_and_features(spark, tmp_path, zipped):
    end = ".gz" if zipped else ""
    m = write(tmp_path / f"m.mtx{end}", MTX, zipped)
    t = write(tmp_path / f"t.mtx{end}", "%%MatrixMarket\n2 3 3\n1 1 5\n1 2 1\n2 3 2\n", zipped)
    f = write(tmp_path / f"f.tsv{end}", FEATURES, zipped)
    c = write(tmp_path / f"b.tsv{end}", "AAAC-1\nAAAG-1\n", zipped)
    for path in (m, t):
        counts, cells, genes = tenx.read_triplet(spark, path, c, f)
        assert sorted(tuple(r) for r in counts.select("cell_id", "gene", "count").collect()) == [("AAAC-1", "TRAC", 5.0), ("AAAC-1", "TRAC-1", 1.0)]
        assert cells.count() == 2 and [r["gene"] for r in genes.orderBy("gene_pos").collect()] == ["TRAC", "TRAC-1"]
    with pytest.raises(ValueError):
        tenx.read_triplet(spark, write(tmp_path / "x.mtx", "%\n5 5 1\n1 1 1\n"), c, f)


def test_entry_that_reads_like_the_size_line(spark, tmp_path):
    entries, sizes = tenx.matrix_entries(spark, write(tmp_path / "one.mtx", "%%MatrixMarket\n1 1 1\n1 1 1\n"))
    assert [tuple(x)[1:] for x in sizes.collect()] == [(1, 1)]
    assert [tuple(x)[1:] for x in entries.collect()] == [(1, 1, 1.0)]


def test_files_in_many_splits_are_scanned_once(spark, tmp_path):
    """Lines are numbered over splits and entries parsed without a second text scan, and no line is moved for its number."""
    listed = write(tmp_path / "b.tsv", "".join(f"cell{i}\n" if i % 7 else "\n" for i in range(300)))
    matrix = write(tmp_path / "m.mtx", "%c\n" * 40 + "  3\t2  300\n" + "".join(f"{1 + i % 3} {1 + i % 2}{' ' * (1 + i % 3)}{i + 1}\n" for i in range(299)) + "3 2 300\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        lines = tenx.numbered_lines(spark, listed)
        entries, sizes = tenx.matrix_entries(spark, matrix)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.number, r.line) for r in lines.collect()) == [(i + 1, f"cell{i}") for i in range(300) if i % 7]
    assert [tuple(r)[1:] for r in sizes.collect()] == [(3, 2)]
    assert sorted(r["count"] for r in entries.collect()) == [float(i + 1) for i in range(300)]
    for df in (lines, entries):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "Exchange hashpartitioning" not in plan


def test_exported_payload(spark, tmp_path):
    write(tmp_path / "P_counts.mtx", "%\n2 1 2\n1 1 3\n2 1 4\n")
    write(tmp_path / "P_genes.tsv", "E1\tA\nE2\tB\n")
    write(tmp_path / "P_barcodes.tsv", "cell1\n")
    write(tmp_path / "P_metadata.csv", "id,sample\ncell1,S1\n")
    counts, cells, _ = tenx.read_exported(spark, str(tmp_path / "P"))
    assert sorted(tuple(r) for r in counts.select("gene", "count").collect()) == [("A", 3.0), ("B", 4.0)]
    assert cells.first()["sample"] == "S1"


def test_rebuild_skips_failed_libraries(spark, tmp_path):
    m, f, b = write(tmp_path / "m.mtx", MTX), write(tmp_path / "f.tsv", FEATURES), write(tmp_path / "b.tsv", "AAAC-1\nAAAG-1\n")
    manifest = spark.createDataFrame([(s, m, b, f) for s in ("s1", "s2", "s3")], "sample string, matrix string, barcodes string, features string")
    failed = spark.createDataFrame([("s2",)], "sample string")
    counts, cells = tenx.rebuild_inputs(spark, manifest, "G", failed)
    assert {r["sample"] for r in cells.collect()} == {"s1", "s3"} and counts.count() == 4
    assert cells.select("cell_id").distinct().count() == 4


def test_stale_paths_fall_back_by_name(spark):
    manifest = spark.createDataFrame([("/d/a/x.mtx",), ("/old/y.mtx",), ("/old/z.mtx",), ("/old/w.mtx",), ("/old/none.mtx",)], "path string")
    files = spark.createDataFrame(
        [("/d/a/x.mtx",), ("/n/y.mtx",), ("/n/raw/z.mtx",), ("/n/Filtered_1/z.mtx",), ("/n/b/w.mtx",), ("/n/a/w.mtx",)], "path string"
    )
    got = {r["path"]: r["resolved"] for r in tenx.resolve_inputs(manifest, files).collect()}
    assert got == {"/d/a/x.mtx": "/d/a/x.mtx", "/old/y.mtx": "/n/y.mtx", "/old/z.mtx": "/n/Filtered_1/z.mtx", "/old/w.mtx": "/n/a/w.mtx", "/old/none.mtx": None}


SERIES = (
    '!Series_title\t"x"\n!Sample_title\t"Donor A"\t"Donor B"\n!Sample_geo_accession\t"GSM1"\t"GSM2"\n!Sample_source_name_ch1\t"PBMC"\t"nan"\n'
    '!Sample_characteristics_ch1\t"Disease State: healthy"\t"disease state: "\n!Sample_characteristics_ch1\t"age: 4"\t"disease state: colitis"\n'
    '!Sample_characteristics_ch1\t"title: never"\t""\n!series_matrix_table_begin\n"ID_REF"\t1\t2\n'
)


def test_series_matrix_bundles_and_table(spark, tmp_path):
    root = tmp_path / "downloads"
    write(root / "GSE1" / "matrix" / "GSE1_series_matrix.txt.gz", SERIES, True)
    write(root / "GSE1" / "metadata" / "late_series_matrix.txt", '!Sample_geo_accession\t"GSM2"\n!Sample_title\t"Late"\n')
    paths = series_matrix.discover(spark, f"file:{root}", ["GSE1", "GSE2", ""])
    assert list(paths) == ["GSE1"] and len(paths["GSE1"]) == 2
    bundles = series_matrix.series_bundles(spark, paths)
    rows = [tuple(r) for r in bundles.orderBy("pos").select("gsm", "title", "bundle").collect()]
    assert rows == [
        ("GSM1", "Donor A", "Donor A | PBMC | Disease State: healthy | age: 4 | title: never"),
        ("GSM2", "Donor B", "Donor B | disease state: | disease state: colitis"),
        ("GSM2", "Late", "Late"),
    ]
    cells = spark.createDataFrame([("GSE1", "x GSM2")], "source_gse_id string, library_id string")
    assert R.attach_bundles(cells, bundles).first()["series_bundle"] == "Late"
    table = {r["sample"]: r["fields"] for r in series_matrix.sample_table(spark, paths["GSE1"][0], "GSE1").collect()}
    assert table[0]["disease_state"] == "healthy" and table[0]["title"] == "Donor A" and table[0]["age"] == "4"
    assert table[1]["disease_state"] == "colitis" and table[1]["characteristics_ch1_2"] == "disease state: colitis"


def test_registry_and_metadata(spark, tmp_path):
    ok = write(tmp_path / "r.csv", "h5ad_path,gse_id,source_root\n/a,G,/r\n")
    assert tables.read_registry(spark, ok).count() == 1
    with pytest.raises(ValueError):
        tables.read_registry(spark, write(tmp_path / "bad.csv", "gse_id\nG\n"))
    audit = write(tmp_path / "audit.csv", "gse_id,h5ad_path,category\nB,/b,A\nA,/a,A\nC,/c,C\n")
    assert [r[0] for r in tables.read_category_a(spark, audit).collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        tables.read_category_a(spark, write(tmp_path / "none.csv", "gse_id,h5ad_path,category\nC,/c,C\n"))
    one = write(tmp_path / "m1.csv", "k,a\n1,x\n1,y\n")
    two = write(tmp_path / "m2.csv", "k,b\n1,z\n2,w\n")
    meta = tables.read_metadata(spark, [one, str(tmp_path / "missing.csv"), two])
    from cytoquilt.operators.metadata import keep_first

    first = {r["k"]: (r["a"], r["b"]) for r in keep_first(meta, ["k"], ["src_priority", "row_ord"]).collect()}
    assert first == {"1": ("x", None), "2": (None, "w")}
    with pytest.raises(FileNotFoundError):
        tables.read_metadata(spark, [str(tmp_path / "missing.csv")])


def test_prepared_output_is_reused(spark, tmp_path):
    path, calls = str(tmp_path / "prep"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert tables.prepared_or(spark, path, build).count() == 3
    assert tables.prepared_or(spark, path, build).count() == 3 and calls == [1]


def test_pruning_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "counts")
    df = spark.createDataFrame([("A", "c", "g", 1.0), ("B", "c", "g", 2.0)], "gse_id string, cell_id string, gene string, count double")
    writers.write_by_dataset(df, path)
    read = tables.read_counts(spark, path, ["A"]).select("cell_id", "count")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gse_id" in plan or "PartitionFilters: [(gse_id" in plan
    assert "ReadSchema: struct<cell_id:string,count:double>" in plan and read.count() == 1
    assert tables.read_cells(spark, path, ["cell_id"]).columns == ["cell_id"]
    with pytest.raises(ValueError):
        tables.read_cells(spark, path, ["nope"])


def test_milestone_swap_and_failed_check(spark, tmp_path):
    path = str(tmp_path / "m")
    assert writers.write_milestone(spark.range(2), path).count() == 2

    def refuse(df):
        raise ValueError("shape")

    with pytest.raises(ValueError):
        writers.write_milestone(spark.range(9), path, refuse)
    assert spark.read.parquet(path).count() == 2
    assert writers.write_milestone(spark.range(5), path, lambda df: None).count() == 5
    assert writers.backup_once(spark, path, path + ".bak") and not writers.backup_once(spark, path, path + ".bak")
    assert not writers.backup_once(spark, str(tmp_path / "none"), path + ".bak2")


def test_reports_exports_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 3), ("c", 2)], "k string, n int")
    writers.write_report(df, str(tmp_path / "rep"), [F.desc("n"), "k"])
    files = list((tmp_path / "rep").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text() == "k,n\na,3\nc,2\nb,1\n"
    writers.write_export(df, str(tmp_path / "exp"))
    assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "exp").glob("part*"))
    record = writers.provenance(spark, "score", {"bins": 25}, {"trd": ["TRDC"]}, {"trd": {"min": 0, "max": 2}})
    writers.write_provenance(record, str(tmp_path / "prov"))
    got = json.loads(next((tmp_path / "prov").glob("*.json")).read_text())
    assert got["gene_sets"] == {"trd": ["TRDC"]} and got["ranges"]["trd"]["max"] == 2.0


def test_rules_file(spark, tmp_path):
    path = write(tmp_path / "rules.json", json.dumps({"global_regex_rules": []}))
    assert R.load_rules(spark, path) == {"global_regex_rules": []}


def test_contig_table_formats(spark, tmp_path):
    p = write(tmp_path / "c.tsv.gz", "barcode\tchain\nAC-1\tTRA\n", True)
    assert tenx.read_delimited(spark, p, "\t").first()["chain"] == "TRA"
