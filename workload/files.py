"""Files and whole rule jobs: given tables are rendered into the shared folder in each format and read back by the sources."""

import json

from pyspark.sql import functions as F

from cytoquilt.operators import rules as R
from cytoquilt.operators.metadata import keep_first
from cytoquilt.operators.ordering import grouped_row_number, ranged
from cytoquilt.plans import jobs
from cytoquilt.session import materialize
from cytoquilt.sinks import writers
from cytoquilt.sources import series_matrix, tables, tenx
from cytoquilt.sources.files import glob_paths, rename
from workload import base as b
from workload.base import register, rounded, s6, with_ctes
from workload.jobs import folder
from workload.rules import DOC_SQL, NORM, OUT, RAW, RULES, RULESET, T_COLS, TISSUE_SQL, cells, chain_sql, tissue_cells
from workload.text import sql_clean


@register("registry_read", "SELECT '/data/' || n_name || '.h5ad' AS h5ad_path, n_name AS gse_id, r_name AS source_root FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry_read(spark, d):
    """A registry written as a sorted report of one file, read with its column check."""
    path = folder(spark, "registry")
    n = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.concat(F.lit("/data/"), "n_name", F.lit(".h5ad")).alias("h5ad_path"), F.col("n_name").alias("gse_id"), F.col("r_name").alias("source_root"))
    writers.write_report(n, path, ["gse_id"])
    return tables.read_registry(spark, path)


@register("milestone_cells", with_ctes(["obs"], "SELECT cell_id, tissue, gse_id FROM obs"))
def milestone_cells(spark, d):
    """A cell table that takes its place only after a check, of which three columns are read; its first version is backed up once."""
    path = folder(spark, "cells")
    obs = b.obs(spark, d)

    def whole(written):
        if written.count() != b.table(spark, d, "orders").count():
            raise ValueError("cells are missing")

    writers.write_milestone(obs.withColumn("tissue", F.lit("first")), path, whole, ["gse_id"])
    backed_up = writers.backup_once(spark, path, f"{path}.backup"), writers.backup_once(spark, path, f"{path}.backup")
    writers.write_milestone(obs, path, whole, ["gse_id"])
    if backed_up != (True, False) or spark.read.parquet(f"{path}.backup").where("tissue <> 'first'").limit(1).count():
        raise ValueError("the backup is not the first version")
    return tables.read_cells(spark, path, ["cell_id", "tissue", "gse_id"])


@register(
    "exported_metadata",
    """SELECT k, name, src_priority FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src_priority) AS rn FROM (SELECT c_custkey::VARCHAR AS k, c_name AS name, 0 AS src_priority FROM customer
    UNION ALL SELECT (s_suppkey * 31)::VARCHAR, s_name, 2 FROM supplier)) WHERE rn = 1""",
)
def exported_metadata(spark, d):
    """Two gzip exports and a missing one between them, stacked; the earlier source wins."""
    path = folder(spark, "exports")
    writers.write_export(b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), f"{path}/a")
    writers.write_export(b.table(spark, d, "supplier").select((F.col("s_suppkey") * 31).alias("k"), F.col("s_name").alias("name")), f"{path}/c")
    found = tables.read_metadata(spark, [f"{path}/a", f"{path}/b", f"{path}/c"])
    # the place of a source is its place in the list of those found
    places = F.when(F.col("src_priority") > 0, 2).otherwise(0)
    return keep_first(found, ["k"], ["src_priority", "row_ord"]).select("k", "name", places.alias("src_priority"))


@register("prepared_once", with_ctes(["obs"], "SELECT gse_id, count(*) AS n FROM obs GROUP BY 1"))
def prepared_once(spark, d):
    """The second call reads what the first has built."""
    path = folder(spark, "prepared")
    counted = b.obs(spark, d).groupBy("gse_id").agg(F.count(F.lit(1)).alias("n"))
    tables.prepared_or(spark, path, lambda: counted)

    def never():
        raise ValueError("built twice")

    return tables.prepared_or(spark, path, never)


def text_files(lines, path):
    """One text file per ``gse_id``, lines in order of ``ord``; (gse_id, file) on the driver, a row a dataset."""
    spark = lines.sparkSession
    lines.repartition("gse_id").sortWithinPartitions("gse_id", "ord").select("gse_id", "value").write.partitionBy("gse_id").text(path)
    return {p.split("gse_id=")[1].split("/")[0]: p for p in glob_paths(spark, [f"{path}/gse_id=*/part-*"])}


LIB_CTES = {
    "nm": "SELECT gene, CASE WHEN rn > 1 THEN symbol || '-' || (rn - 1) ELSE symbol END AS name FROM (SELECT gene, symbol, row_number() OVER (PARTITION BY symbol ORDER BY gene) AS rn FROM gv)",
    "lib": "SELECT o.gse_id AS sample, 'C' || c.cell_id || '-1' AS cell_id, nm.name AS gene, c.count FROM counts c JOIN obs o USING (cell_id) JOIN nm ON nm.gene = c.gene",
}


def library_manifest(spark, d):
    """Every dataset as a library of three files: coordinate matrix, barcodes, features; every other matrix is transposed."""
    from pyspark.sql import Window

    path = folder(spark, "libraries")
    obs = b.obs(spark, d).select("cell_id", "gse_id")
    numbered = materialize(obs.withColumn("n", F.row_number().over(Window.partitionBy("gse_id").orderBy("cell_id"))))
    genes = ranged(b.var(spark, d).select("gene", "symbol"), ["gene"], "_part")
    genes = materialize(grouped_row_number(genes, [], [F.col("gene")], F.col("_part"), "n").drop("_part"))
    barcodes = text_files(numbered.select("gse_id", F.col("n").alias("ord"), F.concat(F.lit("C"), "cell_id", F.lit("-1")).alias("value")), f"{path}/barcodes")
    sizes = materialize(numbered.groupBy("gse_id").agg(F.count(F.lit(1)).alias("nc")))
    datasets = sizes.select("gse_id")
    features = genes.select(F.col("n").alias("ord"), F.concat_ws("\t", F.concat(F.lit("E"), "gene"), "symbol", F.lit("Gene Expression")).alias("value"))
    every = F.explode(F.array(*[F.lit(r[0]) for r in datasets.collect()]))
    features = text_files(features.withColumn("gse_id", every), f"{path}/features")
    # the matrices and their sizes are both made of it
    counts = materialize(b.counts(spark, d).join(numbered, "cell_id").join(genes.select("gene", F.col("n").alias("g")), "gene").select("gse_id", "n", "g", "count"))
    turned = F.crc32(F.col("gse_id").cast("binary")) % 2 == 0
    pair = F.when(turned, F.concat_ws(" ", "n", "g")).otherwise(F.concat_ws(" ", "g", "n"))
    entries = counts.select("gse_id", F.lit(2).alias("ord"), F.concat_ws(" ", pair, "count").alias("value"))
    sizes = sizes.join(counts.groupBy("gse_id").agg(F.count(F.lit(1)).alias("nnz")), "gse_id")
    ng = F.lit(genes.count())
    size = F.when(turned, F.concat_ws(" ", "nc", ng, "nnz")).otherwise(F.concat_ws(" ", ng, "nc", "nnz"))
    heads = sizes.select("gse_id", F.lit(1).alias("ord"), size.alias("value")).unionByName(datasets.select("gse_id", F.lit(0).alias("ord"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value")))
    matrices = text_files(heads.unionByName(entries), f"{path}/matrices")
    rows = [(g, matrices[g], barcodes[g], features[g]) for g in sorted(matrices)]
    return spark.createDataFrame(rows, "sample string, matrix string, barcodes string, features string")


@register("library_counts", with_ctes(["counts", "obs", "gv"], "SELECT * FROM lib", LIB_CTES))
def library_counts(spark, d):
    return tenx.read_libraries(spark, library_manifest(spark, d))[0]


@register(
    "rebuilt_inputs",
    with_ctes(
        ["counts", "obs", "gv"],
        f"""SELECT sample, count(*) AS pairs, count(DISTINCT cell_id) AS cells, {s6('sum(count)', 2)} AS total FROM lib WHERE sample <> (SELECT min(gse_id) FROM obs) GROUP BY 1""",
        LIB_CTES,
    ),
)
def rebuilt_inputs(spark, d):
    """All libraries but one that failed, stacked under ids of their own."""
    failed = b.obs(spark, d).agg(F.min("gse_id").alias("sample"))
    counts, _ = tenx.rebuild_inputs(spark, library_manifest(spark, d), "REBUILT", failed)
    out = counts.groupBy("sample").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("cell_id").alias("cells"), F.sum("count").alias("total"))
    return rounded(out, "total", digits=2)


SERIES_SQL = """SELECT r_name AS gse_id, 'GSM' || n_nationkey AS gsm, n_name AS title, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' | key ' || n_nationkey END || ' | region: ' || r_name AS bundle
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


def series_files(spark, d):
    """One series-matrix file per region, its nations as samples, in the usual layout."""
    path = folder(spark, "series")
    n = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    source = F.when(F.col("n_nationkey") % 3 == 0, F.lit("nan")).otherwise(F.concat(F.lit("key "), "n_nationkey"))
    fields = {"title": F.col("n_name"), "geo_accession": F.concat(F.lit("GSM"), "n_nationkey"), "source_name_ch1": source, "characteristics_ch1": F.concat(F.lit("region: "), "r_name")}
    rows = n.select(F.col("r_name").alias("gse_id"), "n_nationkey", F.posexplode(F.array(*[F.struct(F.lit(k).alias("k"), quoted(v).alias("v")) for k, v in fields.items()])).alias("ord", "f"))
    # a region has a handful of nations
    lines = rows.groupBy("gse_id", "ord", "f.k").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "f.v"))).alias("cells"))
    lines = lines.select("gse_id", "ord", F.concat(F.lit("!Sample_"), "k", F.lit("\t"), F.array_join("cells.v", "\t")).alias("value"))
    root = f"{path}/downloads"
    for gse, file in text_files(lines, f"{path}/lines").items():
        target = f"{root}/{gse}/metadata"
        spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(target))
        rename(spark, file, f"{target}/{gse}_series_matrix.txt")
    return series_matrix.discover(spark, root, [r[0] for r in n.select("r_name").distinct().collect()])


@register("series_bundles_read", SERIES_SQL)
def series_bundles_read(spark, d):
    return series_matrix.series_bundles(spark, series_files(spark, d)).select("gse_id", "gsm", "title", "bundle")


RULE_COLUMNS = ["doc_id", "source_gse_id", OUT, f"{OUT}_source", f"{OUT}_reason"]


@register("rules_from_file", with_ctes([], f"SELECT {', '.join(RULE_COLUMNS)} FROM r", {"src": DOC_SQL, "r": RAW}))
def rules_from_file(spark, d):
    """The rule set goes through a JSON file and its check."""
    path = folder(spark, "rules")
    spark.createDataFrame([(json.dumps(RULESET),)], "value string").coalesce(1).write.text(path)
    rules = R.load_rules(spark, path)
    return R.apply_rules(cells(spark, d), rules, R.DISEASE, mode="raw").select(*RULE_COLUMNS)


@register("tissue_rules_normalized", with_ctes([], f"SELECT {', '.join(T_COLS)} FROM r", {"src": TISSUE_SQL, "r": chain_sql(R.TISSUE, "normalized", "_/|")}))
def tissue_rules_normalized(spark, d):
    return R.apply_rules(tissue_cells(spark, d), RULESET, R.TISSUE, mode="normalized").select(*T_COLS)


def rule_tables(spark, d):
    """Cells and their metadata by key: the fields that the rules read come by the join."""
    full = cells(spark, d)
    meta = full.select(F.col("doc_id").alias("metadata_key"), F.col("condition_meta").alias("condition"), "sample_type", "donor_patient")
    return full.drop("condition_meta", "sample_type", "donor_patient").withColumn("metadata_key", F.col("doc_id")), meta


@register(
    "rules_job_by_dataset",
    with_ctes(
        [],
        f"""SELECT source_gse_id, count(*) AS cell_n, count(*) FILTER ({sql_clean('condition_meta', RULES)} = '') AS original_blank, count(*) FILTER ({OUT} = 'unknown') AS corrected_unknown,
        count(DISTINCT {OUT}) AS unique_corrected FROM r GROUP BY 1""",
        {"src": DOC_SQL, "r": NORM},
    ),
)
def rules_job_by_dataset(spark, d):
    """The whole correction job: metadata join, rules on normalised text, report per dataset."""
    obs, meta = rule_tables(spark, d)
    return jobs.apply_rules(obs, meta, RULESET, R.DISEASE, fill=())["by_dataset"]


@register(
    "rules_review_job",
    with_ctes(
        [],
        f"""SELECT source_gse_id, count(*) AS cell_n, count(*) FILTER ({OUT} = 'unknown') AS unknown_cells, count(DISTINCT {OUT}) AS unique_{OUT}
        FROM (SELECT *, row_number() OVER (PARTITION BY source_gse_id ORDER BY md5(doc_id || '|7'), doc_id) AS rn FROM r) WHERE rn <= 12 GROUP BY 1""",
        {"src": DOC_SQL, "r": RAW},
    ),
)
def rules_review_job(spark, d):
    """The whole review job: a sample of each dataset, rules on raw text."""
    obs, meta = rule_tables(spark, d)
    rules = {**RULESET, "sample_per_gse": 12, "random_seed": 7}
    out = jobs.audit_rules(obs, meta, rules, R.DISEASE, cell="doc_id", fill=())["by_dataset"]
    return out.select("source_gse_id", "cell_n", "unknown_cells", f"unique_{OUT}")
