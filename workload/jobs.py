"""Whole jobs on the given tables."""

from pyspark.sql import functions as F

from cytoquilt.operators import hvg
from cytoquilt.plans import jobs
from cytoquilt.plans.intake import Repair
from cytoquilt.sinks import writers
from cytoquilt.sources import tables
from workload import base as b
from workload.base import register, rounded, s6, with_ctes
from workload.genes import DISPERSION_CTES

# two inputs: orders that are done and the others; the second has its counts in a layer beside halved values
BASE_SIZE = 25
PREP_CTES = {
    "bg": f"SELECT DISTINCT symbol AS gene FROM gv WHERE size <= {BASE_SIZE}",
    "fg": "SELECT symbol, min(gene) AS gene FROM gv WHERE symbol IN (SELECT gene FROM bg) GROUP BY 1",
    "inp": "SELECT *, CASE WHEN status = 'F' THEN 'done' ELSE 'rest' END AS alias FROM obs",
}


def prepared(spark, d):
    obs, var = b.obs(spark, d), b.var(spark, d)
    counts = b.counts(spark, d)

    def one(alias, mine, layered):
        cells = obs.where(mine).select(
            "cell_id", F.col("cell_id").alias("cell_pos"), F.col("tissue").alias("sample_id"), F.lit(alias).alias("source_gse_id"),
            F.when(F.col("price") > 100000, "CAA").alias("TRA_cdr3"), F.when(F.col("price") < 300000, "CBB").alias("TRB_cdr3"),
        )
        own = counts.join(cells.select("cell_id"), "cell_id", "left_semi")
        x = own.withColumns({"count": F.col("count") / (2 if layered else 1), "matrix": F.lit("X")})
        both = x.unionByName(own.withColumn("matrix", F.lit("layer:counts"))) if layered else x
        return jobs.PrepareInput(alias, both, cells, var, repair=Repair(always={"Sorted_gdT": "True"} if layered else {}))

    inputs = [one("done", F.col("status") == "F", False), one("rest", F.col("status") != "F", True)]
    base = var.where(f"size <= {BASE_SIZE}").select(F.col("symbol").alias("gene"))
    return jobs.prepare(inputs, base, ["brand", "symbol"])


@register(
    "prepared_stats",
    with_ctes(
        ["obs", "gv"],
        """SELECT alias, 'symbol' AS name_column, CASE alias WHEN 'done' THEN 'X_integer_like' ELSE 'layers[counts]' END AS count_matrix_source,
        count(*) AS n_cells, count(DISTINCT tissue) AS n_samples, count(*) FILTER (price > 100000 AND price < 300000) AS n_paired_ab, 0::BIGINT AS n_paired_gd,
        alias = 'rest' AS all_flagged, (SELECT count(*) FROM gv) AS n_genes_before_align, (SELECT count(*) FROM bg) AS n_genes_after_align, 0::BIGINT AS n_missing_vs_base
        FROM inp GROUP BY alias""",
        PREP_CTES,
    ),
)
def prepared_stats(spark, d):
    return prepared(spark, d)["stats"].withColumn("all_flagged", F.coalesce("all_flagged", F.lit(False)))


@register(
    "prepared_counts",
    with_ctes(
        ["counts", "obs", "gv"],
        "SELECT i.alias, c.cell_id, fg.symbol AS gene, c.count FROM counts c JOIN inp i USING (cell_id) JOIN fg ON fg.gene = c.gene",
        PREP_CTES,
    ),
)
def prepared_counts(spark, d):
    return prepared(spark, d)["counts"]


INTEGRATE_CTES = {
    **DISPERSION_CTES,
    "ra": f"SELECT ma.gene, CASE WHEN mad > 0 THEN (dispersion - median) / (mad * {hvg.MAD_SCALE}) WHEN away = 0 THEN 0.0 END AS v, gv.symbol FROM ma JOIN gv USING (gene)",
    "hv": "SELECT gene FROM ra WHERE v IS NOT NULL ORDER BY round(v, 6) DESC, gene LIMIT 200",
    "sz": "SELECT gse_id, leiden, count(*) AS cells FROM obs GROUP BY 1, 2",
    "s1": "SELECT *, least(cells, greatest(1, least(40, floor(3000 * cells / (SELECT sum(cells) FROM sz)))))::BIGINT AS t FROM sz",
    "s2": "SELECT *, CASE WHEN (SELECT sum(t) FROM s1) > 3000 THEN least(cells, greatest(1, floor(t * (3000.0::DOUBLE / (SELECT sum(t) FROM s1)))))::BIGINT ELSE t END AS t2 FROM s1",
    "s3": """SELECT gse_id, leiden, CASE WHEN t2 > 1 AND row_number() OVER (PARTITION BY t2 <= 1 ORDER BY t2 DESC, gse_id, leiden) <= (SELECT sum(t2) FROM s2) - 3000
        THEN t2 - 1 ELSE t2 END AS want FROM s2""",
    "tr": """SELECT cell_id FROM (SELECT o.cell_id, s.want, row_number() OVER (PARTITION BY o.gse_id, o.leiden ORDER BY md5(o.cell_id || '|0'), o.cell_id) AS rn
        FROM obs o JOIN s3 s ON s.gse_id = o.gse_id AND s.leiden = o.leiden) WHERE rn <= want""",
}


def integrated(spark, d):
    return jobs.integrate(b.counts(spark, d), b.obs(spark, d), b.var(spark, d), "gse_id", ["gse_id", "leiden"], 200, 3000, 40, symbol="symbol", trend=False)


@register(
    "integrated_summary",
    with_ctes(
        ["counts", "obs", "gv"],
        """SELECT (SELECT count(*) FROM gv) AS genes_total, (SELECT count(*) FROM gv) AS genes_allowed, 0::BIGINT AS genes_excluded_total, 0::BIGINT AS genes_excluded_mitochondrial,
        0::BIGINT AS genes_excluded_ribosomal, 0::BIGINT AS genes_excluded_noncoding_like, 200::BIGINT AS hvgs_selected, (SELECT count(*) FROM obs) AS cells_total,
        (SELECT count(*) FROM tr) AS cells_training, (SELECT count(DISTINCT gse_id) FROM obs JOIN tr USING (cell_id)) AS batches""",
        INTEGRATE_CTES,
    ),
)
def integrated_summary(spark, d):
    return integrated(spark, d)["summary"]


@register(
    "integrated_counts",
    with_ctes(["counts", "obs", "gv"], "SELECT cell_id, gene, count FROM counts SEMI JOIN tr USING (cell_id) SEMI JOIN hv USING (gene)", INTEGRATE_CTES),
)
def integrated_counts(spark, d):
    return integrated(spark, d)["counts"]


def folder(spark, name):
    import uuid

    from cytoquilt.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


@register(
    "datasets_written_again",
    with_ctes(
        ["counts", "obs", "dcounts"],
        f"""SELECT gse_id, count(*) AS pairs, {s6('sum(CASE WHEN gse_id IN (SELECT min(gse_id) FROM obs) THEN 2 * count ELSE count END)', 2)} AS total,
        CASE WHEN gse_id IN (SELECT min(gse_id) FROM obs) THEN 2 ELSE 1 END AS write FROM dcounts GROUP BY 1""",
    ),
)
def datasets_written_again(spark, d):
    """All datasets are written, then the first one again with doubled counts; the others stay, and the record tells the writes apart."""
    path = folder(spark, "datasets")
    counts = b.dataset_counts(spark, d).select("cell_id", "gene", "count", "gse_id")
    writers.write_by_dataset(counts, path)
    first = b.obs(spark, d).agg(F.min("gse_id").alias("gse_id"))
    again = counts.join(F.broadcast(first), "gse_id").withColumn("count", F.col("count") * 2).select("cell_id", "gene", "count", "gse_id")
    second = writers.write_by_dataset(again, path).select("dataset", F.col("write_id").alias("second"))
    log = writers.dataset_commits(spark, path).join(second, "dataset", "left")
    log = log.select(F.col("dataset").alias("gse_id"), "rows", F.when(F.col("write_id") == F.col("second"), 2).otherwise(1).alias("write"))
    read = tables.read_counts(spark, path).groupBy("gse_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("count").alias("total"))
    out = read.join(log, "gse_id").where("rows = pairs").drop("rows")
    return rounded(out, "total", digits=2)
