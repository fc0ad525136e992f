"""Variable genes and the latent space."""

from pyspark.sql import functions as F

from cytoquilt.constants import NONCODING_CLONE, NONCODING_PREFIXES
from cytoquilt.operators import embedding, hvg, quantiles
from workload import base as b
from workload.base import r6, register, rounded, s6, with_ctes

NAME_SQL = """CASE WHEN type = 'PROMO' THEN 'mt-' || brand WHEN type = 'SMALL' THEN 'RPL' || size WHEN type = 'LARGE' AND size > 25 THEN 'AC0' || size
    WHEN type = 'LARGE' THEN 'Linc' || size WHEN type = 'MEDIUM' AND size > 40 THEN 'MRPS' || size ELSE symbol END"""
FLAG_CTES = {
    "nm": f"SELECT gene, upper({NAME_SQL}) AS u FROM gv",
    "fg": f"""SELECT gene, u LIKE 'MT-%' AS m, regexp_matches(u, '^(RPS|RPL|MRPS|MRPL)') AS r,
        regexp_matches(u, '^({'|'.join(NONCODING_PREFIXES)})') OR regexp_matches(u, '{NONCODING_CLONE}') AS n FROM nm""",
}


def named(spark, d):
    t, s = F.col("type"), F.col("size").cast("string")
    name = (
        F.when(t == "PROMO", F.concat(F.lit("mt-"), "brand"))
        .when(t == "SMALL", F.concat(F.lit("RPL"), s))
        .when((t == "LARGE") & (F.col("size") > 25), F.concat(F.lit("AC0"), s))
        .when(t == "LARGE", F.concat(F.lit("Linc"), s))
        .when((t == "MEDIUM") & (F.col("size") > 40), F.concat(F.lit("MRPS"), s))
        .otherwise(F.col("symbol"))
    )
    return b.var(spark, d).withColumn("name", name)


@register(
    "variable_gene_exclusion",
    with_ctes(
        ["gv"],
        """SELECT gene, m OR r OR n AS exclude_from_hvg, m AS exclude_mitochondrial, r AS exclude_ribosomal, n AS exclude_noncoding_like,
        concat_ws(',', CASE WHEN m THEN 'mitochondrial' END, CASE WHEN r THEN 'ribosomal' END, CASE WHEN n THEN 'noncoding_like' END) AS exclude_reason FROM fg""",
        FLAG_CTES,
    ),
)
def variable_gene_exclusion(spark, d):
    out = hvg.exclusion_table(named(spark, d), "name")
    return out.select("gene", "exclude_from_hvg", "exclude_mitochondrial", "exclude_ribosomal", "exclude_noncoding_like", "exclude_reason")


@register(
    "variable_gene_exclusion_summary",
    with_ctes(
        ["gv"],
        """SELECT count(*) AS genes_total, count(*) FILTER (NOT (m OR r OR n)) AS genes_allowed, count(*) FILTER (m OR r OR n) AS genes_excluded_total,
        count(*) FILTER (m) AS genes_excluded_mitochondrial, count(*) FILTER (r) AS genes_excluded_ribosomal, count(*) FILTER (n) AS genes_excluded_noncoding_like,
        100::BIGINT AS hvgs_selected FROM fg""",
        FLAG_CTES,
    ),
)
def variable_gene_exclusion_summary(spark, d):
    return hvg.exclusion_summary(hvg.exclusion_table(named(spark, d), "name"), 100)


@register(
    "batch_moments",
    with_ctes(
        ["counts", "obs"],
        f"""SELECT tissue, gene, n, {s6('s1 / n')} AS mean, {s6('greatest((s2 - s1 * (s1 / n)) / (n - 1), 0.0)')} AS variance FROM (SELECT tissue, gene, sum(count) AS s1, sum(count * count) AS s2
        FROM counts JOIN obs USING (cell_id) GROUP BY 1, 2) JOIN (SELECT tissue, count(*) AS n FROM obs GROUP BY 1) USING (tissue)""",
    ),
)
def batch_moments(spark, d):
    return rounded(hvg.batch_moments(b.counts(spark, d), b.obs(spark, d), "tissue"), "mean", "variance")


@register("variable_genes")
def variable_genes(spark, d):
    """No SQL: the mean-variance trend is a local regression (checked against NumPy in the tests)."""
    return hvg.select_variable_genes(b.counts(spark, d), b.obs(spark, d), named(spark, d), "tissue", 100, symbol="name")


LATENT_CTES = {
    "ex": "SELECT vec_id, label % 3 AS batch, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings",
    "ce": "SELECT vec_id, batch, i, x - avg(x) OVER (PARTITION BY batch, i) AS x FROM ex",
}


def latent(spark, d, k):
    e = b.table(spark, d, "embeddings").withColumn("batch", F.pmod("label", F.lit(3)))
    return embedding.latent_space(e, "embedding", k, "batch")


@register("latent_space", with_ctes([], f"SELECT vec_id, {s6('sum(x * x)')} AS squared_norm, count(*) AS dims FROM ce GROUP BY 1", LATENT_CTES))
def latent_space(spark, d):
    """All components only turn the batch-centred vectors, so that each keeps its length."""
    length = F.aggregate("latent", F.lit(0.0), lambda a, x: a + x * x)
    return rounded(latent(spark, d, 64).select("vec_id", length.alias("squared_norm"), F.size("latent").cast("long").alias("dims")), "squared_norm")


@register(
    "latent_components",
    with_ctes(
        [],
        f"""SELECT count(DISTINCT vec_id) AS cells, {s6('sum(x * x)')} AS total, 0::DOUBLE AS largest_batch_mean, 0::DOUBLE AS largest_covariance, TRUE AS ordered FROM ce""",
        LATENT_CTES,
    ),
)
def latent_components(spark, d):
    """Components are uncorrelated, ordered by variance, centred in every batch, and carry the whole variance between them."""
    from cytoquilt.session import materialize

    rows = materialize(latent(spark, d, 64).select("vec_id", "batch", F.posexplode("latent").alias("i", "x")))
    own = rows.groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    means = rows.groupBy("batch", "i").agg(F.abs(F.avg("x")).alias("m"))
    pairs = rows.join(rows.select("vec_id", F.col("i").alias("j"), F.col("x").alias("y")), "vec_id").where("i < j")
    across = pairs.groupBy("i", "j").agg(F.abs(F.avg(F.col("x") * F.col("y"))).alias("c"))
    falling = own.agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a"))
    falling = falling.select(F.forall(F.sequence(F.lit(1), F.size("a") - 1), lambda k: F.get(F.col("a"), k - 1)["s"] >= F.get(F.col("a"), k)["s"] - 1e-9))
    return rows.agg(
        F.count_distinct("vec_id").alias("cells"), r6(F.sum(F.col("x") * F.col("x"))).alias("total"), r6(means.select(F.max("m")).scalar()).alias("largest_batch_mean"),
        r6(across.select(F.max("c")).scalar()).alias("largest_covariance"), falling.scalar().alias("ordered"),
    )


DISPERSION_CTES = {
    "tt": "SELECT cell_id, sum(count) AS total FROM counts GROUP BY 1",
    "sc": "SELECT gene, count * 1e4 / total AS x FROM counts JOIN tt USING (cell_id)",
    "mo": "SELECT gene, sum(x) / (SELECT count(*) FROM obs) AS mean, greatest((sum(x * x) - sum(x) * (sum(x) / (SELECT count(*) FROM obs))) / ((SELECT count(*) FROM obs) - 1), 0) AS variance FROM sc GROUP BY 1",
    "dp": "SELECT gene, round(mean, 9) AS mean, round(variance, 9) / round(mean, 9) AS dispersion FROM mo WHERE round(mean, 9) > 0",
    "ed": "SELECT list_sort(list_distinct(quantile_cont(mean, [" + ", ".join(str(i / 20) for i in range(1, 20)) + "]))) AS e FROM dp",
    "bi": "SELECT gene, dispersion, len(list_filter(e, lambda x: x < mean)) AS bin FROM dp, ed",
    "me": "SELECT *, abs(dispersion - median) AS away FROM (SELECT *, quantile_cont(dispersion, 0.5) OVER (PARTITION BY bin) AS median FROM bi)",
    "ma": "SELECT *, quantile_cont(away, 0.5) OVER (PARTITION BY bin) AS mad FROM me",
}


@register(
    "dispersion_ranks",
    with_ctes(
        ["counts", "obs"],
        f"SELECT gene, bin::INTEGER AS bin, {s6('dispersion', 4)} AS dispersion, CASE WHEN mad > 0 THEN {s6(f'(dispersion - median) / (mad * {hvg.MAD_SCALE})', 4)} WHEN away = 0 THEN 0.0 END AS disp_norm FROM ma",
        DISPERSION_CTES,
    ),
)
def dispersion_ranks(spark, d):
    """The ranking that takes over where no trend can be fitted."""
    m = hvg.whole_moments(b.counts(spark, d), b.obs(spark, d))
    out = hvg.normalized_dispersion(m.withColumns({"mean": F.round("mean", 9), "variance": F.round("variance", 9)}))
    return rounded(out.select("gene", "bin", "dispersion", "disp_norm"), "dispersion", "disp_norm", digits=4)


@register("embedding_clusters")
def embedding_clusters(spark, d):
    """No SQL: iterative clustering."""
    e = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    return embedding.embedding_clusters(e, "embedding", 10).select("vec_id", "leiden")


QS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
Q_SQL = "SELECT l_returnflag, " + ", ".join(f"{s6(f'quantile_cont(l_extendedprice, {p})')} AS {n}" for n, p in QS.items()) + " FROM lineitem GROUP BY 1"


@register("grouped_quantiles", Q_SQL)
def grouped_quantiles(spark, d):
    return rounded(quantiles.grouped_quantiles(b.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", QS), *QS)


WEIGHTED_SQL = "SELECT l_returnflag, " + ", ".join(f"{s6(f'quantile_cont(l_extendedprice, {p})')} AS {n}" for n, p in QS.items()) + (
    " FROM (SELECT l_returnflag, l_extendedprice, unnest(range(l_quantity::BIGINT)) AS _i FROM lineitem) GROUP BY 1"
)


@register("grouped_quantiles_histogram_path", WEIGHTED_SQL)
def grouped_quantiles_histogram_path(spark, d):
    """Every order line counts as often as its quantity, by its weight on one side and by rows on the other."""
    out = quantiles.grouped_quantiles(b.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", QS, weight="l_quantity")
    return rounded(out, *QS)
