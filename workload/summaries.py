"""Grouped reports."""

from pyspark.sql import functions as F

from cytoquilt.operators import summaries as S
from cytoquilt.operators.sampling import fixed_sample
from workload import base as b
from workload.base import register, rounded, s6, with_ctes

OBS = ["obs"]
FLAG_SQL = """SELECT cell_id, gse_id, CASE WHEN tissue = 'ASIA' THEN 'NA' WHEN tissue = 'EUROPE' THEN '' ELSE tissue END AS tissue, status = 'F' AND price > 300000 AS sorted, status = 'O' AS ab, price > 350000 AS gd,
    status = 'O' OR price < 50000 AS any_ab, price / 5e5 - 0.3 AS diff, CASE WHEN leiden LIKE '1%' THEN 'gdT_cell' WHEN leiden LIKE '2%' THEN 'NK_cell' ELSE 'CD8_T' END AS label FROM obs"""
CRIT_SQL = "SELECT *, ab AND gd AS dbl, sorted AS a, gd AND NOT (ab AND gd) AS b, diff > 0.4 AND NOT any_ab AND label <> 'NK_cell' AS c FROM fl"
CTES = {"fl": FLAG_SQL, "cr": CRIT_SQL}


def cells(spark, d):
    o = b.obs(spark, d)
    return o.select(
        "cell_id", "gse_id",
        F.when(F.col("tissue") == "ASIA", "NA").when(F.col("tissue") == "EUROPE", "").otherwise(F.col("tissue")).alias("tissue"),
        ((F.col("status") == "F") & (F.col("price") > 300000)).alias("Sorted_gdT"),
        (F.col("status") == "O").alias("has_TRA_TRB_paired"),
        (F.col("price") > 350000).alias("has_TRG_TRD_paired"),
        ((F.col("status") == "O") | (F.col("price") < 50000)).alias("has_any_ab_tcr"),
        (F.col("price") / 5e5 - 0.3).alias("trd_minus_trab"),
        F.when(F.col("leiden").startswith("1"), "gdT_cell").when(F.col("leiden").startswith("2"), "NK_cell").otherwise("CD8_T").alias("simple_annotation"),
    )


THR_SQL = f"""SELECT gse_id, count(*) AS total_cells, count(*) FILTER (diff > 0.6) AS positive_cells, {s6('count(*) FILTER (diff > 0.6) / count(*)')} AS positive_fraction_within_group,
    {s6('count(*) FILTER (diff > 0.6) / (SELECT count(*) FROM fl WHERE diff > 0.6)')} AS share_of_all_positive_cells FROM fl GROUP BY 1"""


def threshold(spark, d):
    return S.threshold_by_group(cells(spark, d), "gse_id", F.col("trd_minus_trab") > 0.6)


@register("threshold_by_dataset", with_ctes(OBS, THR_SQL, CTES))
def threshold_by_dataset(spark, d):
    return rounded(threshold(spark, d), "positive_fraction_within_group", "share_of_all_positive_cells")


@register(
    "threshold_overview",
    with_ctes(
        OBS,
        f"""SELECT 'gap > 0.6' AS metric_name, sum(positive_cells)::BIGINT AS total_positive_cells, count(*) AS n_groups, count(*) FILTER (positive_cells > 0) AS n_groups_with_positive,
        {s6('avg(positive_cells)')} AS mean_per_group, quantile_cont(positive_cells, 0.5)::DOUBLE AS median_per_group, max(positive_cells) AS max_in_one_group FROM ({THR_SQL})""",
        CTES,
    ),
)
def threshold_overview(spark, d):
    return rounded(S.threshold_overview(threshold(spark, d), "gap > 0.6"), "mean_per_group")


@register("selected_by_tissue", with_ctes(OBS, "SELECT tissue, count(*) AS n_cells FROM fl WHERE diff < -0.2 GROUP BY 1", CTES))
def selected_by_tissue(spark, d):
    return S.selected_by_group(cells(spark, d), "tissue", F.col("trd_minus_trab") < -0.2)


@register("gdt_criteria", with_ctes(OBS, "SELECT cell_id, dbl AS doublet, a AS criterion_a, b AS criterion_b, c AS criterion_c, a OR b OR c AS any_three FROM cr", CTES))
def gdt_criteria(spark, d):
    return S.gdt_criteria(cells(spark, d)).select("cell_id", "doublet", "criterion_a", "criterion_b", "criterion_c", "any_three")


STAT = {
    "total_cells": "TRUE", "sorted_gdT_true": "a", "paired_TRG_TRD_not_doublet": "b", "score_gap_no_ab_not_NK": "c", "doublet_proxy": "dbl",
    "union_any_of_three": "a OR b OR c", "gdT_annotated": "label = 'gdT_cell'", "gdT_annotated_paired_TRG_TRD": "label = 'gdT_cell' AND gd",
    "gdT_annotated_any_of_three": "label = 'gdT_cell' AND (a OR b OR c)",
}
REGION = {
    "a_only": "a AND NOT b AND NOT c", "b_only": "NOT a AND b AND NOT c", "c_only": "NOT a AND NOT b AND c", "a_and_b_only": "a AND b AND NOT c",
    "a_and_c_only": "a AND NOT b AND c", "b_and_c_only": "NOT a AND b AND c", "all_three": "a AND b AND c",
}


@register("gdt_statistics", with_ctes(OBS, " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) FILTER ({c}) AS value FROM cr" for n, c in STAT.items()), CTES))
def gdt_statistics(spark, d):
    return S.gdt_statistics(S.gdt_criteria(cells(spark, d)))


@register("gdt_overlap", with_ctes(OBS, " UNION ALL ".join(f"SELECT '{n}' AS category, count(*) FILTER ({c}) AS n_cells FROM cr" for n, c in REGION.items()), CTES))
def gdt_overlap(spark, d):
    return S.gdt_overlap(S.gdt_criteria(cells(spark, d)))


def _within(cond):
    return with_ctes(
        OBS,
        f"""SELECT CASE WHEN lower(tissue) IN ('', 'nan', 'none', 'na') THEN 'unknown' ELSE tissue END AS tissue, count(*) AS subset_cells, count(*) FILTER ({cond}) AS meeting,
        {s6(f'count(*) FILTER ({cond}) / count(*)')} AS fraction FROM cr WHERE label = 'gdT_cell' GROUP BY 1""",
        CTES,
    )


@register("paired_within_gdt", _within("gd"))
def paired_within_gdt(spark, d):
    c = S.gdt_criteria(cells(spark, d))
    return rounded(S.fraction_within(c, "tissue", F.col("simple_annotation") == "gdT_cell", F.col("has_TRG_TRD_paired")), "fraction")


@register("criteria_within_gdt", _within("a OR b OR c"))
def criteria_within_gdt(spark, d):
    c = S.gdt_criteria(cells(spark, d))
    return rounded(S.fraction_within(c, "tissue", F.col("simple_annotation") == "gdT_cell", F.col("any_three")), "fraction")


@register(
    "sampled_pairing",
    with_ctes(
        OBS,
        """SELECT count(*) AS sampled_cells, count(*) FILTER (ab) AS paired_ab, count(*) FILTER (gd) AS paired_gd, count(*) FILTER (ab AND gd) AS paired_both
        FROM (SELECT *, row_number() OVER (ORDER BY md5(cell_id || '|1'), cell_id) AS rn FROM fl) WHERE rn <= 4000""",
        CTES,
    ),
)
def sampled_pairing(spark, d):
    return S.pairing_counts(fixed_sample(cells(spark, d), 4000, ["cell_id"], 1))


@register(
    "equal_width_histogram",
    """SELECT least(coalesce(floor((o_totalprice - lo) / ((hi - lo) / 100)), 0), 99)::INTEGER AS bin, count(*) AS n FROM orders,
    (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""",
)
def equal_width_histogram(spark, d):
    return S.equal_width_histogram(b.table(spark, d, "orders"), "o_totalprice", 100)


@register(
    "log_histogram",
    """SELECT least(floor(log10(greatest(n, 1.0)) / top * 59), 58)::INTEGER AS bin, count(*) AS n FROM (SELECT l_partkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
    (SELECT log10(greatest(max(n), 500.0)) AS top FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_partkey)) GROUP BY 1""",
)
def log_histogram(spark, d):
    n = b.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_cells"))
    return S.log_histogram(n, "n_cells")


@register("scope_metrics", with_ctes(OBS, "SELECT count(*) AS total_cells, count(DISTINCT tissue) AS tissues, count(DISTINCT gse_id) AS gses, count(DISTINCT leiden) AS clusters FROM obs"))
def scope_metrics(spark, d):
    return S.scope_metrics(b.obs(spark, d), {"tissues": "tissue", "gses": "gse_id", "clusters": "leiden"})


@register(
    "prep_stats",
    with_ctes(
        OBS,
        """SELECT gse_id, count(*) AS n_cells, count(*) FILTER (ab) AS n_paired_ab, count(*) FILTER (gd) AS n_paired_gd, bool_and(sorted) AS all_flagged,
        count(DISTINCT nullif(tissue, '')) AS n_samples FROM fl GROUP BY 1""",
        CTES,
    ),
)
def prep_stats(spark, d):
    c = cells(spark, d).withColumn("flag", F.col("Sorted_gdT").cast("string"))
    return S.prep_stats(c, "gse_id", "tissue", "has_TRA_TRB_paired", "has_TRG_TRD_paired", "flag")


@register(
    "missing_genes",
    with_ctes(
        ["counts", "obs", "gv", "dcounts", "dvar"],
        """SELECT gse_id, count(*) FILTER (size <= 25) AS n_shared, (SELECT count(*) FROM gv WHERE size <= 25) - count(*) FILTER (size <= 25) AS n_missing FROM dvar GROUP BY 1""",
    ),
)
def missing_genes(spark, d):
    return S.missing_genes(b.var(spark, d).where("size <= 25"), b.dataset_var(spark, d), "gse_id")


@register(
    "build_summary",
    with_ctes(
        ["counts", "obs", "gv", "dcounts", "dvar"],
        """SELECT gse_id, n_obs, tcr_yes_cells, samples, libraries, n_vars FROM (SELECT gse_id, count(*) AS n_obs, count(*) FILTER (status = 'F') AS tcr_yes_cells,
        count(DISTINCT nullif(sample_id, '')) AS samples, count(DISTINCT nullif(trim(library_id), '')) AS libraries FROM obs GROUP BY 1) JOIN (SELECT gse_id, count(*) AS n_vars FROM dvar GROUP BY 1) USING (gse_id)""",
    ),
)
def build_summary(spark, d):
    o = b.obs(spark, d).withColumn("TCRseq", F.when(F.col("status") == "F", "Yes").otherwise("no"))
    return S.build_summary(o, b.dataset_var(spark, d), "gse_id")


@register("value_counts", with_ctes(OBS, "SELECT annotation, count(*) AS cell_n FROM obs GROUP BY 1"))
def value_counts(spark, d):
    return S.value_counts(b.obs(spark, d), "annotation")


@register("display_top", with_ctes(OBS, "SELECT gse_id, count(*) AS cell_n FROM obs GROUP BY 1 ORDER BY cell_n DESC, gse_id LIMIT 20"))
def display_top(spark, d):
    return S.display_top(S.value_counts(b.obs(spark, d), "gse_id"), "cell_n", "gse_id", 20)
