"""Clean-up of cells and genes."""

from pyspark.sql import functions as F

from cytoquilt.constants import REASON_PRIORITY
from cytoquilt.operators import cleanup
from cytoquilt.session import materialize
from workload import base as b
from workload.base import GROUP_PANELS, r6, register, rounded, s6, sql_list, with_ctes
from workload.extraction import PROFILE_CTES, SHARED, candidates

HITS = "(t_hits + gd_hits + nk_hits + nk_strong_hits)"
FIRST_SQL = f"""SELECT *, CASE WHEN contam_score >= 1.5 AND selection_reason = 'annotation_only' AND {HITS} = 0 AND t_score = 0
    AND gd_score = 0 AND nk_score = 0 THEN 'obvious_non_tnk' WHEN contam_score >= 2.0 AND t_score >= 1.5 AND nk_score >= 1.5
    THEN 'high_conf_doublet' ELSE 'kept' END AS remove_reason FROM scaled"""
# the stand-in scores are on another scale; both sides stretch them the same way
STRETCH = {"contam_score": 3.0, "t_score": 2.0, "nk_score": 2.0}
SCALED_SQL = "SELECT * REPLACE (contam_score * 3.0::DOUBLE AS contam_score, t_score * 2.0::DOUBLE AS t_score, nk_score * 2.0::DOUBLE AS nk_score) FROM cand"


def stretched(spark, d):
    return candidates(spark, d).withColumns({c: F.col(c) * F.lit(k) for c, k in STRETCH.items()})


@register(
    "first_pass_cleanup",
    with_ctes(
        SHARED,
        """SELECT cell_id, gse_id, remove_reason = 'obvious_non_tnk' AS remove_off_target, remove_reason <> 'kept' AS remove,
        remove_reason FROM first""",
        {**PROFILE_CTES, "scaled": SCALED_SQL, "first": FIRST_SQL},
    ),
)
def first_pass_cleanup(spark, d):
    out = cleanup.first_pass_decisions(stretched(spark, d))
    return out.select("cell_id", "gse_id", "remove_off_target", "remove", "remove_reason")


GROUP_CTES = {
    "gl": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{g}')" for p, gs in GROUP_PANELS.items() for g in gs) + ") v(grp, symbol)",
    "gm": f"""SELECT symbol, gene FROM (SELECT symbol, gene, row_number() OVER (PARTITION BY symbol ORDER BY gene_pos) AS rn FROM gv
        WHERE symbol IN ({sql_list(sorted({g for gs in GROUP_PANELS.values() for g in gs}))})) WHERE rn = 1""",
    "gk": "SELECT grp, count(*) AS k FROM gl JOIN gm USING (symbol) GROUP BY 1",
    "gs": "SELECT c.cell_id, gl.grp, sum(c.count) AS s FROM counts c JOIN gm USING (gene) JOIN gl USING (symbol) GROUP BY 1, 2",
    "base_t": """SELECT o.cell_id, o.gse_id, coalesce(t.total, 0.0) AS total, coalesce(t.n_genes, 0) AS n_genes,
        coalesce(t.mt / greatest(t.total, 1.0), 0.0) AS pct_mt FROM obs o LEFT JOIN (SELECT cell_id, sum(count) AS total,
        count(*) AS n_genes, sum(CASE WHEN symbol LIKE 'cold%' THEN count ELSE 0 END) AS mt FROM counts JOIN gv USING (gene) GROUP BY 1) t
        USING (cell_id)""",
    "grp": "SELECT b.cell_id, b.gse_id, b.total, b.n_genes, b.pct_mt, "
    + ", ".join(
        f"coalesce(max(CASE WHEN gs.grp = '{p}' THEN ln(1 + 1e4 * (gs.s / gk.k) / greatest(b.total, 1.0)) END), 0.0) AS {p}_score"
        for p in GROUP_PANELS
    )
    + " FROM base_t b LEFT JOIN gs USING (cell_id) LEFT JOIN gk ON gk.grp = gs.grp GROUP BY 1, 2, 3, 4, 5",
}


def grouped(spark, d, cells):
    c = b.symbol_counts(spark, d)
    return cleanup.group_scores(cells, c, b.var(spark, d), GROUP_PANELS, mito=F.col("symbol").startswith("cold"))


@register(
    "off_target_scores",
    with_ctes(
        ["counts", "obs", "gv"],
        f"SELECT cell_id, gse_id, total, n_genes, {s6('pct_mt')} AS pct_mt, "
        + ", ".join(f"{s6(f'{p}_score')} AS {p}_score" for p in GROUP_PANELS)
        + " FROM grp",
        GROUP_CTES,
    ),
)
def off_target_scores(spark, d):
    out = grouped(spark, d, b.obs(spark, d).select("cell_id", "gse_id"))
    return rounded(out, "pct_mt", *[f"{p}_score" for p in GROUP_PANELS])


# cells here have a few genes, so quality is judged on blown-up numbers; same on both sides
SECOND_CTES = {
    "pair": "SELECT s.*, "
    + "g.pct_mt, "
    + ", ".join(f"g.{p}_score" for p in GROUP_PANELS)
    + """, s.n_genes * 60 AS ng, s.total * 4.0::DOUBLE AS tt, greatest(t_score, gd_score, nk_score) AS support FROM scaled s JOIN grp g ON g.cell_id = s.cell_id""",
    "top": "SELECT *, greatest(" + ", ".join(f"{p}_score" for p in GROUP_PANELS) + ") AS dominant_score FROM pair",
    "lab": "SELECT *, CASE "
    + " ".join(f"WHEN {p}_score = dominant_score THEN '{p}'" for p in GROUP_PANELS)
    + f" END AS dominant_label, support <= 0.75 AND {HITS} <= 1 AS weak FROM top",
    "reasons": f"""SELECT *, CASE WHEN ng < 100 OR tt < 150 OR (pct_mt >= 0.30 AND ng < 200) THEN 'low_quality'
        WHEN contam_score >= 1.75 AND support <= 0.5 AND {HITS} = 0 THEN 'extreme_phase1_contam'
        WHEN dominant_score >= 1.2 AND weak AND dominant_score >= support + 0.35 AND dominant_label = 'myeloid' THEN 'myeloid_conflict'
        WHEN dominant_score >= 1.2 AND weak AND dominant_score >= support + 0.35 AND dominant_label = 'bcell' THEN 'bcell_conflict'
        WHEN epithelial_score >= 1 AND weak AND epithelial_score >= support + 0.35 THEN 'epithelial_conflict'
        WHEN erythroid_score >= 1 AND weak AND erythroid_score >= support + 0.35 THEN 'erythroid_conflict'
        WHEN platelet_score >= 1 AND weak AND platelet_score >= support + 0.35 THEN 'platelet_conflict'
        ELSE 'kept' END AS remove_reason FROM lab""",
}
ALL_CTES = {**PROFILE_CTES, "scaled": SCALED_SQL, **GROUP_CTES, **SECOND_CTES}


def second(spark, d):
    cells = stretched(spark, d).drop("total", "n_genes")
    scored = grouped(spark, d, cells)
    scored = scored.withColumns({"n_genes": F.col("n_genes") * 60, "total": F.col("total") * 4.0})
    return cleanup.second_pass_reasons(scored)


@register(
    "second_pass_cleanup",
    with_ctes(
        SHARED,
        f"""SELECT cell_id, gse_id, {s6('support')} AS support, {HITS} AS total_hits, dominant_label,
        {s6('dominant_score')} AS dominant_score, remove_reason FROM reasons""",
        ALL_CTES,
    ),
)
def second_pass_cleanup(spark, d):
    out = second(spark, d).select(
        "cell_id", "gse_id", "support", "total_hits", "dominant_label", "dominant_score", "remove_reason"
    )
    return rounded(out, "support", "dominant_score")


@register(
    "cleanup_before_after",
    with_ctes(
        SHARED,
        f"""SELECT gse_id, count(*) AS cells_before, count(*) FILTER (remove_reason = 'kept') AS cells_after,
        count(*) FILTER (remove_reason <> 'kept') AS cells_removed,
        {s6("count(*) FILTER (remove_reason = 'kept') / count(*)")} AS retained_fraction FROM reasons GROUP BY 1""",
        ALL_CTES,
    ),
)
def cleanup_before_after(spark, d):
    return rounded(cleanup.before_after(second(spark, d)), "retained_fraction")


@register(
    "removal_reasons",
    with_ctes(SHARED, "SELECT remove_reason, count(*) AS cells FROM reasons GROUP BY 1", ALL_CTES),
)
def removal_reasons(spark, d):
    return cleanup.reason_counts(second(spark, d))


DETECT_SQL = """SELECT gene, count(*) AS cells_detected FROM counts JOIN (SELECT cell_id FROM obs WHERE status <> 'P') USING (cell_id) GROUP BY 1"""


@register(
    "gene_detection",
    with_ctes(
        ["counts", "obs", "gv"],
        """SELECT gv.gene, coalesce(d.cells_detected, 0) AS cells_detected, coalesce(d.cells_detected, 0) >= 20 AS keep_gene,
        gv.symbol IN ('red widget', 'hot rod') AS key_gene FROM gv LEFT JOIN d USING (gene)""",
        {"d": DETECT_SQL},
    ),
)
def gene_detection(spark, d):
    kept = b.obs(spark, d).where("status <> 'P'")
    seen = cleanup.cells_per_gene(b.counts(spark, d), kept)
    out = cleanup.gene_summary(b.var(spark, d), seen, 20, ("red widget", "hot rod"), "symbol")
    return out.select("gene", "cells_detected", "keep_gene", "key_gene")


@register(
    "detected_gene_counts",
    with_ctes(
        ["counts", "obs"],
        "SELECT cell_id, gene, count FROM counts WHERE gene IN (SELECT gene FROM d WHERE cells_detected >= 20)",
        {"d": DETECT_SQL},
    ),
)
def detected_gene_counts(spark, d):
    kept = b.obs(spark, d).where("status <> 'P'")
    c = b.counts(spark, d)
    summary = cleanup.gene_summary(b.var(spark, d), cleanup.cells_per_gene(c, kept), 20)
    return cleanup.keep_detected_genes(c, summary)


@register(
    "cleanup_summary",
    with_ctes(
        SHARED,
        "SELECT c.*, g.* FROM (SELECT count(*) AS cells_before, count(*) FILTER (remove_reason = 'kept') AS cells_after, "
        "count(*) FILTER (remove_reason <> 'kept') AS cells_removed_total, "
        + ", ".join(f"count(*) FILTER (remove_reason = '{r}') AS removed_{r}" for r in REASON_PRIORITY)
        + """ FROM reasons) c, (SELECT count(*) AS genes_before, count(*) FILTER (n >= 20) AS genes_after, count(*) FILTER (n < 20) AS genes_removed,
        20::BIGINT AS min_gene_cells, count(*) FILTER (n >= 20 AND symbol IN ('red widget', 'hot rod')) AS key_genes_kept,
        count(*) FILTER (n < 20 AND symbol IN ('red widget', 'hot rod')) AS key_genes_dropped
        FROM (SELECT gv.symbol, coalesce(x.n, 0) AS n FROM gv LEFT JOIN (SELECT gene, count(*) AS n FROM counts
        WHERE cell_id IN (SELECT cell_id FROM reasons WHERE remove_reason = 'kept') GROUP BY 1) x USING (gene))) g""",
        ALL_CTES,
    ),
)
def cleanup_summary(spark, d):
    cells = materialize(second(spark, d))
    kept = cells.where("remove_reason = 'kept'")
    seen = cleanup.cells_per_gene(b.counts(spark, d), kept)
    genes = cleanup.gene_summary(b.var(spark, d), seen, 20, ("red widget", "hot rod"), "symbol")
    return cleanup.cleanup_summary(cells, genes, REASON_PRIORITY, 20)


BAD_SQL = """SELECT l_orderkey AS cell_id, CASE WHEN l_returnflag = 'R' AND l_discount = 0.1 THEN -l_quantity
    WHEN l_returnflag = 'A' AND l_discount = 0 AND l_tax = 0 THEN 'NaN'::DOUBLE ELSE l_quantity END AS count FROM lineitem"""


@register(
    "value_sanity",
    with_ctes(
        [],
        f"""SELECT cell_id, CASE WHEN isnan(total) THEN NULL ELSE total END AS total, CASE WHEN bad AND total > 150 AND NOT isnan(total) THEN 'invalid_and_extreme'
        WHEN bad THEN 'invalid_matrix_values' WHEN total > 150 AND NOT isnan(total) THEN 'extreme_library_size' ELSE 'kept' END AS sanity_reason
        FROM (SELECT cell_id, sum(count) AS total, bool_or(isnan(count) OR isinf(count) OR count < 0) AS bad FROM m GROUP BY 1)""",
        {"m": BAD_SQL},
    ),
)
def value_sanity(spark, d):
    li = b.table(spark, d, "lineitem")
    value = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1), -F.col("l_quantity"))
        .when((F.col("l_returnflag") == "A") & (F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(float("nan")))
        .otherwise(F.col("l_quantity"))
    )
    out = cleanup.value_sanity(li.select(F.col("l_orderkey").alias("cell_id"), value.alias("count")), limit=150)
    return out.withColumn("total", F.when(~F.isnan("total"), F.col("total")))


@register(
    "count_space_filter",
    with_ctes(
        ["counts", "gv"],
        """SELECT cell_id, gene, count FROM s2 JOIN (SELECT cell_id FROM s2 GROUP BY 1
        HAVING 100.0 * sum(CASE WHEN symbol LIKE 'cold%' THEN count ELSE 0 END) / sum(count) < 20) USING (cell_id)""",
        {
            "s1": "SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM counts GROUP BY 1 HAVING count(*) >= 4)",
            "s2": "SELECT s1.*, gv.symbol FROM s1 JOIN gv USING (gene) WHERE gene IN (SELECT gene FROM s1 GROUP BY 1 HAVING count(*) >= 15)",
        },
    ),
)
def count_space_filter(spark, d):
    c = b.symbol_counts(spark, d)
    out = cleanup.count_space_filter(c, 4, 15, 20.0, mito=F.col("symbol").startswith("cold"))
    return out.select("cell_id", "gene", "count")
