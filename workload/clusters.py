"""Cluster summaries, labels and label transfer."""

from pyspark.sql import functions as F

from cytoquilt.operators import clusters as C
from cytoquilt.operators import matrix, summaries, validate
from cytoquilt.session import materialize, materialize_bucketed
from workload import base as b
from workload.base import register, rounded, s6, sql_list, with_ctes

# the cells here hold few genes, so a cluster is a customer: a handful of cells each
GROUPS = {
    "gdt": ("hot widget", "hot bolt", "hot ring", "hot plate"),
    "treg": ("red rod", "red gizmo", "red gear", "red anvil", "red bolt"),
    "nk": ("old widget", "old bolt", "old ring", "old plate", "old rod", "old gizmo"),
    "tcell": ("blue widget", "blue bolt", "blue ring", "blue plate", "blue rod"),
    "cd4": ("new widget", "new bolt", "new ring", "new plate"),
    "cd8": ("cold widget", "cold bolt", "cold ring", "old plate"),
}
GENES = sorted({g for gs in GROUPS.values() for g in gs})
SHARED = ["counts", "obs", "gv", "totals"]
CELL_SQL = """SELECT cell_id, gse_id, tissue, 'C' || donor AS leiden, status = 'F' AND price > 100000 AS ab, status = 'P' AND price > 400000 AS gd, price / 1e6 AS trd_score,
    (CASE WHEN leiden LIKE '1%' THEN 0.05 ELSE price / 2e6 END)::DOUBLE AS trab_score FROM obs"""


def cells(spark, d):
    o = b.obs(spark, d)
    out = o.select(
        "cell_id", "gse_id", "tissue", F.concat(F.lit("C"), F.col("donor").cast("string")).alias("leiden"),
        ((F.col("status") == "F") & (F.col("price") > 100000)).alias("has_TRA_TRB_paired"),
        ((F.col("status") == "P") & (F.col("price") > 400000)).alias("has_TRG_TRD_paired"),
        (F.col("price") / 1e6).alias("trd_score"),
        F.when(F.col("leiden").startswith("1"), 0.05).otherwise(F.col("price") / 2e6).alias("trab_score"),
    )
    return out.withColumn("trd_minus_trab", F.col("trd_score") - F.col("trab_score"))


def symbol_values(spark, d):
    """Counts per cell and gene name, so that a name is one gene; written by cell, so that totals and joins by cell need no exchange."""
    n = b.count_parts(spark, d)
    li = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene"), "l_quantity")
    named = li.join(b.var(spark, d).select("gene", "symbol"), "gene").repartition(n, "cell_id")
    values = named.groupBy("cell_id", F.col("symbol").alias("gene")).agg(F.sum("l_quantity").alias("count"))
    return materialize_bucketed(values, ["cell_id"], n)


def name_panel(spark):
    return spark.createDataFrame([(g, g) for g in GENES], "gene string, panel_symbol string")


CLUSTER_CTES = {
    "cl": CELL_SQL,
    "cs": "SELECT *, trd_score - trab_score AS diff FROM cl",
    "sc": "SELECT cell_id, symbol AS gene, sum(count) AS count FROM counts JOIN gv USING (gene) GROUP BY 1, 2",
    "base_s": f"""SELECT leiden, count(*) AS n_cells, count(DISTINCT gse_id) AS n_gses, avg(ab::INT) AS paired_ab_fraction, avg(gd::INT) AS paired_gd_fraction,
        quantile_cont(trd_score, 0.5) AS trd_score_median, quantile_cont(trab_score, 0.5) AS trab_score_median, quantile_cont(diff, 0.5) AS trd_minus_trab_median FROM cs GROUP BY 1""",
    "dense": f"""SELECT c.leiden, g.gene, coalesce(ln(1 + 1e4 * s.count / t.total), 0) AS v FROM cs c CROSS JOIN (SELECT unnest([{sql_list(GENES)}]) AS gene) g
        LEFT JOIN sc s ON s.cell_id = c.cell_id AND s.gene = g.gene LEFT JOIN totals t ON t.cell_id = c.cell_id""",
    "med": "SELECT leiden, gene, quantile_cont(v, 0.5) AS m FROM dense GROUP BY 1, 2",
    "mk": "SELECT leiden, " + ", ".join(f"sum(CASE WHEN gene IN ({sql_list(gs)}) THEN m ELSE 0 END) / {len(gs)} AS {n}_marker_mean" for n, gs in GROUPS.items()) + " FROM med GROUP BY 1",
    "sm": "SELECT * FROM base_s JOIN mk USING (leiden)",
}
NUMBERS = ["paired_ab_fraction", "paired_gd_fraction", "trd_score_median", "trab_score_median", "trd_minus_trab_median"] + [f"{n}_marker_mean" for n in GROUPS]
# rules see rounded numbers on both sides, so a value on a threshold falls the same way
ROUND_SQL = "SELECT leiden, n_cells, n_gses, " + ", ".join(f"{s6(c)} AS {c}" for c in NUMBERS) + " FROM sm"
RULES_SQL = """SELECT *, paired_gd_fraction >= 0.1 OR (trd_score_median >= 0.12 AND trd_minus_trab_median >= 0.08 AND gdt_marker_mean >= 0.15) AS gdt_rule,
    nk_marker_mean >= 0.25 AND tcell_marker_mean < 0.1 AS nk_rule,
    tcell_marker_mean >= 0.1 AND treg_marker_mean >= 0.25 AND cd4_marker_mean >= cd8_marker_mean AND nk_marker_mean < 0.35 AS treg_rule,
    tcell_marker_mean >= 0.1 AND cd8_marker_mean >= cd4_marker_mean + 0.03 AS cd8_rule, tcell_marker_mean >= 0.08 AND cd4_marker_mean >= cd8_marker_mean AS cd4_rule,
    treg_marker_mean >= 0.18 AND tcell_marker_mean >= 0.1 AS old_treg FROM rs"""
LABEL_CTES = {
    **CLUSTER_CTES,
    "rs": ROUND_SQL,
    "ru": RULES_SQL,
    "lb": """SELECT *, CASE WHEN gdt_rule THEN 'gdT_cell' WHEN nk_rule THEN 'NK_cell' WHEN treg_rule THEN 'Treg' WHEN cd8_rule THEN 'CD8_T' WHEN cd4_rule THEN 'CD4_T' ELSE 'other' END AS label,
        CASE WHEN gdt_rule THEN 'gdT_cell' WHEN old_treg THEN 'Treg' WHEN nk_rule THEN 'NK_cell' WHEN cd8_rule THEN 'CD8_T' WHEN cd4_rule THEN 'CD4_T' ELSE 'other' END AS old_label FROM ru""",
}


def summary(spark, d, values=None):
    values = symbol_values(spark, d) if values is None else values
    totals = values.groupBy("cell_id").agg(F.sum("count").alias("total"))
    out = C.cluster_marker_summary(cells(spark, d), values, totals, name_panel(spark), "leiden", "gse_id", GROUPS)
    return rounded(out, *NUMBERS)


def labelled(spark, d, values=None):
    return materialize(C.classify_clusters(summary(spark, d, values)))


@register("cluster_marker_summary", with_ctes(SHARED, "SELECT * FROM rs", LABEL_CTES))
def cluster_marker_summary(spark, d):
    return summary(spark, d)


# a panel whose data lack one gene of each group, and all of one group
ABSENT = {"hot bolt", "red rod", "old rod", "new ring", *GROUPS["cd8"]}
PRESENT = {n: [g for g in gs if g not in ABSENT] for n, gs in GROUPS.items()}
PRESENT_CTES = {
    **CLUSTER_CTES,
    "mp": "SELECT leiden, " + ", ".join(
        f"coalesce(avg(m) FILTER (gene IN ({sql_list(gs)})), 0) AS {n}_marker_mean" if gs else f"0::DOUBLE AS {n}_marker_mean" for n, gs in PRESENT.items()
    ) + " FROM med GROUP BY 1",
}


@register(
    "cluster_means_of_present_genes",
    with_ctes(SHARED, "SELECT leiden, " + ", ".join(f"{s6(n + '_marker_mean')} AS {n}_marker_mean" for n in GROUPS) + " FROM mp", PRESENT_CTES),
)
def cluster_means_of_present_genes(spark, d):
    values = symbol_values(spark, d)
    totals = values.groupBy("cell_id").agg(F.sum("count").alias("total"))
    panel = name_panel(spark).where(~F.col("gene").isin(*sorted(ABSENT)))
    out = C.cluster_marker_summary(cells(spark, d), values, totals, panel, "leiden", "gse_id", GROUPS)
    means = [f"{n}_marker_mean" for n in GROUPS]
    return rounded(out, *means).select("leiden", *means)


@register("cluster_labels", with_ctes(SHARED, "SELECT leiden, gdt_rule, nk_rule, treg_rule, cd8_rule, cd4_rule, label FROM lb", LABEL_CTES))
def cluster_labels(spark, d):
    return labelled(spark, d).select("leiden", "gdt_rule", "nk_rule", "treg_rule", "cd8_rule", "cd4_rule", "label")


@register("label_changes", with_ctes(SHARED, "SELECT leiden, n_cells, old_label, label AS new_label, old_label <> label AS changed FROM lb", LABEL_CTES))
def label_changes(spark, d):
    s = labelled(spark, d)
    return C.label_changes(s, C.legacy_labels(s)).select("leiden", "n_cells", "old_label", "new_label", "changed")


@register("labelled_cells", with_ctes(SHARED, "SELECT cell_id, coalesce(label, 'other') AS label FROM cl LEFT JOIN lb USING (leiden)", LABEL_CTES))
def labelled_cells(spark, d):
    return C.label_cells(cells(spark, d), labelled(spark, d)).select("cell_id", "label")


@register(
    "labels_by_dataset",
    with_ctes(SHARED, "SELECT gse_id, label, count(*) AS n_cells FROM cl JOIN lb USING (leiden) GROUP BY 1, 2", LABEL_CTES),
)
def labels_by_dataset(spark, d):
    return summaries.label_crosstab(C.label_cells(cells(spark, d), labelled(spark, d)), ["gse_id", "label"])


@register(
    "treg_invariants",
    with_ctes(
        SHARED,
        """SELECT count(*) FILTER (old_label = 'Treg') AS treg_clusters, count(*) FILTER (old_label = 'Treg' AND cd8_marker_mean > cd4_marker_mean) AS cd8_above_cd4,
        count(*) FILTER (old_label = 'Treg' AND nk_marker_mean >= 0.35) AS nk_not_low FROM lb""",
        LABEL_CTES,
    ),
)
def treg_invariants(spark, d):
    s = summary(spark, d)
    return validate.treg_invariants(s.join(C.legacy_labels(s), "leiden"), "old_label")


@register("alphabetical_labels", with_ctes(["obs"], "SELECT leiden, min(annotation) AS old_label FROM obs GROUP BY 1"))
def alphabetical_labels(spark, d):
    return C.alphabetical_label(b.obs(spark, d), "leiden", "annotation")


DETECT_GENES = ("red widget", "hot rod", "old ring", "small plate")


@register(
    "detected_fraction",
    with_ctes(
        SHARED,
        f"""SELECT s.leiden, g.gene AS panel_symbol, s.n_cells, {s6('coalesce(h.n, 0) / greatest(s.n_cells, 1)')} AS detected_fraction FROM
        (SELECT leiden, count(*) AS n_cells FROM obs GROUP BY 1) s CROSS JOIN (SELECT unnest([{sql_list(DETECT_GENES)}]) AS gene) g
        LEFT JOIN (SELECT leiden, symbol, count(*) AS n FROM counts JOIN pm USING (gene) JOIN obs USING (cell_id) GROUP BY 1, 2) h ON h.leiden = s.leiden AND h.symbol = g.gene""",
        {"pm": f"SELECT symbol, min(gene) AS gene FROM gv WHERE symbol IN ({sql_list(DETECT_GENES)}) GROUP BY 1"},
    ),
)
def detected_fraction(spark, d):
    p = matrix.resolve_panel(b.var(spark, d), DETECT_GENES, exact=True)
    return rounded(C.detected_fraction(b.obs(spark, d), b.counts(spark, d), p, "leiden"), "detected_fraction")


@register(
    "expression_by_group",
    with_ctes(
        SHARED,
        f"""SELECT s.annotation, g.gene AS panel_symbol, s.n_cells, {s6('coalesce(h.s, 0) / s.n_cells')} AS mean_expr, {s6('coalesce(h.n, 0) / s.n_cells')} AS fraction_expressing FROM
        (SELECT annotation, count(*) AS n_cells FROM obs GROUP BY 1) s CROSS JOIN (SELECT unnest([{sql_list(DETECT_GENES)}]) AS gene) g
        LEFT JOIN (SELECT annotation, symbol, count(*) AS n, sum(ln(1 + 1e4 * count / greatest(total, 1.0))) AS s FROM counts JOIN pm USING (gene) JOIN obs USING (cell_id) JOIN totals USING (cell_id) GROUP BY 1, 2) h
        ON h.annotation = s.annotation AND h.symbol = g.gene""",
        {"pm": f"SELECT symbol, min(gene) AS gene FROM gv WHERE symbol IN ({sql_list(DETECT_GENES)}) GROUP BY 1"},
    ),
)
def expression_by_group(spark, d):
    p = matrix.resolve_panel(b.var(spark, d), DETECT_GENES, exact=True)
    c = b.counts(spark, d)
    totals = c.groupBy("cell_id").agg(F.sum("count").alias("total"))
    return rounded(C.expression_by_group(b.obs(spark, d), c, totals, p, "annotation"), "mean_expr", "fraction_expressing")


@register(
    "dot_table",
    with_ctes(
        SHARED,
        f"""SELECT d.leiden, d.gene AS panel_symbol, {s6('avg(v)')} AS mean_expr, {s6('avg((v > 0)::INT)')} AS fraction_expressing FROM dense d JOIN lb ON lb.leiden = d.leiden
        WHERE old_label <> label OR label IN ('Treg', 'CD8_T') GROUP BY 1, 2""",
        LABEL_CTES,
    ),
)
def dot_table(spark, d):
    values = symbol_values(spark, d)
    s = labelled(spark, d, values)
    chosen = C.dot_table_clusters(C.label_changes(s, C.legacy_labels(s)))
    totals = values.groupBy("cell_id").agg(F.sum("count").alias("total"))
    some = cells(spark, d).join(chosen, "leiden", "left_semi")
    out = C.expression_by_group(some, values, totals, name_panel(spark), "leiden")
    return rounded(out.drop("n_cells"), "mean_expr", "fraction_expressing")


@register("cluster_sizes", with_ctes(["obs"], f"SELECT leiden, count(*) AS cells, {s6('count(*) / (SELECT count(*) FROM obs)')} AS fraction FROM obs GROUP BY 1"))
def cluster_sizes(spark, d):
    return rounded(C.cluster_sizes(b.obs(spark, d)), "fraction")


@register("label_summary", with_ctes(["obs"], f"SELECT annotation, status, count(*) AS cells, {s6('avg(price)', 3)} AS mean_confidence FROM obs GROUP BY 1, 2"))
def label_summary(spark, d):
    return rounded(C.label_summary(b.obs(spark, d), ["annotation", "status"], "price"), "mean_confidence", digits=3)


@register(
    "dominant_labels",
    with_ctes(
        ["obs"],
        f"""SELECT gse_id, annotation, n AS dominant_label_cells, total AS cluster_cells, {s6('n / total')} AS dominant_label_fraction FROM (SELECT *, sum(n) OVER (PARTITION BY gse_id)::BIGINT AS total,
        row_number() OVER (PARTITION BY gse_id ORDER BY n DESC, annotation) AS rn FROM (SELECT gse_id, annotation, count(*) AS n FROM obs GROUP BY 1, 2)) WHERE rn = 1""",
    ),
)
def dominant_labels(spark, d):
    return rounded(C.dominant_label(b.obs(spark, d), "gse_id", ["annotation"]), "dominant_label_fraction")


@register(
    "cluster_label_crosstab",
    with_ctes(["obs"], "SELECT leiden, annotation, status, count(*) AS cells FROM obs GROUP BY 1, 2, 3"),
)
def cluster_label_crosstab(spark, d):
    return summaries.label_crosstab(b.obs(spark, d), ["leiden", "annotation", "status"], "cells")


# label transfer: vectors with an even first digit of their hash keep their label
EMB_CTES = {
    "em": """SELECT vec_id, embedding, CASE WHEN md5(vec_id::VARCHAR) < '8' THEN label END AS label, 0.5 + label / 20.0::DOUBLE AS conf FROM embeddings""",
    "ex": "SELECT vec_id, label, conf, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM em",
    "ce": "SELECT label, i, sum(x * greatest(conf, 1e-4)) / sum(greatest(conf, 1e-4)) AS c FROM ex WHERE label IS NOT NULL GROUP BY 1, 2",
    "ds": "SELECT e.vec_id, c.label, sum((e.x - c.c) * (e.x - c.c)) AS dist FROM ex e JOIN ce c USING (i) GROUP BY 1, 2",
    "rk": "SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS rn FROM ds",
    "two": "SELECT vec_id, max(label) FILTER (rn = 1) AS l, max(dist) FILTER (rn = 1) AS d1, max(dist) FILTER (rn = 2) AS d2 FROM rk GROUP BY 1",
}


def vectors(spark, d):
    e = b.table(spark, d, "embeddings")
    kept = F.md5(F.col("vec_id").cast("string")) < "8"
    return e.select(
        "vec_id", F.col("embedding").alias("vec"), F.when(kept, F.col("label")).alias("label"),
        (F.lit(0.5) + F.col("label") / F.lit(20.0)).alias("confidence"),
    )


@register(
    "label_transfer",
    with_ctes(
        [],
        f"""SELECT vec_id, CASE WHEN label IS NOT NULL THEN label ELSE l END::VARCHAR AS assigned_label, {s6('CASE WHEN label IS NOT NULL THEN conf ELSE 1 - d1 / greatest(d2, 1e-6) END')} AS assigned_confidence,
        CASE WHEN label IS NOT NULL THEN 'direct_subset_scANVI' ELSE 'latent_centroid_transfer' END AS transfer_method FROM em JOIN two USING (vec_id)""",
        EMB_CTES,
    ),
)
def label_transfer(spark, d):
    out = C.transfer_labels(vectors(spark, d))
    return rounded(out.select("vec_id", "assigned_label", "assigned_confidence", "transfer_method"), "assigned_confidence")


@register("label_centroids", with_ctes([], f"SELECT label, i AS dim, {s6('c')} AS value FROM ce", EMB_CTES))
def label_centroids(spark, d):
    c = C.label_centroids(vectors(spark, d), "vec", "label", "confidence")
    long = c.select("label", F.posexplode("centroid").alias("dim", "value"))
    return rounded(long.withColumn("dim", (F.col("dim") + 1).cast("long")), "value")


NEIGHBOUR_CTES = {
    "em": "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    "ds": "SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance FROM em a JOIN em b ON a.vec_id <> b.vec_id",
    "nn": "SELECT vec_id, neighbour, distance, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), neighbour) AS rank FROM ds QUALIFY rank <= 15",
}


def neighbours(spark, d):
    return C.nearest_neighbours(b.table(spark, d, "embeddings"), "vec_id", "embedding", 15)


@register("nearest_cells", with_ctes([], f"SELECT vec_id, neighbour, rank::INTEGER AS rank, {s6('distance')} AS distance FROM nn", NEIGHBOUR_CTES))
def nearest_cells(spark, d):
    return rounded(neighbours(spark, d), "distance")


ROUNDS = 4


def _community_ctes():
    out = {"lk": "SELECT DISTINCT u, v FROM (SELECT vec_id AS u, neighbour AS v FROM nn UNION ALL SELECT neighbour, vec_id FROM nn)", "l0": "SELECT DISTINCT u AS node, u AS label FROM lk"}
    for k in range(ROUNDS):
        out[f"v{k}"] = f"SELECT lk.u, l.label, count(*) AS n FROM lk JOIN l{k} l ON l.node = lk.v GROUP BY 1, 2"
        out[f"l{k + 1}"] = (
            f"SELECT v.u AS node, arg_min(v.label, (-v.n, v.label <> o.label, v.label)) AS label FROM v{k} v JOIN l{k} o ON o.node = v.u GROUP BY 1"
        )
    return out


@register(
    "neighbour_communities",
    with_ctes([], f"SELECT node AS vec_id, min(node) OVER (PARTITION BY label) AS community FROM l{ROUNDS}", {**NEIGHBOUR_CTES, **_community_ctes()}),
)
def neighbour_communities(spark, d):
    return C.neighbour_communities(neighbours(spark, d), "vec_id", ROUNDS)


@register(
    "integration_summary",
    with_ctes(
        ["obs"],
        f"""SELECT count(*) AS cells, {s6('avg(price)', 3)} AS mean_confidence, count(*) FILTER (annotation = 'MACHINERY') AS reference_other_cells,
        count(DISTINCT donor) AS batches, count(DISTINCT gse_id) AS gses, count(DISTINCT annotation) AS labels FROM obs""",
    ),
)
def integration_summary(spark, d):
    out = summaries.integration_summary(
        b.obs(spark, d), {"batches": "donor", "gses": "gse_id", "labels": "annotation"}, "price", F.col("annotation") == "MACHINERY"
    )
    return rounded(out, "mean_confidence", digits=3)
