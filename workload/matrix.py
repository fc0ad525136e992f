"""Count-matrix operators."""

from pyspark.sql import functions as F

from cytoquilt.functions.numbers import log1p_norm
from cytoquilt.operators import alignment, matrix
from cytoquilt.operators.metadata import keep_first
from cytoquilt.session import materialize
from workload import base as b
from workload.base import r6, register, s6, sql_list, with_ctes

PANEL = ("red widget", "hot rod", "old ring", "small plate", "blue bolt")
PANEL_SQL = """SELECT symbol AS panel_symbol, gene FROM (SELECT symbol, gene, row_number() OVER
    (PARTITION BY symbol ORDER BY gene_pos) AS rn FROM gv WHERE symbol IN ({})) WHERE rn = 1"""


@register(
    "cell_totals",
    with_ctes(
        ["counts", "obs", "gv"],
        f"""SELECT o.cell_id, o.gse_id, coalesce(t.total, 0.0) AS total, coalesce(t.n_genes, 0) AS n_genes,
        {s6('coalesce(t.mt / greatest(t.total, 1.0), 0.0)')} AS pct_mt
        FROM obs o LEFT JOIN (SELECT cell_id, sum(count) AS total, count(*) AS n_genes,
          sum(CASE WHEN symbol LIKE 'red%' THEN count ELSE 0 END) AS mt
          FROM counts JOIN gv USING (gene) GROUP BY 1) t USING (cell_id)""",
    ),
)
def cell_totals(spark, d):
    c = b.symbol_counts(spark, d)
    prof = matrix.cell_totals(c, mito=F.col("symbol").startswith("red"))
    cells = b.obs(spark, d).select("cell_id", "gse_id")
    out = matrix.with_every_cell(cells, prof, ["cell_id"])
    return out.withColumn("pct_mt", r6("pct_mt"))


@register(
    "normalized_counts",
    with_ctes(
        ["counts", "totals"],
        f"SELECT cell_id, gene, {s6('ln(1 + count * 1e4 / total)')} AS value FROM counts JOIN totals USING (cell_id)",
    ),
)
def normalized_counts(spark, d):
    c = b.counts(spark, d)
    totals = c.groupBy("cell_id").agg(F.sum("count").alias("total"))
    return matrix.normalized(c, totals).withColumn("value", r6("value"))


@register(
    "panel_expression",
    with_ctes(
        ["counts", "obs", "gv", "totals"],
        "SELECT o.cell_id, o.leiden, "
        + ", ".join(
            s6(f"coalesce(sum(CASE WHEN x.panel_symbol = '{p}' THEN x.v END), 0)") + f" AS {matrix.panel_name(p)}"
            for p in PANEL
        )
        + " FROM obs o LEFT JOIN x USING (cell_id) GROUP BY 1, 2",
        {
            "pm": PANEL_SQL.format(sql_list(PANEL)),
            "x": "SELECT cell_id, panel_symbol, ln(1 + count * 1e4 / total) AS v FROM counts JOIN pm USING (gene) JOIN totals USING (cell_id)",
        },
    ),
)
def panel_expression(spark, d):
    panel = matrix.resolve_panel(b.var(spark, d), PANEL, exact=True)
    cells = b.obs(spark, d).select("cell_id", "leiden")
    out = matrix.panel_expression(cells, b.counts(spark, d), panel, PANEL)
    return b.rounded(out.drop("total", "n_genes"), *[matrix.panel_name(p) for p in PANEL])


@register(
    "panel_raw_counts",
    with_ctes(
        ["counts", "obs", "gv"],
        "SELECT o.cell_id, "
        + ", ".join(
            f"coalesce(sum(CASE WHEN x.panel_symbol = '{p}' THEN x.count END), 0.0) AS {matrix.panel_name(p)}" for p in PANEL
        )
        + " FROM obs o LEFT JOIN x USING (cell_id) GROUP BY 1",
        {
            "pm": PANEL_SQL.format(sql_list(PANEL)),
            "x": "SELECT cell_id, panel_symbol, count FROM counts JOIN pm USING (gene)",
        },
    ),
)
def panel_raw_counts(spark, d):
    panel = matrix.resolve_panel(b.var(spark, d), PANEL, exact=True)
    cells = b.obs(spark, d).select("cell_id")
    return matrix.panel_expression(cells, b.counts(spark, d), panel, PANEL, raw=True).drop("total", "n_genes")


@register(
    "gene_first_position",
    with_ctes(
        ["gv"],
        """SELECT upper(symbol) AS panel_symbol, min(gene) AS gene FROM gv
        WHERE brand <> '' GROUP BY 1""",
    ),
)
def gene_first_position(spark, d):
    names = [f"{a} {n}" for a in ("blue", "cold", "hot", "large", "new", "old", "red", "small")
             for n in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")]
    return matrix.resolve_panel(b.var(spark, d), names)


@register(
    "unique_gene_names",
    with_ctes(
        ["gv"],
        """SELECT gene, CASE WHEN rn > 1 THEN symbol || '-' || (rn - 1) ELSE symbol END AS unique_gene
        FROM (SELECT gene, symbol, row_number() OVER (PARTITION BY symbol ORDER BY gene_pos) AS rn FROM gv)""",
    ),
)
def unique_gene_names(spark, d):
    bucket = F.floor(F.col("gene_pos") / 256)
    out = matrix.unique_gene_names(b.var(spark, d), bucket, name="symbol")
    return out.select("gene", "unique_gene")


def _matrices(spark, d):
    """Several matrices per dataset: whole, fractional, negative; some with a counts layer or raw."""
    li = b.table(spark, d, "lineitem")
    o = b.obs(spark, d).select("cell_id", "gse_id", "tissue")
    j = li.join(o, li.l_orderkey == o.cell_id)
    x = (
        F.when(F.col("tissue") == "AFRICA", F.col("l_quantity"))
        .when(F.col("tissue") == "AMERICA", F.col("l_extendedprice"))
        .when(F.col("tissue") == "ASIA", F.col("l_discount") - 0.05)
        .when(F.col("tissue") == "EUROPE", F.col("l_discount") + 0.125)
        .otherwise(F.col("l_tax") + 0.25)
    )
    stack = F.array(
        F.struct(F.lit("X").alias("matrix"), x.alias("count")),
        F.when(F.col("tissue") == "EUROPE", F.struct(F.lit("layer:counts").alias("matrix"), F.col("l_quantity").alias("count"))),
        F.when(F.col("tissue") == "AMERICA", F.struct(F.lit("raw").alias("matrix"), F.col("l_linenumber").cast("double").alias("count"))),
    )
    return j.select("cell_id", "gse_id", F.explode(F.array_compact(stack)).alias("m")).select("cell_id", "gse_id", "m.*")


MATRICES_SQL = """SELECT o.cell_id, o.gse_id, 'X' AS matrix, CASE o.tissue WHEN 'AFRICA' THEN l_quantity
      WHEN 'AMERICA' THEN l_extendedprice WHEN 'ASIA' THEN l_discount - 0.05::DOUBLE WHEN 'EUROPE' THEN l_discount + 0.125::DOUBLE
      ELSE l_tax + 0.25::DOUBLE END AS count FROM lineitem JOIN obs o ON l_orderkey = o.cell_id
    UNION ALL SELECT o.cell_id, o.gse_id, 'layer:counts', l_quantity FROM lineitem JOIN obs o ON l_orderkey = o.cell_id WHERE o.tissue = 'EUROPE'
    UNION ALL SELECT o.cell_id, o.gse_id, 'raw', l_linenumber::DOUBLE FROM lineitem JOIN obs o ON l_orderkey = o.cell_id WHERE o.tissue = 'AMERICA'"""
INTEGER_LIKE = "abs(count - round_even(count, 0)) <= 1e-6 + 1e-5 * abs(round_even(count, 0))"


@register(
    "count_matrix_source",
    with_ctes(
        ["obs"],
        f"""SELECT gse_id, CASE WHEN bool_or(matrix = 'layer:counts') THEN 'layers[counts]'
        WHEN count(*) FILTER (matrix = 'X') = 0 THEN 'X_empty'
        WHEN bool_and({INTEGER_LIKE}) FILTER (matrix = 'X') THEN 'X_integer_like'
        ELSE 'X_noninteger_like' END AS count_matrix_source FROM m GROUP BY 1""",
        {"m": MATRICES_SQL},
    ),
)
def count_matrix_source(spark, d):
    return matrix.choose_counts(_matrices(spark, d))


@register(
    "selected_counts",
    with_ctes(
        ["obs"],
        f"""SELECT m.gse_id, count(*) AS stored, {s6('sum(count)', 3)} AS total FROM m JOIN
        (SELECT gse_id, bool_or(matrix = 'layer:counts') AS has FROM m GROUP BY 1) h USING (gse_id)
        WHERE matrix = CASE WHEN has THEN 'layer:counts' ELSE 'X' END GROUP BY 1""",
        {"m": MATRICES_SQL},
    ),
)
def selected_counts(spark, d):
    m = _matrices(spark, d)
    out = matrix.select_counts(m, matrix.choose_counts(m))
    return out.groupBy("gse_id").agg(F.count(F.lit(1)).alias("stored"), r6(F.sum("count"), 3).alias("total"))


@register(
    "pseudo_counts",
    with_ctes(["counts"], "SELECT cell_id, gene, count FROM counts"),
)
def pseudo_counts(spark, d):
    c = b.counts(spark, d)
    totals = c.groupBy("cell_id").agg(F.sum("count").alias("total"))
    logs = c.join(totals, "cell_id").withColumn("count", log1p_norm("count", "total")).drop("total")
    cells = totals.withColumnRenamed("total", "nCount_RNA").withColumn("cell_pos", F.col("cell_id"))
    out, _ = matrix.inverse_log_counts(logs, cells, "nCount_RNA")
    return out


@register(
    "gene_name_column",
    with_ctes(
        ["gv"],
        """SELECT name_column, overlap FROM (
          SELECT 0 AS pos, 'type' AS name_column, count(*) AS overlap FROM gv WHERE type IN (SELECT symbol FROM base)
          UNION ALL SELECT 1, 'brand', count(*) FROM gv WHERE brand IN (SELECT symbol FROM base)
          UNION ALL SELECT 2, 'symbol', count(*) FROM gv WHERE symbol IN (SELECT symbol FROM base))
        ORDER BY overlap DESC, pos LIMIT 1""",
        {"base": "SELECT DISTINCT symbol FROM gv WHERE size > 25"},
    ),
)
def gene_name_column(spark, d):
    v = b.var(spark, d)
    base = v.where("size > 25").select(F.col("symbol").alias("gene")).distinct()
    return matrix.best_name_column(v.drop("gene"), ["brand", "symbol"], base, "type")


@register(
    "stacked_counts",
    with_ctes(
        ["counts", "obs", "dcounts"],
        """SELECT gse_id, count(*) AS stored, count(DISTINCT gene) AS genes, sum(count) AS total
        FROM dcounts GROUP BY 1""",
    ),
)
def stacked_counts(spark, d):
    # a depositor splits the cohort by tissue; stacking puts the whole of it together again
    o = b.obs(spark, d).select("cell_id", "gse_id", "tissue")
    c = materialize(b.counts(spark, d).join(o, "cell_id"))
    tissues = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    parts = [c.where(F.col("tissue") == t).drop("tissue") for t in tissues]
    out = alignment.stack_counts(parts)
    genes = out.groupBy("gse_id", "gene").agg(F.count(F.lit(1)).alias("_n"), F.sum("count").alias("_s"))
    return genes.groupBy("gse_id").agg(
        F.sum("_n").alias("stored"), F.count(F.lit(1)).alias("genes"), F.sum("_s").alias("total")
    )


@register(
    "aligned_to_base",
    with_ctes(["counts", "gv"], "SELECT cell_id, gene, count FROM counts WHERE gene IN (SELECT gene FROM gv WHERE size <= 30)"),
)
def aligned_to_base(spark, d):
    return alignment.align_to_base(b.counts(spark, d), b.var(spark, d).where("size <= 30"))


@register(
    "noncoding_removed",
    with_ctes(
        ["counts", "gv"],
        """SELECT cell_id, gene, count FROM counts JOIN gv USING (gene)
        WHERE NOT regexp_matches(upper(CASE WHEN type = 'PROMO' THEN 'xmir' || brand WHEN type = 'SMALL' THEN 'Linc' || size ELSE symbol END),
        'MALAT1|NEAT1|XIST|LINC|MIR|SNOR|SNORA|SNORD|SCARNA|RNU')""",
    ),
)
def noncoding_removed(spark, d):
    name = (
        F.when(F.col("type") == "PROMO", F.concat(F.lit("xmir"), "brand"))
        .when(F.col("type") == "SMALL", F.concat(F.lit("Linc"), F.col("size").cast("string")))
        .otherwise(F.col("symbol"))
    )
    named = b.counts(spark, d).join(b.var(spark, d).withColumn("name", name), "gene")
    return alignment.drop_noncoding(named, "name").select("cell_id", "gene", "count")


@register(
    "raw_rescue",
    with_ctes(
        ["gv"],
        """SELECT count(*) AS nnz, min(count) AS min_value, max(count) AS max_value,
        bool_and(abs(count - round_even(count, 0)) <= 1e-6 + 1e-5 * abs(round_even(count, 0))) AS integer_like,
        TRUE AS fits_int32 FROM (SELECT l_partkey AS gene, l_quantity AS count FROM lineitem)
        WHERE gene IN (SELECT gene FROM cur)""",
        {"cur": "SELECT DISTINCT l_partkey AS gene FROM lineitem JOIN gv ON l_partkey = gene WHERE size > 20"},
    ),
)
def raw_rescue(spark, d):
    raw = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("count"))
    seen = raw.select("gene").distinct()
    current = b.var(spark, d).where("size > 20").join(seen, "gene", "left_semi").select("gene")
    return alignment.integer_report(alignment.rescue_counts(raw, current))


@register(
    "aligned_rebuild",
    with_ctes(
        ["counts", "obs", "gv"],
        """SELECT cell_id, gene, count FROM counts JOIN (SELECT cell_id FROM obs WHERE status <> 'P') USING (cell_id)
        WHERE gene IN (SELECT gene FROM gv WHERE size > 10)""",
    ),
)
def aligned_rebuild(spark, d):
    cells = b.obs(spark, d).where("status <> 'P'").select("cell_id")
    keyed = cells.withColumn("key", F.concat(F.lit("bc"), F.col("cell_id").cast("string"), F.lit("__s")))
    rebuilt = b.counts(spark, d).withColumn("key", F.concat(F.lit("bc"), F.col("cell_id").cast("string"), F.lit("__s")))
    rebuilt = rebuilt.withColumn("cell_id", F.col("cell_id") + 1_000_000_000)
    genes = b.var(spark, d).where("size > 10").select("gene")
    return alignment.align_counts(rebuilt, keyed, genes, "key")


@register(
    "first_gene_row",
    "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1",
)
def first_gene_row(spark, d):
    p = b.table(spark, d, "part").select("p_name", "p_partkey", "p_brand")
    return keep_first(p, ["p_name"], ["p_partkey"])
