"""Dataset audit."""

from pyspark.sql import functions as F

from cytoquilt.operators import audit
from workload import base as b
from workload.base import register, rounded, s6, with_ctes
from workload.matrix import INTEGER_LIKE, MATRICES_SQL, _matrices

STATS = f"""SELECT gse_id, matrix, count(*) AS nnz, bool_or(count < 0) AS has_negative,
    avg(CASE WHEN {INTEGER_LIKE} THEN 1.0::DOUBLE ELSE 0.0 END) AS frac, max(count) AS max_value FROM m GROUP BY 1, 2"""
FLAT = """SELECT gse_id, max(nnz) FILTER (matrix = 'X') AS x_nnz, bool_or(has_negative) FILTER (matrix = 'X') AS neg,
    max(frac) FILTER (matrix = 'X') AS xf, max(max_value) FILTER (matrix = 'X') AS x_max,
    bool_or(matrix = 'layer:counts') AS layer, max(frac) FILTER (matrix = 'layer:counts') AS lf,
    bool_or(matrix = 'raw') AS raw, max(frac) FILTER (matrix = 'raw') AS rf FROM st GROUP BY 1"""
STATE = """SELECT *, CASE WHEN neg THEN 'scaled_or_integrated_X' WHEN xf >= 0.98 THEN 'raw_like_X'
    WHEN layer AND lf >= 0.98 THEN 'recoverable_counts_layer' WHEN raw AND rf >= 0.98 THEN 'recoverable_raw_slot'
    WHEN NOT neg THEN 'normalized_or_noninteger_X' ELSE 'unreadable_or_unknown' END AS state_label,
    CASE WHEN neg THEN 'C' WHEN xf >= 0.98 THEN 'A' WHEN layer AND lf >= 0.98 THEN 'B' WHEN raw AND rf >= 0.98 THEN 'B'
    ELSE 'C' END AS category FROM fl"""
CTES = {"m": MATRICES_SQL, "st": STATS, "fl": FLAT, "sta": STATE}


def _audit(spark, d):
    n = b.table(spark, d, "nation")
    registry = n.select(F.col("n_name").alias("gse_id"), F.concat(F.lit("/data/"), "n_name").alias("h5ad_path"))
    return audit.audit_datasets(
        registry, _matrices(spark, d), b.obs(spark, d), b.dataset_var(spark, d)
    )


@register(
    "matrix_stats",
    with_ctes(
        ["obs"],
        f"SELECT gse_id, matrix, nnz, has_negative, {s6('frac')} AS integer_like_fraction, {s6('max_value')} AS max_value FROM st",
        {"m": MATRICES_SQL, "st": STATS},
    ),
)
def matrix_stats(spark, d):
    return rounded(audit.matrix_stats(_matrices(spark, d)), "integer_like_fraction", "max_value")


@register(
    "dataset_audit",
    with_ctes(
        ["obs", "counts", "gv", "dcounts", "dvar"],
        f"""SELECT n_name AS gse_id, x_nnz, {s6('xf')} AS x_integer_like_fraction, {s6('x_max')} AS x_max, layer AS has_counts_layer,
        raw AS has_raw, n_obs, n_vars, {s6('x_nnz / (n_obs::DOUBLE * n_vars)')} AS x_density, state_label, category,
        'donor' AS donor_fields, 'sample_id;sampleid' AS sample_fields, 'library_id' AS library_fields
        FROM nation JOIN sta ON gse_id = n_name JOIN (SELECT gse_id AS g, count(*) AS n_obs FROM obs GROUP BY 1) ON g = n_name
        JOIN (SELECT gse_id AS gg, count(*) AS n_vars FROM dvar GROUP BY 1) ON gg = n_name""",
        CTES,
    ),
)
def dataset_audit(spark, d):
    out = _audit(spark, d).select(
        "gse_id", "x_nnz", "x_integer_like_fraction", "x_max", "has_counts_layer", "has_raw", "n_obs", "n_vars",
        "x_density", "state_label", "category", "donor_fields", "sample_fields", "library_fields",
    )
    return rounded(out, "x_integer_like_fraction", "x_max", "x_density")


@register(
    "audit_categories",
    with_ctes(["obs"], "SELECT category, state_label, count(*) AS datasets FROM sta GROUP BY 1, 2", CTES),
)
def audit_categories(spark, d):
    return audit.category_counts(_audit(spark, d))


@register(
    "audit_category_a",
    with_ctes(["obs"], "SELECT gse_id, '/data/' || gse_id AS h5ad_path FROM sta WHERE category = 'A'", CTES),
)
def audit_category_a(spark, d):
    return audit.category_a(_audit(spark, d)).select("gse_id", "h5ad_path")


@register(
    "audit_field_coverage",
    "SELECT f AS field_type, (SELECT count(*) FROM nation) AS datasets_with_field, 0::BIGINT AS datasets_without_field "
    "FROM (VALUES ('donor_fields'), ('sample_fields'), ('library_fields')) v(f)",
)
def audit_field_coverage(spark, d):
    return audit.field_coverage(_audit(spark, d))


# layers by other names: a whole-number layer that is no counts layer, and two that are, of which the listed one wins
LAYERS = f"""SELECT gse_id, cell_id, CASE WHEN matrix = 'raw' THEN 'layer:scaled' ELSE matrix END AS matrix, count FROM ({MATRICES_SQL}) WHERE matrix <> 'layer:counts'
    UNION ALL SELECT gse_id, cell_id, 'layer:UMI_Counts', l_quantity FROM lineitem JOIN obs o ON l_orderkey = o.cell_id WHERE tissue = 'EUROPE'
    UNION ALL SELECT gse_id, cell_id, 'layer:a_count_copy', l_tax + 0.25 FROM lineitem JOIN obs o ON l_orderkey = o.cell_id WHERE tissue = 'EUROPE'"""


@register(
    "audit_layers_by_name",
    with_ctes(
        ["obs"],
        """SELECT gse_id, layer AS has_counts_layer, raw AS has_raw, state_label, category FROM (SELECT *, CASE WHEN neg THEN 'scaled_or_integrated_X'
        WHEN xf >= 0.98 THEN 'raw_like_X' WHEN layer AND lf >= 0.98 THEN 'recoverable_counts_layer' ELSE 'normalized_or_noninteger_X' END AS state_label,
        CASE WHEN neg THEN 'C' WHEN xf >= 0.98 THEN 'A' WHEN layer AND lf >= 0.98 THEN 'B' ELSE 'C' END AS category FROM
        (SELECT gse_id, bool_or(has_negative) FILTER (matrix = 'X') AS neg, max(frac) FILTER (matrix = 'X') AS xf, bool_or(matrix = 'layer:UMI_Counts') AS layer,
        max(frac) FILTER (matrix = 'layer:UMI_Counts') AS lf, false AS raw FROM st GROUP BY 1))""",
        {"m": LAYERS, "st": STATS},
    ),
)
def audit_layers_by_name(spark, d):
    m = _matrices(spark, d).where("matrix <> 'layer:counts'")
    m = m.withColumn("matrix", F.when(F.col("matrix") == "raw", "layer:scaled").otherwise(F.col("matrix")))
    li = b.table(spark, d, "lineitem")
    o = b.obs(spark, d).where("tissue = 'EUROPE'").select("cell_id", "gse_id")
    j = li.join(o, li.l_orderkey == o.cell_id)
    more = F.explode(
        F.array(
            F.struct(F.lit("layer:UMI_Counts").alias("matrix"), F.col("l_quantity").alias("count")),
            F.struct(F.lit("layer:a_count_copy").alias("matrix"), (F.col("l_tax") + 0.25).alias("count")),
        )
    ).alias("v")
    m = m.select("gse_id", "cell_id", "matrix", "count").unionByName(j.select("gse_id", "cell_id", more).select("gse_id", "cell_id", "v.*"))
    registry = b.table(spark, d, "nation").select(F.col("n_name").alias("gse_id"))
    out = audit.audit_datasets(registry, m, b.obs(spark, d), b.dataset_var(spark, d))
    return out.where("x_nnz is not null").select("gse_id", "has_counts_layer", "has_raw", "state_label", "category")


NAMED = """SELECT gse_id, gene_pos, CASE WHEN gse_id LIKE '%2%' THEN 'ENSG000' || gene WHEN gse_id LIKE '%3%' THEN symbol
    WHEN brand = 'Brand#4' THEN 'trac' WHEN brand = 'Brand#7' THEN 'CD3E' ELSE replace(symbol, ' ', '.') END AS symbol FROM dvar"""


@register(
    "gene_axis_audit",
    with_ctes(
        ["obs", "counts", "gv", "dcounts", "dvar"],
        """SELECT gse_id, n_vars, duplicate_var_names, CASE WHEN e >= 0.7 THEN 'ensembl_like' WHEN s >= 0.7 THEN 'gene_symbol_like'
        ELSE 'mixed_or_custom' END AS gene_naming_style, CASE WHEN tr AND cd THEN 'TRAC;CD3E' WHEN tr THEN 'TRAC' WHEN cd THEN 'CD3E' ELSE '' END AS tcr_genes_present
        FROM (SELECT gse_id, count(*) AS n_vars, count(*) - count(DISTINCT symbol) AS duplicate_var_names,
        avg(CASE WHEN upper(symbol) LIKE 'ENSG%' THEN 1.0 ELSE 0.0 END) AS e,
        avg(CASE WHEN regexp_full_match(upper(symbol), '[A-Z0-9_.-]+') THEN 1.0 ELSE 0.0 END) AS s,
        bool_or(upper(symbol) = 'TRAC') AS tr, bool_or(upper(symbol) = 'CD3E') AS cd FROM nv GROUP BY 1)""",
        {"nv": NAMED},
    ),
)
def gene_axis_audit(spark, d):
    v = b.dataset_var(spark, d)
    name = (
        F.when(F.col("gse_id").contains("2"), F.concat(F.lit("ENSG000"), F.col("gene").cast("string")))
        .when(F.col("gse_id").contains("3"), F.col("symbol"))
        .when(F.col("brand") == "Brand#4", "trac")
        .when(F.col("brand") == "Brand#7", "CD3E")
        .otherwise(F.regexp_replace("symbol", " ", "."))
    )
    return audit.gene_axis_stats(v.withColumn("symbol", name))
