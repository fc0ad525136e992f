"""Module scores and their summaries."""

from pyspark.sql import functions as F

from cytoquilt.functions.genes import canonical_symbol_py  # noqa: F401
from cytoquilt.operators import scoring
from cytoquilt.session import materialize
from workload import base as b
from workload.base import register, rounded, s6, with_ctes

PATTERNS = {"tra": "^red widget$|^red bolt|^red ring", "trb": "^blue rod|^blue gear", "trd": "^hot anvil$|^hot gizmo"}
NAMES = ("tra", "trb", "trab", "trd")
CASES = {
    "tra": PATTERNS["tra"], "trb": PATTERNS["trb"], "trd": PATTERNS["trd"], "trab": f"{PATTERNS['tra']}|{PATTERNS['trb']}",
}
DIGITS, BINS, SIZE, SEED = 9, 25, 20, 1

MEAN_CTES = {
    "ncell": "SELECT count(*) AS n FROM obs",
    "gm": """SELECT gv.gene, coalesce(s.s, 0) / (SELECT n FROM ncell) AS mean_expr FROM gv LEFT JOIN
        (SELECT gene, sum(ln(1 + count * 1e4 / total)) AS s FROM counts JOIN totals USING (cell_id) GROUP BY 1) s USING (gene)""",
}
BIN_CTES = {
    **MEAN_CTES,
    "gmr": f"SELECT gene, round(mean_expr, {DIGITS}) AS mean_expr FROM gm",
    "bn": f"""SELECT gene, mean_expr, floor(rank() OVER (ORDER BY mean_expr) / (SELECT round_even(count(*) / {BINS - 1}.0, 0) FROM gmr))::BIGINT AS bin FROM gmr""",
}
MODULE_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS module, gene FROM gv WHERE regexp_matches(symbol, '{p}')" for m, p in CASES.items()
)
CONTROL_CTES = {
    **BIN_CTES,
    "md": MODULE_SQL,
    "touched": "SELECT DISTINCT md.module, bn.bin FROM md JOIN bn USING (gene)",
    "drawn": f"""SELECT module, gene FROM (SELECT t.module, bn.gene, row_number() OVER (PARTITION BY t.module, bn.bin
        ORDER BY md5(bn.gene || '|{SEED}'), bn.gene) AS rn FROM touched t JOIN bn USING (bin)) WHERE rn <= {SIZE}""",
    "ctrl": "SELECT DISTINCT d.module, d.gene FROM drawn d ANTI JOIN md ON md.module = d.module AND md.gene = d.gene",
}
SCORE_CTES = {
    **CONTROL_CTES,
    "mw": """SELECT module, gene, 1.0 / (count(*) OVER (PARTITION BY module)) AS w FROM md
        UNION ALL SELECT module, gene, -1.0 / (count(*) OVER (PARTITION BY module)) AS w FROM ctrl""",
    "raw": """SELECT c.cell_id, mw.module, sum(mw.w * ln(1 + c.count * 1e4 / t.total)) AS s FROM counts c JOIN mw USING (gene)
        JOIN totals t ON t.cell_id = c.cell_id GROUP BY 1, 2""",
    "sc0": "SELECT o.cell_id, o.gse_id, o.leiden, o.tissue, "
    + ", ".join(f"coalesce(max(CASE WHEN r.module = '{m}' THEN r.s END), 0) AS {m}_score" for m in NAMES)
    + " FROM obs o LEFT JOIN raw r ON r.cell_id = o.cell_id GROUP BY 1, 2, 3, 4",
    "sc": "SELECT *, trd_score - trab_score AS trd_minus_trab FROM sc0",
    "rng": "SELECT min(trab_score) AS al, max(trab_score) AS ah, min(trd_score) AS dl, max(trd_score) AS dh FROM sc",
    "ss": """SELECT sc.*, (trab_score - al) / (ah - al) AS trab_score_scaled, (trd_score - dl) / (dh - dl) AS trd_score_scaled,
        (trd_score - dl) / (dh - dl) - (trab_score - al) / (ah - al) AS trd_minus_trab_scaled FROM sc, rng""",
}
SHARED = ["counts", "obs", "gv", "totals"]
RAW = [f"{m}_score" for m in NAMES] + ["trd_minus_trab"]
SCALED = ["trab_score_scaled", "trd_score_scaled", "trd_minus_trab_scaled"]


def modules(spark, d):
    return scoring.find_modules(b.var(spark, d), PATTERNS, symbol="symbol")


def means(spark, d):
    n = b.table(spark, d, "orders").select(F.count(F.lit(1))).scalar()
    return scoring.gene_means(scoring.normalized_store(b.counts(spark, d), buckets=b.count_parts(spark, d)), b.var(spark, d), n)


def scores(spark, d):
    cells = b.obs(spark, d).select("cell_id", "gse_id", "leiden", "tissue")
    return scoring.score_cells(
        cells, b.counts(spark, d), b.var(spark, d), modules(spark, d), bins=BINS, control_size=SIZE, seed=SEED, digits=DIGITS, buckets=b.count_parts(spark, d)
    )


def scaled_scores(spark, d):
    return scoring.add_scaled_scores(scores(spark, d))


@register("module_genes", with_ctes(["gv"], "SELECT module, gene FROM md", {"md": MODULE_SQL}))
def module_genes(spark, d):
    return modules(spark, d)


@register("gene_means", with_ctes(SHARED, f"SELECT gene, {s6('mean_expr')} AS mean_expr FROM gm", MEAN_CTES))
def gene_means(spark, d):
    return rounded(means(spark, d), "mean_expr")


@register("expression_bins", with_ctes(SHARED, "SELECT gene, bin FROM bn", BIN_CTES))
def expression_bins(spark, d):
    return scoring.expression_bins(means(spark, d), BINS, DIGITS).select("gene", "bin")


@register("control_genes", with_ctes(SHARED, "SELECT module, gene FROM ctrl", CONTROL_CTES))
def control_genes(spark, d):
    binned = materialize(scoring.expression_bins(means(spark, d), BINS, DIGITS))
    return scoring.control_genes(binned, modules(spark, d), SIZE, SEED)


@register(
    "module_scores",
    with_ctes(SHARED, "SELECT cell_id, " + ", ".join(f"{s6(c)} AS {c}" for c in RAW) + " FROM sc", SCORE_CTES),
)
def module_scores(spark, d):
    return rounded(scores(spark, d).select("cell_id", *RAW), *RAW)


@register(
    "scaled_scores",
    with_ctes(SHARED, "SELECT cell_id, " + ", ".join(f"{s6(c)} AS {c}" for c in SCALED) + " FROM ss", SCORE_CTES),
)
def scaled(spark, d):
    return rounded(scaled_scores(spark, d).select("cell_id", *SCALED), *SCALED)


STATS = ["mean", "std", "min", "p01", "p05", "median", "p95", "p99", "max"]


def _summary_sql():
    long = " UNION ALL ".join(f"SELECT '{c}' AS score_name, {c} AS v FROM ss" for c in RAW + SCALED)
    q = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    cols = [f"{s6('avg(v)')} AS mean", f"{s6('stddev_pop(v)')} AS std", f"{s6('min(v)')} AS min", f"{s6('max(v)')} AS max"]
    cols += [f"{s6(f'quantile_cont(v, {p})')} AS {n}" for n, p in q.items()]
    return with_ctes(
        SHARED, f"SELECT score_name, count(*) AS n_cells, {', '.join(cols)} FROM long GROUP BY 1", {**SCORE_CTES, "long": long}
    )


@register("score_summary", _summary_sql())
def score_summary(spark, d):
    return rounded(scoring.score_summary(materialize(scaled_scores(spark, d)), RAW + SCALED), *STATS)


# the usual quantiles and others of the caller's choice
MORE = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p999": 0.999}


@register(
    "score_summary_histogram_path",
    with_ctes(
        SHARED,
        f"SELECT score_name, count(*) AS n_cells, {s6('avg(v)')} AS mean, {s6('stddev_pop(v)')} AS std, {s6('min(v)')} AS min, {s6('max(v)')} AS max, "
        + ", ".join(f"{s6(f'quantile_cont(v, {p})')} AS {n}" for n, p in MORE.items()) + " FROM long GROUP BY 1",
        {**SCORE_CTES, "long": " UNION ALL ".join(f"SELECT '{c}' AS score_name, {c} AS v FROM ss" for c in RAW + SCALED)},
    ),
)
def score_summary_histogram_path(spark, d):
    """All scores, scaled ones too, with quantiles of the caller's own beside the usual ones."""
    out = scoring.score_summary(materialize(scaled_scores(spark, d)), RAW + SCALED, MORE)
    return rounded(out, "mean", "std", "min", "max", *MORE)


def _by_sql(by):
    cols = [f"{s6(f'avg({c})')} AS {c}_mean" for c in RAW + SCALED]
    cols += [f"{s6(f'quantile_cont({c}, 0.5)')} AS {c}_median" for c in ("trd_minus_trab", "trd_minus_trab_scaled")]
    return with_ctes(SHARED, f"SELECT {by}, count(*) AS n_cells, {', '.join(cols)} FROM ss GROUP BY 1", SCORE_CTES)


def _by(spark, d, by):
    out = scoring.grouped_score_table(
        materialize(scaled_scores(spark, d)), by, RAW + SCALED, ["trd_minus_trab", "trd_minus_trab_scaled"]
    )
    return rounded(out, *[c for c in out.columns if c.endswith(("_mean", "_median"))])


@register("scores_by_cluster", _by_sql("leiden"))
def scores_by_cluster(spark, d):
    return _by(spark, d, "leiden")


@register("scores_by_dataset", _by_sql("gse_id"))
def scores_by_dataset(spark, d):
    return _by(spark, d, "gse_id")


@register("scores_by_tissue", _by_sql("tissue"))
def scores_by_tissue(spark, d):
    return _by(spark, d, "tissue")


@register(
    "top_cells_by_score",
    with_ctes(
        SHARED,
        f"""SELECT cell_id, gse_id, leiden, {s6('trd_minus_trab')} AS trd_minus_trab FROM sc
        ORDER BY round(trd_minus_trab, 9) DESC, cell_id LIMIT 5000""",
        SCORE_CTES,
    ),
)
def top_cells_by_score(spark, d):
    from cytoquilt.operators.sampling import top_rows

    s = scores(spark, d).withColumn("_k", F.round("trd_minus_trab", 9))
    top = top_rows(s, "_k", 5000, ["cell_id"])
    return rounded(top.select("cell_id", "gse_id", "leiden", "trd_minus_trab"), "trd_minus_trab")
