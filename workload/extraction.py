"""Extraction of candidate cells."""

from pyspark.sql import functions as F

from cytoquilt.constants import ANNOTATION_NEGATIVE, ANNOTATION_POSITIVE
from cytoquilt.functions.genes import canonical_symbol_py
from cytoquilt.operators import extract, validate
from cytoquilt.session import materialize
from workload import base as b
from workload.base import EXTRACT_PANELS, r6, register, rounded, s6, with_ctes

POSITIVE, NEGATIVE = ("machin", "BUILD"), ("furni", "machin|house")
SCORES = [f"{p}_{k}" for p in EXTRACT_PANELS for k in ("hits", "score")]

_members = ", ".join(f"('{p}', '{canonical_symbol_py(g)}')" for p, gs in EXTRACT_PANELS.items() for g in gs)
_symbols = ", ".join(sorted({f"'{canonical_symbol_py(g)}'" for gs in EXTRACT_PANELS.values() for g in gs}))
PROFILE_CTES = {
    "pl": f"SELECT * FROM (VALUES {_members}) v(panel, symbol)",
    "pm": f"""SELECT gse_id, symbol, gene FROM (SELECT gse_id, upper(symbol) AS symbol, gene, row_number() OVER
        (PARTITION BY gse_id, upper(symbol) ORDER BY gene_pos) AS rn FROM dvar WHERE upper(symbol) IN ({_symbols})) WHERE rn = 1""",
    "k": "SELECT gse_id, panel, count(*) AS k FROM pm JOIN pl USING (symbol) GROUP BY 1, 2",
    "hit": """SELECT c.cell_id, pl.panel, count(*) AS hits, sum(ln(1 + 1e4 * c.count / t.total)) AS s
        FROM dcounts c JOIN pm ON pm.gse_id = c.gse_id AND pm.gene = c.gene JOIN pl USING (symbol)
        JOIN totals t ON t.cell_id = c.cell_id GROUP BY 1, 2""",
    "prof": "SELECT o.cell_id, o.gse_id, o.leiden, o.annotation, o.status, coalesce(t.total, 0.0) AS total, coalesce(n.n_genes, 0) AS n_genes, "
    + ", ".join(
        f"coalesce(max(CASE WHEN h.panel = '{p}' THEN h.hits END), 0) AS {p}_hits, "
        f"coalesce(max(CASE WHEN h.panel = '{p}' THEN h.s / k.k END), 0.0) AS {p}_score"
        for p in EXTRACT_PANELS
    )
    + """ FROM obs o LEFT JOIN totals t ON t.cell_id = o.cell_id
        LEFT JOIN (SELECT cell_id, count(*) AS n_genes FROM counts GROUP BY 1) n ON n.cell_id = o.cell_id
        LEFT JOIN hit h ON h.cell_id = o.cell_id LEFT JOIN k ON k.gse_id = o.gse_id AND k.panel = h.panel
        GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "cand0": """SELECT *, regexp_matches(annotation, 'machin|BUILD', 'i') AS annotation_keep,
        regexp_matches(annotation, 'furni|machin|house', 'i') AND NOT regexp_matches(annotation, 'machin|BUILD', 'i') AS against FROM prof""",
    "cand1": """SELECT *, (t_hits >= 1 OR gd_hits >= 1 OR (nk_hits >= 2 AND nk_strong_hits >= 1) OR t_score >= 0.6
        OR gd_score >= 0.35 OR nk_score >= 0.8) AND NOT (contam_score >= 1.25 AND t_hits + gd_hits + nk_hits <= 1
        AND NOT annotation_keep) AS marker_keep FROM cand0""",
    "cand": """SELECT *, annotation_keep OR (marker_keep AND NOT against) AS keep,
        CASE WHEN annotation_keep AND NOT marker_keep THEN 'annotation_only'
        WHEN annotation_keep AND marker_keep THEN 'annotation_and_marker' ELSE 'marker_only' END AS selection_reason FROM cand1""",
}
SHARED = ["counts", "obs", "gv", "dcounts", "dvar", "totals"]


def profile(spark, d):
    cells = b.obs(spark, d).select("cell_id", "gse_id", "leiden", "annotation", "status")
    # counts are a stored table: what stands in for one is written once
    counts = materialize(b.dataset_counts(spark, d))
    var = counts.select("gse_id", "gene").distinct().join(b.var(spark, d), "gene")
    return extract.marker_profile(cells, counts, var, EXTRACT_PANELS)


def candidates(spark, d):
    return extract.select_candidates(profile(spark, d), ["annotation"], positive=POSITIVE, negative=NEGATIVE)


@register(
    "marker_profile",
    with_ctes(
        SHARED,
        "SELECT cell_id, gse_id, total, n_genes, "
        + ", ".join(f"{p}_hits, {s6(f'{p}_score')} AS {p}_score" for p in EXTRACT_PANELS)
        + " FROM prof",
        PROFILE_CTES,
    ),
)
def marker_profile(spark, d):
    out = profile(spark, d).select("cell_id", "gse_id", "total", "n_genes", *SCORES)
    return rounded(out, *[f"{p}_score" for p in EXTRACT_PANELS])


@register(
    "candidate_cells",
    with_ctes(
        SHARED, "SELECT cell_id, gse_id, annotation_keep, marker_keep, keep, selection_reason FROM cand", PROFILE_CTES
    ),
)
def candidate_cells(spark, d):
    return candidates(spark, d).select(
        "cell_id", "gse_id", "annotation_keep", "marker_keep", "keep", "selection_reason"
    )


def _summary_sql(where: str) -> str:
    means = ", ".join(
        f"{s6(f'avg(CASE WHEN keep THEN {n}_score END)')} AS mean_{n}_score_candidates" for n in ("t", "nk", "gd", "contam")
    )
    return with_ctes(
        SHARED,
        f"""SELECT gse_id, count(*) AS input_n, count(*) FILTER (keep) AS candidate_n,
        count(*) FILTER (annotation_keep) AS annotation_positive_n, count(*) FILTER (marker_keep) AS marker_positive_n,
        count(*) FILTER (annotation_keep AND marker_keep) AS annotation_and_marker_n,
        count(*) FILTER (annotation_keep AND NOT marker_keep) AS annotation_only_n,
        count(*) FILTER (NOT annotation_keep AND marker_keep) AS marker_only_n, {means},
        {s6('count(*) FILTER (keep) / count(*)')} AS candidate_fraction FROM cand {where} GROUP BY 1""",
        PROFILE_CTES,
    )


ROUNDED = [f"mean_{n}_score_candidates" for n in ("t", "nk", "gd", "contam")] + ["candidate_fraction"]


@register("selection_summary", _summary_sql(""))
def selection_summary(spark, d):
    return rounded(extract.selection_summary(candidates(spark, d)), *ROUNDED)


@register("selection_summary_retained", _summary_sql("WHERE keep"))
def selection_summary_retained(spark, d):
    return rounded(extract.selection_summary(candidates(spark, d), population="retained"), *ROUNDED)


@register(
    "marker_availability",
    with_ctes(
        SHARED,
        """SELECT g.gse_id, upper(p.panel) AS marker_group, coalesce(k.k, 0) AS genes_present
        FROM (SELECT DISTINCT gse_id FROM obs) g CROSS JOIN (SELECT DISTINCT panel FROM pl) p
        LEFT JOIN k ON k.gse_id = g.gse_id AND k.panel = p.panel""",
        {n: PROFILE_CTES[n] for n in ("pl", "pm", "k")},
    ),
)
def marker_availability(spark, d):
    return extract.availability_table(b.obs(spark, d), b.dataset_var(spark, d), EXTRACT_PANELS)


@register(
    "candidates_reconciled",
    with_ctes(
        SHARED,
        """SELECT gse_id, count(*) FILTER (keep) AS expected_n, count(*) FILTER (keep) AS observed_n, TRUE AS matches
        FROM cand GROUP BY 1""",
        PROFILE_CTES,
    ),
)
def candidates_reconciled(spark, d):
    cells = candidates(spark, d)
    observed = cells.where("keep").groupBy("gse_id").agg(F.count(F.lit(1)).alias("n"))
    return validate.reconcile_counts(extract.selection_summary(cells), observed, "gse_id", "candidate_n", "n")


@register(
    "annotation_text_flags",
    "SELECT doc_id, p OR q AS annotation_keep, (np AND NOT p) OR (nq AND NOT q) AS annotation_negative FROM (SELECT doc_id, "
    + ", ".join(
        f"regexp_matches({c}, '{'|'.join(f'(?:{x})' for x in pats)}', 'i') AS {a}"
        for c, pats, a in (
            ("text", ANNOTATION_POSITIVE, "p"), ("source", ANNOTATION_POSITIVE, "q"),
            ("text", ANNOTATION_NEGATIVE, "np"), ("source", ANNOTATION_NEGATIVE, "nq"),
        )
    )
    + " FROM documents)",
)
def annotation_text_flags(spark, d):
    docs = b.table(spark, d, "documents")
    keep, against = extract.annotation_flags(["text", "source"])
    return docs.select("doc_id", keep.alias("annotation_keep"), against.alias("annotation_negative"))
