"""Receptor tables from the event stream: users in groups of ten are samples."""

from pyspark.sql import functions as F

from cytoquilt.constants import CHAIN_TEXT_FIELDS
from cytoquilt.functions.labels import mapped
from cytoquilt.operators import summaries, tcr, validate
from cytoquilt.session import materialize
from cytoquilt.sources.tables import pool_donors
from workload import base as b
from workload.base import register, s6, with_ctes

CHAIN = {"click": "TRA", "view": "trb", "purchase": "TRG", "signup": "TRD", "error": "Multi"}
SEQ = "translate(substr(md5((user_id % 37)::VARCHAR), 1, 16), '0123456789abcdef', 'ACGTNACGTNACGTNA')"
CONTIG_SQL = f"""SELECT 'S' || (user_id // 10) AS sample_id, CASE WHEN value > 200 THEN '' ELSE {SEQ} || '-1' END AS barcode,
    CASE event_type WHEN 'click' THEN 'TRA' WHEN 'view' THEN 'trb' WHEN 'purchase' THEN 'TRG' WHEN 'signup' THEN 'TRD' ELSE 'Multi' END AS chain,
    CASE WHEN value < 10 THEN ' None' ELSE 'CA' || event_id END AS cdr3, 'V' || user_id AS v_gene, CASE WHEN value < 40 THEN 'nt' || event_id ELSE '' END AS cdr3_nt,
    'clone' || event_id AS raw_clonotype_id, floor(value)::BIGINT AS umis, json_extract_string(props, '$.k')::BIGINT AS reads, event_id AS row_ord FROM events"""
STD_SQL = f"""SELECT sample_id, {SEQ.replace('user_id', 'u')} AS barcode_core, upper(chain) AS chain, CASE WHEN trim(cdr3) = 'None' THEN '' ELSE cdr3 END AS cdr3,
    v_gene AS v, '' AS d, '' AS j, cdr3_nt, raw_clonotype_id AS clone_id, umis, reads, row_ord FROM (SELECT c.*, e.user_id AS u FROM con c JOIN events e ON e.event_id = c.row_ord)
    WHERE barcode <> '' AND upper(chain) IN ('TRA', 'TRB', 'TRG', 'TRD')"""
CTES = {"con": CONTIG_SQL, "std": STD_SQL}
BEST_SQL = """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, barcode_core, chain ORDER BY umis DESC, reads DESC, row_ord) AS rn FROM std) WHERE rn = 1"""
FIRST_SQL = (
    "SELECT sample_id, barcode_core, chain, "
    + ", ".join(f"coalesce(arg_min({f}, row_ord) FILTER ({f} <> ''), '') AS {f}" for f in CHAIN_TEXT_FIELDS)
    + ", max(umis) AS umis, max(reads) AS reads FROM std GROUP BY 1, 2, 3"
)


def pivot_sql(source, chains=("TRA", "TRB", "TRG", "TRD")):
    cols = []
    for ch in chains:
        cols += [f"coalesce(max({f}) FILTER (chain = '{ch}'), '') AS {ch}_{f}" for f in CHAIN_TEXT_FIELDS]
        cols += [f"coalesce(max({f}) FILTER (chain = '{ch}'), 0) AS {ch}_{f}" for f in ("umis", "reads")]
    return f"SELECT sample_id, barcode_core, {', '.join(cols)} FROM {source} GROUP BY 1, 2"


def contigs(spark, d):
    e = b.table(spark, d, "events")
    seq = F.translate(
        F.substring(F.md5((F.col("user_id") % 37).cast("string")), 1, 16), "0123456789abcdef", "ACGTNACGTNACGTNA"
    )
    i = F.col("event_id").cast("string")
    made = e.select(
        F.concat(F.lit("S"), F.floor(F.col("user_id") / 10).cast("string")).alias("sample_id"),
        F.when(F.col("value") > 200, "").otherwise(F.concat(seq, F.lit("-1"))).alias("barcode"),
        mapped("event_type", CHAIN).alias("chain"),
        F.when(F.col("value") < 10, " None").otherwise(F.concat(F.lit("CA"), i)).alias("cdr3"),
        F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("v_gene"),
        F.when(F.col("value") < 40, F.concat(F.lit("nt"), i)).otherwise("").alias("cdr3_nt"),
        F.concat(F.lit("clone"), i).alias("raw_clonotype_id"),
        F.floor("value").alias("umis"),
        F.get_json_object("props", "$.k").alias("reads"),
        F.col("event_id").alias("row_ord"),
    )
    # a contig table is a stored table: what stands in for one is written once
    return materialize(made)


def std(spark, d):
    return tcr.standardize_contigs(contigs(spark, d), order="row_ord")


@register("contigs_standardized", with_ctes([], "SELECT * FROM std", CTES))
def contigs_standardized(spark, d):
    return std(spark, d)


@register("best_contigs", with_ctes([], BEST_SQL, CTES))
def best_contigs(spark, d):
    return tcr.best_contig(std(spark, d))


@register("first_value_contigs", with_ctes([], FIRST_SQL, CTES))
def first_value_contigs(spark, d):
    return tcr.first_value_contig(std(spark, d))


@register("receptors_pivoted", with_ctes([], pivot_sql("best"), {**CTES, "best": BEST_SQL}))
def receptors_pivoted(spark, d):
    return tcr.canonical_receptors(contigs(spark, d))


@register("receptors_pivoted_first_values", with_ctes([], pivot_sql("best"), {**CTES, "best": FIRST_SQL}))
def receptors_pivoted_first(spark, d):
    return tcr.canonical_receptors(contigs(spark, d), rule="first")


@register("productive_gd_chains", with_ctes([], "SELECT row_ord, upper(chain) AS chain FROM con WHERE chain IN ('TRG', 'TRD') AND trim(cdr3) <> 'None' AND cdr3_nt <> ''", CTES))
def productive_gd_chains(spark, d):
    return tcr.productive_gd(contigs(spark, d)).select("row_ord", F.upper("chain").alias("chain"))


WIDE_SQL = f"""SELECT 'S' || (user_id // 10) AS sample_id, {SEQ} AS barcode_core, CASE WHEN value < 10 THEN 'B' || event_id ELSE 'A' || event_id END AS TRA_cdr3,
    CASE WHEN value > 30 THEN '' ELSE 'BB' || event_id END AS TRB_cdr3, 'cl' || user_id AS TRA_clone_id, 'cl' || user_id AS TRB_clone_id,
    CASE WHEN value < 10 THEN 7 ELSE floor(value)::BIGINT END AS TRA_umis, CASE WHEN event_type = 'view' THEN 0 ELSE json_extract_string(props, '$.k')::BIGINT END AS TRB_reads, event_id AS row_ord FROM events"""


def wide(spark, d):
    e = b.table(spark, d, "events")
    seq = F.translate(
        F.substring(F.md5((F.col("user_id") % 37).cast("string")), 1, 16), "0123456789abcdef", "ACGTNACGTNACGTNA"
    )
    i = F.col("event_id").cast("string")
    return e.select(
        F.concat(F.lit(" S"), F.floor(F.col("user_id") / 10).cast("string")).alias("sample"),
        F.concat(F.lower(seq), F.lit("-1")).alias("CellName"),
        F.when(F.col("value") < 10, "nan").otherwise(F.concat(F.lit("A"), i)).alias("CDR3(Alpha1)"),
        F.concat(F.lit("B"), i).alias("CDR3(Alpha2)"),
        F.when(F.col("value") > 30, " ").otherwise(F.concat(F.lit("BB"), i)).alias("CDR3(Beta1)"),
        F.concat(F.lit("cl"), F.col("user_id").cast("string")).alias("clone.id"),
        F.when(F.col("value") < 10, "").otherwise(F.floor("value").cast("string")).alias("nUMI(Alpha1)"),
        F.lit("7").alias("nUMI(Alpha2)"),
        F.when(F.col("event_type") == "view", "many").otherwise(F.get_json_object("props", "$.k")).alias("nRead(Beta1)"),
        F.col("event_id").alias("row_ord"),
    )


FIELDS = {
    "TRA_cdr3": ["CDR3(Alpha1)", "CDR3(Alpha2)"],
    "TRB_cdr3": ["CDR3(Beta1)", "CDR3(Beta2)"],
    "TRA_umis": ["nUMI(Alpha1)", "nUMI(Alpha2)"],
    "TRB_reads": ["nRead(Beta1)"],
}
WIDE_COLS = ["TRA_cdr3", "TRB_cdr3", "TRA_clone_id", "TRB_clone_id", "TRA_umis", "TRB_reads"]


@register(
    "wide_receptors",
    with_ctes([], "SELECT sample_id, barcode_core, " + ", ".join(WIDE_COLS) + " FROM w", {"w": WIDE_SQL}),
)
def wide_receptors(spark, d):
    out = tcr.standardize_wide(wide(spark, d), "sample", "CellName", FIELDS, "clone.id")
    return out.select("sample_id", "barcode_core", *WIDE_COLS)


ONE_SQL = (
    "SELECT sample_id, barcode_core, "
    + ", ".join(f"coalesce(arg_min({c}, row_ord) FILTER ({c} <> ''), '') AS {c}" for c in WIDE_COLS[:4])
    + ", max(TRA_umis) AS TRA_umis, max(TRB_reads) AS TRB_reads FROM w GROUP BY 1, 2"
)


def _one(spark, d):
    w = wide(spark, d)
    full = tcr.standardize_wide(w, "sample", "CellName", FIELDS, "clone.id", keep=["row_ord"])
    return tcr.one_row_per_cell(full)


@register("receptors_one_row_per_cell", with_ctes([], ONE_SQL, {"w": WIDE_SQL}))
def receptors_one_row_per_cell(spark, d):
    return _one(spark, d).select("sample_id", "barcode_core", *WIDE_COLS)


CELL_SQL = f"""SELECT DISTINCT 'S' || (user_id // 10) AS sample_id, {SEQ} || '-1' AS barcode, user_id FROM (SELECT c_custkey AS user_id FROM customer)"""


def cells(spark, d):
    """Cells of all customers; those without events have no receptor."""
    e = b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    seq = F.translate(
        F.substring(F.md5((F.col("user_id") % 37).cast("string")), 1, 16), "0123456789abcdef", "ACGTNACGTNACGTNA"
    )
    return e.select(
        F.concat(F.lit("S"), F.floor(F.col("user_id") / 10).cast("string")).alias("sample_id"),
        F.concat(seq, F.lit("-1")).alias("barcode"),
        "user_id",
        F.lit("stale").alias("TRA_cdr3"),
    )


def receptors(spark, d):
    return tcr.canonical_receptors(contigs(spark, d))


MERGE_CTES = {
    **CTES,
    "best": BEST_SQL,
    "piv": pivot_sql("best"),
    "cel": CELL_SQL,
    "mer": """SELECT c.sample_id, c.barcode, c.user_id, coalesce(p.TRA_cdr3, '') AS TRA_cdr3, coalesce(p.TRB_cdr3, '') AS TRB_cdr3,
        coalesce(p.TRG_cdr3, '') AS TRG_cdr3, coalesce(p.TRD_cdr3, '') AS TRD_cdr3, coalesce(p.TRA_umis, 0) AS TRA_umis,
        CASE WHEN p.sample_id IS NOT NULL THEN 'yes' ELSE 'no' END AS TCRseq
        FROM cel c LEFT JOIN piv p ON p.sample_id = c.sample_id AND p.barcode_core || '-1' = c.barcode""",
    "flg": """SELECT *, TRA_cdr3 <> '' AND TRB_cdr3 <> '' AS has_TRA_TRB_paired, TRG_cdr3 <> '' AND TRD_cdr3 <> '' AS has_TRG_TRD_paired,
        TRA_cdr3 <> '' OR TRB_cdr3 <> '' AS has_any_ab_tcr, TRG_cdr3 <> '' OR TRD_cdr3 <> '' AS has_any_gd_tcr FROM mer""",
}


def merged(spark, d):
    return tcr.merge_receptors(cells(spark, d), receptors(spark, d), ("TRA", "TRB", "TRG", "TRD"))


@register("receptors_merged", with_ctes([], "SELECT * FROM mer", MERGE_CTES))
def receptors_merged(spark, d):
    return merged(spark, d).select(
        "sample_id", "barcode", "user_id", "TRA_cdr3", "TRB_cdr3", "TRG_cdr3", "TRD_cdr3", "TRA_umis", "TCRseq"
    )


FLAGS = ["has_TRA_TRB_paired", "has_TRG_TRD_paired", "has_any_ab_tcr", "has_any_gd_tcr"]


@register("receptor_flags", with_ctes([], f"SELECT user_id, {', '.join(FLAGS)}, TCRseq FROM flg", MERGE_CTES))
def receptor_flags(spark, d):
    return tcr.receptor_flags(merged(spark, d)).select("user_id", *FLAGS, "TCRseq")


@register(
    "receptor_sanity",
    with_ctes(
        [],
        f"""SELECT sample_id, count(*) AS cells_before, count(*) AS cells_after, count(*) FILTER (TCRseq = 'yes') AS cells_with_tcr,
        count(*) FILTER (has_TRA_TRB_paired) AS cells_paired_ab, count(*) FILTER (has_TRG_TRD_paired) AS cells_paired_gd, TRUE AS rows_unchanged,
        {s6('count(*) FILTER (has_TRA_TRB_paired) / count(*)')} AS paired_fraction, count(*) FILTER (has_TRA_TRB_paired) / count(*) >= 0.95 AS suspicious,
        0::BIGINT AS duplicate_receptor_keys FROM flg GROUP BY 1""",
        MERGE_CTES,
    ),
)
def receptor_sanity(spark, d):
    after = tcr.receptor_flags(merged(spark, d))
    out = validate.receptor_sanity(cells(spark, d), after, receptors(spark, d), "sample_id")
    return b.rounded(out, "paired_fraction")


SHIFT = 75
PRES = """SELECT user_id, event_type, tra <> '' AS has_tra, trb <> '' AS has_trb, tra <> '' OR trb <> '' AS has_tra_or_trb, tra <> '' AND trb <> '' AS has_paired,
    tra = '' AND trb = '' AS has_none FROM (SELECT user_id, event_type, CASE WHEN value > 20 THEN 'C' ELSE '' END AS tra, CASE WHEN value < 60 THEN 'D' ELSE '' END AS trb,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1"""


def _presence(spark, d):
    e = b.table(spark, d, "events").withColumns(
        {"TRA_cdr3": F.when(F.col("value") > 20, "C"), "TRB_cdr3": F.when(F.col("value") < 60, "D").otherwise(" ")}
    )
    lookup = tcr.presence_lookup(e, ["user_id", "event_type"], ["event_id"])
    # users shifted, so that half of the rows have a key that the lookup lacks
    rows = b.table(spark, d, "events").select("event_id", (F.col("user_id") + SHIFT).alias("user_id"), "event_type")
    return tcr.attach_presence(rows, lookup, ["user_id", "event_type"])


PRES_JOIN = f"WITH e AS (SELECT event_id, user_id + {SHIFT} AS user_id, event_type FROM events) SELECT e.event_id, e.user_id, e.event_type, " + ", ".join(
    f"coalesce(p.{c}, FALSE) AS {c}" for c in tcr.PRESENCE
) + " FROM e LEFT JOIN pres p USING (user_id, event_type)"


@register("receptor_presence", with_ctes([], f"SELECT * FROM ({PRES_JOIN})", {"pres": PRES}))
def receptor_presence(spark, d):
    return _presence(spark, d)


@register(
    "pairing_states",
    with_ctes(
        [],
        f"""SELECT CASE WHEN has_paired THEN 'Paired TRA/TRB' WHEN has_none THEN 'No TCR' ELSE 'Other TCR state' END AS state, count(*) AS n_cells
        FROM ({PRES_JOIN}) GROUP BY 1""",
        {"pres": PRES},
    ),
)
def pairing_states(spark, d):
    return summaries.pairing_states(_presence(spark, d))


@register(
    "pool_donors",
    """SELECT p || pool AS pool, donors FROM (SELECT 'pool1' AS pool, string_agg(coalesce(n_name, 'nan'), ';' ORDER BY n_nationkey) AS donors FROM nation
    UNION ALL SELECT 'pool2', string_agg(CASE WHEN n_regionkey = 2 THEN 'nan' ELSE n_regionkey::VARCHAR END, ';' ORDER BY n_nationkey) FROM nation),
    (VALUES (''), ('chip1'), ('chip2')) v(p)""",
)
def pools(spark, d):
    n = b.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("row_ord"), F.col("n_name").alias("pool1"),
        F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("pool2"),
    )
    return pool_donors(n)
