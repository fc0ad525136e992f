"""Rule-driven labels on the documents: sources are datasets, whole texts are a field."""

from pyspark.sql import functions as F

from cytoquilt.functions.text import match_text
from cytoquilt.operators import rules as R
from cytoquilt.operators import summaries
from cytoquilt.operators.sampling import per_group_sample
from workload import base as b
from workload.base import register, sql_list, with_ctes
from workload.text import RULES, sql_clean, sql_match

RULESET = {
    "sample_per_gse": 10,
    "random_seed": 42,
    "unknown_label": "unknown",
    "ignore_if_contains": [".tsv.gz", "matrix.mtx"],
    "global_exact_map": {"control": "healthy", "healthy donor": "healthy", "severe": "disease", "covid 19": "disease"},
    "global_regex_rules": [
        {"pattern": r"\bcontrol\b|disease free", "value": "healthy", "reason": "control wording"},
        {"pattern": r"erention|auxque|\bdes\b", "value": "disease", "reason": "disease wording"},
        {"pattern": r"pre.?treatment", "value": "disease", "reason": "treatment wording"},
    ],
    "gse_default_map": {"src3": "disease", "src4": "healthy"},
    "gse_specific_rules": {
        "src1": [
            {"fields": ["sample_id", "condition_meta"], "pattern": "hd[0-9]+_e", "value": "healthy", "reason": "HD ids"},
            {"fields": ["sample_id"], "pattern": "hd [0-9]+ e", "value": "disease", "reason": "split ids"},
        ],
        "src2": [{"fields": ["series_bundle", "donor_patient"], "pattern": r"\bthe\b", "value": "disease", "reason": "wording"}],
        "src5": [{"fields": ["condition_meta", "sample_type"], "pattern": "zzz", "value": "never", "reason": "no hit"}],
    },
}
DOC_SQL = """SELECT doc_id, source AS source_gse_id, CASE lang WHEN 'de' THEN 'Control' WHEN 'es' THEN 'x matrix.mtx control' WHEN 'fr' THEN ' NA' ELSE lang END AS condition_meta,
    CASE WHEN n_chars > 2000 THEN 'COVID19' WHEN n_chars > 1000 THEN 'Healthy_donor' ELSE '' END AS sample_type, text AS series_bundle, source AS "project name",
    'D' || lang AS donor_patient, 'hd' || doc_id || '_' || lang AS sample_id, CASE WHEN n_chars < 300 THEN 'Pre-treatment' ELSE '' END AS sampleid, '' AS library_id FROM documents"""


def cells(spark, d):
    t = b.table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    return t.select(
        "doc_id",
        F.col("source").alias("source_gse_id"),
        F.when(F.col("lang") == "de", "Control").when(F.col("lang") == "es", "x matrix.mtx control")
        .when(F.col("lang") == "fr", " NA").otherwise(F.col("lang")).alias("condition_meta"),
        F.when(F.col("n_chars") > 2000, "COVID19").when(F.col("n_chars") > 1000, "Healthy_donor").otherwise("").alias("sample_type"),
        F.col("text").alias("series_bundle"),
        F.col("source").alias("project name"),
        F.concat(F.lit("D"), "lang").alias("donor_patient"),
        F.concat(F.lit("hd"), i, F.lit("_"), "lang").alias("sample_id"),
        F.when(F.col("n_chars") < 300, "Pre-treatment").otherwise("").alias("sampleid"),
        F.lit("").alias("library_id"),
    )


def chain_sql(layout, mode, joiners):
    """The rule chain as SQL, written from the rule set and independent of the compiler."""
    col = {n: f'"{layout.column(n)}"' for n in (*layout.fields, "donor_patient", "condition_meta")}
    clean = {n: sql_clean(c, RULES) for n, c in col.items()}

    def screened(n):
        if n not in layout.screened:
            return clean[n]
        bad = " OR ".join(f"contains(lower({clean[n]}), '{t}')" for t in RULESET["ignore_if_contains"])
        return f"CASE WHEN {bad} THEN '' ELSE {clean[n]} END"

    norm_cols = ", ".join(f"{sql_match(screened(n), joiners)} AS n_{n}" for n in layout.fields)
    raw_cols = ", ".join(f"{clean[n]} AS r_{n}" for n in layout.fields)
    branches = []
    for gse, ruleset in RULESET["gse_specific_rules"].items():
        for rule in ruleset:
            used = [f for f in rule["fields"] if f in layout.fields]
            if not used:
                continue
            if mode == "raw":
                hay = "concat_ws(' || ', " + ", ".join(f"nullif(r_{f}, '')" for f in used) + ")"
            else:
                hay = " || ".join(f"' || ' || n_{f}" for f in used)
            branches.append((f"source_gse_id = '{gse}' AND regexp_matches({hay}, '{rule['pattern']}', 'i')", f"'{rule['value']}'", "'rule'", f"'{gse}: {rule['reason']}'"))
    for f in layout.fields:
        src = layout.column(f) if mode == "normalized" else f
        exact = RULESET["global_exact_map"]
        pick = f"CASE n_{f} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in exact.items()) + " END"
        branches.append((f"n_{f} IN ({sql_list(exact)})", pick, f"'{src}'", f"'global exact match on {src}'"))
        for rule in RULESET["global_regex_rules"]:
            branches.append((f"n_{f} <> '' AND regexp_matches(n_{f}, '{rule['pattern']}', 'i')", f"'{rule['value']}'", f"'{src}'", f"'{rule['reason']}'"))
    for gse, value in RULESET["gse_default_map"].items():
        branches.append((f"source_gse_id = '{gse}'", f"'{value}'", "'gse_default'", f"'{gse}: dataset default'"))
    cases = []
    for i, (out, rest) in enumerate(((layout.out, "'unknown'"), (f"{layout.out}_source", "'fallback'"), (f"{layout.out}_reason", f"'{layout.no_match}'"))):
        cases.append("CASE " + " ".join(f"WHEN {br[0]} THEN {br[i + 1]}" for br in branches) + f" ELSE {rest} END AS {out}")
    return f"SELECT *, {', '.join(cases)} FROM (SELECT *, {raw_cols}, {norm_cols} FROM src)"


OUT = R.DISEASE.out
RAW = chain_sql(R.DISEASE, "raw", "_/|+-")
NORM = chain_sql(R.DISEASE, "normalized", "_/|+-")
COLS = ["doc_id", "source_gse_id", OUT, f"{OUT}_source", f"{OUT}_reason"]


@register("rules_raw", with_ctes([], f"SELECT {', '.join(COLS)} FROM r", {"src": DOC_SQL, "r": RAW}))
def rules_raw(spark, d):
    return R.apply_rules(cells(spark, d), RULESET, R.DISEASE, mode="raw").select(*COLS)


@register("rules_normalized", with_ctes([], f"SELECT {', '.join(COLS)} FROM r", {"src": DOC_SQL, "r": NORM}))
def rules_normalized(spark, d):
    return R.apply_rules(cells(spark, d), RULESET, R.DISEASE, mode="normalized", distinct_inputs=False).select(*COLS)


TISSUE_SQL = DOC_SQL.replace("SELECT doc_id,", "SELECT doc_id, lang || '-pos+' AS tissue_obs, source || '.tsv.gz control' AS tissue_meta,")
T_OUT = R.TISSUE.out
T_COLS = ["doc_id", "source_gse_id", T_OUT, f"{T_OUT}_source", f"{T_OUT}_reason"]


def tissue_cells(spark, d):
    t = b.table(spark, d, "documents").select(
        "doc_id", F.concat("lang", F.lit("-pos+")).alias("tissue_obs"), F.concat("source", F.lit(".tsv.gz control")).alias("tissue_meta")
    )
    return cells(spark, d).join(t, "doc_id")


@register(
    "tissue_rules",
    with_ctes([], f"SELECT {', '.join(T_COLS)} FROM r", {"src": TISSUE_SQL, "r": chain_sql(R.TISSUE, "raw", "_/|")}),
)
def tissue_rules(spark, d):
    return R.apply_rules(tissue_cells(spark, d), RULESET, R.TISSUE, mode="raw").select(*T_COLS)


@register(
    "rules_by_dataset",
    with_ctes(
        [],
        f"""SELECT source_gse_id, count(*) AS cell_n, count(*) FILTER ({sql_clean('condition_meta', RULES)} = '') AS original_blank,
        count(*) FILTER ({OUT} = 'unknown') AS corrected_unknown, count(DISTINCT {OUT}) AS unique_corrected, count(DISTINCT condition_meta) AS unique_condition
        FROM r GROUP BY 1""",
        {"src": DOC_SQL, "r": NORM},
    ),
)
def rules_by_dataset(spark, d):
    from cytoquilt.functions.text import clean

    full = R.apply_rules(cells(spark, d), RULESET, R.DISEASE, mode="normalized")
    return summaries.group_audit(
        full, "source_gse_id", {"unique_corrected": OUT, "unique_condition": "condition_meta"},
        {"original_blank": clean("condition_meta") == "", "corrected_unknown": F.col(OUT) == "unknown"},
    )


@register(
    "rules_value_counts",
    with_ctes([], f"SELECT {OUT}_reason, count(*) AS cell_n FROM r GROUP BY 1", {"src": DOC_SQL, "r": NORM}),
)
def rules_value_counts(spark, d):
    full = R.apply_rules(cells(spark, d), RULESET, R.DISEASE, mode="normalized")
    return summaries.value_counts(full, f"{OUT}_reason")


@register(
    "rules_audit_sample",
    with_ctes(
        [],
        f"""SELECT {', '.join(COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY source_gse_id ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM r) WHERE rn <= 10""",
        {"src": DOC_SQL, "r": RAW},
    ),
)
def rules_audit_sample(spark, d):
    sampled = per_group_sample(cells(spark, d), ["source_gse_id"], 10, ["doc_id"], 42)
    return R.apply_rules(sampled, RULESET, R.DISEASE, mode="raw").select(*COLS)


@register(
    "distinct_values",
    with_ctes(
        [],
        " UNION ALL ".join(
            f"SELECT source_gse_id, '{c}' AS column_name, {sql_clean(c, RULES)} AS value, count(*) AS cell_n FROM src WHERE {sql_clean(c, RULES)} <> '' GROUP BY 1, 2, 3"
            for c in ("condition_meta", "sample_type", "donor_patient")
        ),
        {"src": DOC_SQL},
    ),
)
def distinct_values(spark, d):
    return summaries.distinct_values_long(cells(spark, d), "source_gse_id", ["condition_meta", "sample_type", "donor_patient"])


@register(
    "unresolved_examples",
    with_ctes([], f"SELECT doc_id, source_gse_id, condition_meta FROM r WHERE {OUT} = 'unknown' ORDER BY doc_id LIMIT 50", {"src": DOC_SQL, "r": RAW}),
)
def unresolved_examples(spark, d):
    full = R.apply_rules(cells(spark, d), RULESET, R.DISEASE, mode="raw")
    return full.where(F.col(OUT) == "unknown").orderBy("doc_id").limit(50).select("doc_id", "source_gse_id", "condition_meta")


BUNDLE_SQL = """SELECT r_name AS gse_id, 'GSM' || n_nationkey AS gsm, CASE WHEN n_nationkey = 24 THEN '' ELSE n_name END AS title,
    n_name || ' | ' || r_name AS bundle, (24 - n_nationkey)::BIGINT AS pos FROM nation JOIN region ON n_regionkey = r_regionkey"""
VALUES_SQL = """SELECT c_custkey, r_name AS source_gse_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'lib_gsm' || n_nationkey || '_x' WHEN 'FURNITURE' THEN 'GSM999' ELSE 'NA' END AS library_id,
    CASE c_mktsegment WHEN 'MACHINERY' THEN n_name WHEN 'HOUSEHOLD' THEN 'cell of ' || n_name ELSE '' END AS sample_id, CASE WHEN c_acctbal > 0 THEN 'tion' ELSE 'zz' END AS sampleid,
    c_name AS "project name" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
FIELDS4 = ["library_id", "sample_id", "sampleid", "project name"]


def _norm(e):
    return sql_match(e, "_/|+-")


BUNDLE_CTES = {
    "bun": BUNDLE_SQL,
    "cel": VALUES_SQL,
    "tit": f"SELECT gse_id, {_norm('title')} AS t, arg_max(bundle, pos) AS bundle, min(pos) AS pos FROM bun WHERE {_norm('title')} <> '' GROUP BY 1, 2",
    "val": " UNION ".join(f'SELECT source_gse_id AS gse_id, {sql_clean(chr(34) + f + chr(34), RULES)} AS value FROM cel' for f in FIELDS4),
    "nv": f"SELECT gse_id, value, {_norm('value')} AS n, upper(regexp_extract(value, '(?i)(GSM\\d+)', 1)) AS g FROM val WHERE value <> ''",
    "res": """SELECT nv.gse_id, nv.value, coalesce(a.bundle, e.bundle, c.bundle, '') AS bundle FROM nv LEFT JOIN bun a ON a.gse_id = nv.gse_id AND a.gsm = nv.g
        LEFT JOIN tit e ON e.gse_id = nv.gse_id AND e.t = nv.n LEFT JOIN (SELECT nv.gse_id, nv.value, arg_min(tit.bundle, tit.pos) AS bundle FROM nv JOIN tit
        ON tit.gse_id = nv.gse_id AND nv.n <> '' AND (contains(tit.t, nv.n) OR contains(nv.n, tit.t)) GROUP BY 1, 2) c ON c.gse_id = nv.gse_id AND c.value = nv.value""",
}


def bundles(spark, d):
    n, r = b.table(spark, d, "nation"), b.table(spark, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("r_name").alias("gse_id"),
        F.concat(F.lit("GSM"), F.col("n_nationkey").cast("string")).alias("gsm"),
        F.when(F.col("n_nationkey") == 24, "").otherwise(F.col("n_name")).alias("title"),
        F.concat_ws(" | ", "n_name", "r_name").alias("bundle"),
        (F.lit(24) - F.col("n_nationkey")).cast("long").alias("pos"),
    )


def bundle_cells(spark, d):
    c = b.customers(spark, d)
    key = F.col("n_nationkey").cast("string")
    seg = F.col("c_mktsegment")
    return c.select(
        "c_custkey",
        F.col("r_name").alias("source_gse_id"),
        F.when(seg == "BUILDING", F.concat(F.lit("lib_gsm"), key, F.lit("_x"))).when(seg == "FURNITURE", "GSM999").otherwise("NA").alias("library_id"),
        F.when(seg == "MACHINERY", F.col("n_name")).when(seg == "HOUSEHOLD", F.concat(F.lit("cell of "), "n_name")).otherwise("").alias("sample_id"),
        F.when(F.col("c_acctbal") > 0, "tion").otherwise("zz").alias("sampleid"),
        F.col("c_name").alias("project name"),
    )


@register("series_bundles_resolved", with_ctes([], "SELECT * FROM res", BUNDLE_CTES))
def series_bundles_resolved(spark, d):
    c = bundle_cells(spark, d)
    values = c.select(
        F.col("source_gse_id").alias("gse_id"),
        F.explode(F.array("library_id", "sample_id", "sampleid", F.col("`project name`"))).alias("value"),
    )
    return R.resolve_bundles(values, bundles(spark, d), match_text)


def _joined_sql():
    joins = " ".join(
        f'LEFT JOIN res r{i} ON r{i}.gse_id = cel.source_gse_id AND r{i}.value = {sql_clean(f"cel.{chr(34)}{f}{chr(34)}", RULES)}' for i, f in enumerate(FIELDS4)
    )
    pick = ", ".join(f"nullif(r{i}.bundle, '')" for i in range(4))
    return f"SELECT c_custkey, coalesce({pick}, '') AS series_bundle FROM cel {joins}"


@register("series_bundles_attached", with_ctes([], _joined_sql(), BUNDLE_CTES))
def series_bundles_attached(spark, d):
    return R.attach_bundles(bundle_cells(spark, d), bundles(spark, d)).select("c_custkey", "series_bundle")
