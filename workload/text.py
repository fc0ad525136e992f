"""Column functions on the given texts; whole texts throughout."""

from pyspark.sql import functions as F

from cytoquilt.functions import barcodes, columns, genes, labels, numbers, text
from cytoquilt.operators.metadata import export_columns
from workload import base as b
from workload.base import r6, register, s6

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8239) || chr(8201) || chr(12288)"
MESSY_SQL = """CASE lang WHEN 'de' THEN ' NA ' WHEN 'fr' THEN '<NA>' WHEN 'es' THEN chr(9) || 'None ' ELSE chr(9) || source || ' ' END"""


def sql_strip(e):
    return f"trim({e}, {WS})"


def sql_clean(e, missing):
    inside = ", ".join(f"'{m}'" for m in missing)
    return f"CASE WHEN {e} IS NULL OR lower({sql_strip(e)}) IN ({inside}) THEN '' ELSE {sql_strip(e)} END"


RULES = ("", "nan", "none", "null", "na")
INTAKE = ("", "nan", "na", "none", "null", "<na>")


def docs(spark, d):
    t = b.table(spark, d, "documents")
    messy = (
        F.when(F.col("lang") == "de", " NA ")
        .when(F.col("lang") == "fr", "<NA>")
        .when(F.col("lang") == "es", "\tNone ")
        .otherwise(F.concat(F.lit("\t"), F.col("source"), F.lit(" ")))
    )
    return t.withColumn("messy", messy)


@register(
    "missing_text",
    f"""SELECT doc_id, {sql_clean('messy', RULES)} AS rules_text, {sql_clean('messy', INTAKE)} AS intake_text,
    nullif({sql_strip('messy')}, '') AS kept_text, CASE WHEN messy IN ('nan', '<NA>', 'None') THEN '' ELSE messy END AS label_text,
    CASE WHEN lower(messy) IN ('', 'nan', 'none', 'na') THEN 'unknown' ELSE messy END AS tissue
    FROM (SELECT *, {MESSY_SQL} AS messy FROM documents)""",
)
def missing_text(spark, d):
    return docs(spark, d).select(
        "doc_id",
        text.clean("messy").alias("rules_text"),
        text.clean_intake("messy").alias("intake_text"),
        text.blank_to_null("messy").alias("kept_text"),
        text.portable_label("messy").alias("label_text"),
        text.clean_tissue("messy").alias("tissue"),
    )


def sql_match(e, joiners):
    t = f"lower({sql_clean(e, RULES)})"
    t = f"regexp_replace({t}, '([a-z])([0-9])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([0-9])([a-z])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '[{joiners}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[\\(\\)\\[\\],;:]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    return sql_strip(t)


@register(
    "match_text",
    f"SELECT doc_id, length({sql_match('text', '_/|+-')}) AS n, md5({sql_match('text', '_/|+-')}) AS disease_digest, "
    f"md5({sql_match('text', '_/|')}) AS tissue_digest FROM documents",
)
def match_text(spark, d):
    t = b.table(spark, d, "documents")
    disease = text.match_text("text")
    return t.select(
        "doc_id",
        F.length(disease).alias("n"),
        F.md5(disease).alias("disease_digest"),
        F.md5(text.match_text_tissue("text")).alias("tissue_digest"),
    )


@register(
    "suspicious_text",
    "SELECT doc_id, contains(lower(text), 'http') OR contains(lower(text), 'tion of') OR contains(lower(text), '.com') AS suspicious FROM documents",
)
def suspicious_text(spark, d):
    t = b.table(spark, d, "documents")
    return t.select("doc_id", text.contains_any("text", ["HTTP", "tion of", ".com"]).alias("suspicious"))


GENE_SQL = """CASE WHEN p_type = 'PROMO' THEN 'GRCh38_' || p_name WHEN p_type = 'SMALL' THEN ' hg19:-' || p_brand
    WHEN p_type = 'LARGE' THEN 'mm10' || p_name WHEN p_type = 'MEDIUM' THEN 'GRCm39__trac' ELSE p_name END"""


@register(
    "canonical_gene_symbol",
    f"""SELECT p_partkey, regexp_replace(upper({sql_strip('g')}), '^(GRCH|HG|MM|GRCM)\\d+[_:-]+', '') AS symbol
    FROM (SELECT *, {GENE_SQL} AS g FROM part)""",
)
def canonical_gene_symbol(spark, d):
    p = b.table(spark, d, "part")
    g = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("GRCh38_"), "p_name"))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit(" hg19:-"), "p_brand"))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("mm10"), "p_name"))
        .when(F.col("p_type") == "MEDIUM", "GRCm39__trac")
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", genes.canonical_symbol(g).alias("symbol"))


SEQ_SQL = "translate(substr(md5(event_id::VARCHAR), 1, 16), '0123456789abcdef', 'ACGTNACGTNACGTNA')"
BARCODE_SQL = f"""CASE event_type WHEN 'click' THEN 'lib' || user_id || ':' || {SEQ_SQL} || '-1' WHEN 'view' THEN lower({SEQ_SQL}) || '-1-0-1'
    WHEN 'error' THEN {SEQ_SQL} || '_' || user_id WHEN 'signup' THEN 'cell__run_' || {SEQ_SQL} || '-12' ELSE ' nan ' END"""


def barcoded(spark, d):
    e = b.table(spark, d, "events")
    seq = F.translate(F.substring(F.md5(F.col("event_id").cast("string")), 1, 16), "0123456789abcdef", "ACGTNACGTNACGTNA")
    user = F.col("user_id").cast("string")
    code = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("lib"), user, F.lit(":"), seq, F.lit("-1")))
        .when(F.col("event_type") == "view", F.concat(F.lower(seq), F.lit("-1-0-1")))
        .when(F.col("event_type") == "error", F.concat(seq, F.lit("_"), user))
        .when(F.col("event_type") == "signup", F.concat(F.lit("cell__run_"), seq, F.lit("-12")))
        .otherwise(" nan ")
    )
    return e.withColumn("code", code)


_C = sql_clean("code", INTAKE)
_STRIP0 = f"coalesce(nullif({sql_strip('code')}, ''), '')"
CORE_SQL = f"""CASE WHEN upper({_C}) = '' THEN '' ELSE coalesce(nullif(regexp_extract(upper({_C}), '([ACGTN]+)-\\d+$', 1), ''),
    nullif(regexp_extract(upper({_C}), '([ACGTN]+)-\\d+', 1), ''), split_part(upper({_C}), '-', 1)) END"""


@register(
    "barcodes",
    f"""SELECT event_id, {CORE_SQL} AS core,
    CASE WHEN regexp_extract({_C}, '(?i)([ACGTN]+-\\d+)', 1) <> '' THEN upper(regexp_extract({_C}, '(?i)([ACGTN]+-\\d+)', 1)) ELSE {_C} END AS full_code,
    regexp_replace(regexp_replace(regexp_replace({_STRIP0}, '-\\d+$', ''), '_\\d+$', ''), '[^ACGTN]', '', 'g') AS stripped,
    split_part(split_part(code, '__', -1), '_', -1) AS from_name,
    CASE WHEN lower({sql_strip('code')}) IN ('', 'nan') THEN '' ELSE regexp_replace(split_part({sql_strip('code')}, '_', 1), '^(.*-.*)-[0-9]+$', '\\1') END AS aligned
    FROM (SELECT *, {BARCODE_SQL} AS code FROM events)""",
)
def barcode_functions(spark, d):
    return barcoded(spark, d).select(
        "event_id",
        barcodes.barcode_core("code").alias("core"),
        barcodes.full_barcode("code").alias("full_code"),
        barcodes.stripped_core("code").alias("stripped"),
        barcodes.barcode_from_name("code").alias("from_name"),
        barcodes.aligned_barcode("code").alias("aligned"),
    )


@register(
    "cell_keys",
    f"""SELECT event_id, CASE WHEN {sql_clean('event_type', RULES)} = '' OR k = '' THEN '' ELSE event_type || '||' || k END AS metadata_key,
    event_type || '__' || user_id AS cell_id, CASE WHEN lib = '' THEN {_C} ELSE lib || ':' || {_C} END AS library_cell,
    al || '__' || event_type AS alignment_key, event_type || '||' || user_id || '||' || code AS joined FROM (SELECT *,
    coalesce(nullif({sql_clean('code', RULES)}, ''), CASE WHEN user_id < 75 THEN 'u' || user_id ELSE '' END) AS k,
    CASE WHEN value > 50 THEN 'L' || user_id WHEN value > 25 THEN 'S' || user_id ELSE '' END AS lib,
    CASE WHEN lower({sql_strip('code')}) IN ('', 'nan') THEN '' ELSE regexp_replace(split_part({sql_strip('code')}, '_', 1), '^(.*-.*)-[0-9]+$', '\\1') END AS al
    FROM (SELECT *, {BARCODE_SQL} AS code FROM events))""",
)
def cell_keys(spark, d):
    e = barcoded(spark, d)
    user = F.col("user_id").cast("string")
    other = F.when(F.col("user_id") < 75, F.concat(F.lit("u"), user)).otherwise(" none ")
    library = F.when(F.col("value") > 50, F.concat(F.lit("L"), user)).otherwise("")
    sample = F.when(F.col("value") > 25, F.concat(F.lit("S"), user)).otherwise("NA")
    return e.select(
        "event_id",
        barcodes.metadata_key("event_type", "code", other).alias("metadata_key"),
        barcodes.global_cell_id("event_type", "user_id").alias("cell_id"),
        barcodes.library_cell_id(library, sample, "code").alias("library_cell"),
        barcodes.alignment_key("code", "event_type").alias("alignment_key"),
        barcodes.joined_key("event_type", user, "code").alias("joined"),
    )


WORD_SQL = """CASE event_type WHEN 'click' THEN ' Yes' WHEN 'view' THEN 'FALSE' WHEN 'error' THEN 'Paired ' WHEN 'signup' THEN '1' ELSE 'maybe' END"""


@register(
    "flags_from_text",
    f"""SELECT event_id, CASE WHEN lower(trim(w)) IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN lower(trim(w)) IN ('no', 'n', 'false', '0') THEN 'no' ELSE '' END AS yes_no,
    lower(trim(w)) IN ('true', '1', 'yes', 'y', 'productive', 'paired') AS truthy FROM (SELECT *, {WORD_SQL} AS w FROM events)""",
)
def flags_from_text(spark, d):
    word = labels.mapped(
        "event_type", {"click": " Yes", "view": "FALSE", "error": "Paired ", "signup": "1"}, "maybe"
    )
    return b.table(spark, d, "events").select(
        "event_id", text.yes_no(word).alias("yes_no"), text.is_truthy(word).alias("truthy")
    )


@register(
    "first_nonblank",
    """SELECT cell_id, coalesce(nullif(trim(library_id), ''), nullif(trim(sampleid), ''), nullif(trim(sample_id), ''), '') AS first_text,
    coalesce(nullif(trim(library_id), ''), nullif(trim(sample_id), ''), '') AS preferred, nullif(trim(library_id), '') AS first_existing
    FROM obs""".join(["WITH obs AS (" + b.CTE["obs"] + ") ", ""]),
)
def first_nonblank(spark, d):
    o = b.obs(spark, d)
    return o.select(
        "cell_id",
        text.first_nonblank("library_id", "sampleid", "sample_id").alias("first_text"),
        text.prefer("library_id", "sample_id").alias("preferred"),
        columns.text_from(o, ["no_such_column", "library_id", "sample_id"]).alias("first_existing"),
    )


def _ladder_sql(short):
    key, level = [], []
    for col, word in (("library_id", "library"), ("sampleid", "sampleid"), ("sample_id", "sample")):
        key.append(f"WHEN nullif(trim({col}), '') IS NOT NULL THEN gse_id || '|{word}|' || trim({col})")
        level.append(f"WHEN nullif(trim({col}), '') IS NOT NULL THEN '{col}'")
    if not short:
        key.append("WHEN leiden <> '5-LOW' THEN gse_id || '|phase1_library|' || leiden")
        level.append("WHEN leiden <> '5-LOW' THEN 'phase1_library_label'")
    return (
        f"WITH obs AS ({b.CTE['obs']}) SELECT cell_id, CASE {' '.join(key)} ELSE gse_id END AS batch_key, "
        f"CASE {' '.join(level)} ELSE 'gse' END AS batch_level FROM obs"
    )


@register("batch_key", _ladder_sql(False))
def batch_key(spark, d):
    o = b.obs(spark, d).withColumn("phase1_library_label", F.when(F.col("leiden") != "5-LOW", F.col("leiden")))
    return labels.with_batch_key(o, "gse_id").select("cell_id", "batch_key", "batch_level")


@register("batch_key_short", _ladder_sql(True))
def batch_key_short(spark, d):
    return labels.with_batch_key(b.obs(spark, d), "gse_id", labels.LADDER[:3]).select(
        "cell_id", "batch_key", "batch_level"
    )


PAIR_SQL = """CASE event_type WHEN 'click' THEN 'TRB:CASS' || user_id || '; tra: CAV' || event_id || ';TRA:late' WHEN 'view' THEN 'TRB: ;TRB:x:y' || user_id
    WHEN 'error' THEN 'no chain' WHEN 'signup' THEN ' NA' ELSE 'TRG:g;TRA:a' || event_id END"""
FIRST = """coalesce((list_filter(list_transform(string_split(p, ';'), lambda t: CASE WHEN contains(t, ':') AND upper(trim(split_part(t, ':', 1))) = '{0}'
    THEN trim(substr(t, instr(t, ':') + 1)) ELSE '' END), lambda t: t <> ''))[1], '')"""


@register(
    "chain_pairs",
    f"SELECT event_id, {FIRST.format('TRA')} AS tra, {FIRST.format('TRB')} AS trb FROM (SELECT *, {PAIR_SQL} AS p FROM events)",
)
def chain_pairs(spark, d):
    u, i = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    p = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("TRB:CASS"), u, F.lit("; tra: CAV"), i, F.lit(";TRA:late")))
        .when(F.col("event_type") == "view", F.concat(F.lit("TRB: ;TRB:x:y"), u))
        .when(F.col("event_type") == "error", "no chain")
        .when(F.col("event_type") == "signup", " NA")
        .otherwise(F.concat(F.lit("TRG:g;TRA:a"), i))
    )
    return b.table(spark, d, "events").select(
        "event_id", barcodes.cdr3_of_chain(p, "TRA").alias("tra"), barcodes.cdr3_of_chain(p, "TRB").alias("trb")
    )


@register(
    "timepoint_samples",
    """SELECT c_custkey, CASE WHEN m <> '' THEN 'P' || m ELSE upper(pt) END AS patient,
    CASE WHEN post THEN (CASE WHEN m <> '' THEN 'P' || m ELSE upper(pt) END) || '.post.' || coalesce(nullif(regexp_extract(title, '\\.post\\.(\\d+)$', 1), '')::BIGINT, 1)
    ELSE (CASE WHEN m <> '' THEN 'P' || m ELSE upper(pt) END) || '.pre' END AS sample_id
    FROM (SELECT *, regexp_extract(upper(pt), '^P0*([0-9]+)$', 1) AS m, contains(lower(c_mktsegment), 'build') OR contains(title, '.post.') AS post
      FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN 'p00' || c_custkey ELSE 'Q' || c_custkey END AS pt,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 't.post.0' || c_nationkey ELSE 'seg' END AS title FROM customer))""",
)
def timepoint_samples(spark, d):
    c = b.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    pt = F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("p00"), key)).otherwise(F.concat(F.lit("Q"), key))
    title = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("t.post.0"), F.col("c_nationkey").cast("string"))).otherwise("seg")
    cond = F.when(F.col("c_mktsegment") == "BUILDING", "Post-treatment").otherwise("pre")
    return c.select(
        "c_custkey", barcodes.short_patient(pt).alias("patient"), barcodes.timepoint_sample(pt, cond, title).alias("sample_id")
    )


LABEL_SQL = """CASE p_type WHEN 'PROMO' THEN 'Natural Killer ' || p_name WHEN 'SMALL' THEN 'CD8 T cell' WHEN 'LARGE' THEN 'T-helper 1 cell'
    WHEN 'MEDIUM' THEN 'memory T' ELSE p_name END"""


@register(
    "label_superclass",
    f"""SELECT p_partkey, CASE WHEN contains(l, 'natural killer') OR l = 'nk cell' THEN 'NK_cell'
    WHEN {' OR '.join(f"contains(l, '{t}')" for t in ('t cell', 't-cell', 'alpha-beta t', 'gamma-delta t', 'gd t', 'cytotoxic t', 'helper t', 'regulatory t', 'memory t', 'naive t'))}
    THEN 'T_cell' ELSE 'reference_other' END AS superclass FROM (SELECT p_partkey, lower(trim({LABEL_SQL})) AS l FROM part)""",
)
def label_superclass(spark, d):
    p = b.table(spark, d, "part")
    label = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("Natural Killer "), "p_name"))
        .when(F.col("p_type") == "SMALL", "CD8 T cell")
        .when(F.col("p_type") == "LARGE", "T-helper 1 cell")
        .when(F.col("p_type") == "MEDIUM", "memory T")
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", labels.superclass(label).alias("superclass"))


@register(
    "literal_maps",
    """SELECT cell_id, CASE status WHEN 'P' THEN 'blood' WHEN 'F' THEN 'liver tumor' WHEN 'O' THEN 'adjacent normal liver tissue' END AS tissue,
    CASE WHEN contains(leiden, 'URGENT') THEN 'pre-treatment' WHEN contains(leiden, 'HIGH') THEN 'post-treatment' ELSE '' END AS condition,
    CASE WHEN n BETWEEN 1 AND 3 THEN 'pool' || n END AS pool FROM (SELECT *, split_part(leiden, '-', 1)::INT AS n FROM obs)""".join(
        ["WITH obs AS (" + b.CTE["obs"] + ") ", ""]
    ),
)
def literal_maps(spark, d):
    o = b.obs(spark, d)
    code = F.concat(F.lit("ACGT-"), F.substring_index("leiden", "-", 1))
    return o.select(
        "cell_id",
        labels.mapped("status", {"P": "blood", "F": "liver tumor", "O": "adjacent normal liver tissue"}).alias("tissue"),
        labels.contains_ladder("leiden", {"URGENT": "pre-treatment", "HIGH": "post-treatment"}).alias("condition"),
        labels.pool_from_suffix(code, ["pool1", "pool2", "pool3"]).alias("pool"),
    )


@register(
    "number_functions",
    f"""SELECT l_orderkey, l_linenumber, abs(l_extendedprice - round_even(l_extendedprice, 0)) <= 1e-6 + 1e-5 * abs(round_even(l_extendedprice, 0)) AS whole,
    {s6('ln(1 + l_quantity * 1e4 / l_extendedprice)')} AS normed, {s6('ln(1 + 1e4 * l_quantity / greatest(l_discount, 1.0))')} AS clipped,
    round_even(l_quantity / 4, 0) + 0.0 AS rinted FROM lineitem""",
)
def number_functions(spark, d):
    li = b.table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        numbers.is_integer_like("l_extendedprice").alias("whole"),
        r6(numbers.log1p_norm("l_quantity", "l_extendedprice")).alias("normed"),
        r6(numbers.log1p_clipped("l_quantity", "l_discount")).alias("clipped"),
        (F.rint(F.col("l_quantity") / 4) + F.lit(0.0)).alias("rinted"),
    )


@register(
    "write_safe_cells",
    """SELECT cell_id, coalesce(trim(library_id), '') AS library_id, coalesce(sampleid, '') AS sampleid, CASE WHEN price > 100000 THEN status = 'F' ELSE FALSE END AS has_flag
    FROM obs""".join(["WITH obs AS (" + b.CTE["obs"] + ") ", ""]),
)
def write_safe_cells(spark, d):
    o = b.obs(spark, d).select(
        "cell_id", "library_id", "sampleid", F.when(F.col("price") > 100000, F.col("status") == "F").alias("has_flag")
    )
    return columns.write_safe(o)


@register(
    "keep_list_columns",
    """SELECT leiden, cell_id, '' AS donor_id, FALSE AS has_any_ab_tcr FROM obs""".join(["WITH obs AS (" + b.CTE["obs"] + ") ", ""]),
)
def keep_list_columns(spark, d):
    o = columns.drop_present(columns.reorder(b.obs(spark, d), ["leiden", "no_such"]), ["donor", "not_there"])
    return columns.keep_exactly(o, ["leiden", "cell_id", "donor_id", "has_any_ab_tcr"])


@register(
    "export_columns",
    """SELECT cell_id, gse_id AS "project name", coalesce(sampleid, '') AS sampleid, trim(library_id) AS barcodes FROM obs""".join(
        ["WITH obs AS (" + b.CTE["obs"] + ") ", ""]
    ),
)
def export_cells(spark, d):
    o = b.obs(spark, d)
    return export_columns(o, "gse_id", "sampleid", "library_id").select("cell_id", "`project name`", "sampleid", "barcodes")
