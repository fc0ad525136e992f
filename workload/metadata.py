"""Metadata joins, keys and checks."""

from pyspark.sql import functions as F

from cytoquilt.operators import metadata, validate
from workload import base as b
from workload.base import register, with_ctes

OBS = ["obs"]


@register(
    "metadata_one_to_one",
    """SELECT o_orderkey, o_orderpriority, o_totalprice,
    coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN c_name ELSE '' END, ''), o_orderpriority) AS sample_label
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def metadata_one_to_one(spark, d):
    cells = b.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    o = b.table(spark, d, "orders").join(b.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    meta = o.select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("c_name")).otherwise("").alias("sample_label")
    )
    return metadata.join_one_to_one(cells, meta, ["o_orderkey"], {"sample_label": "o_orderpriority"})


DOCMETA = "SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS metadata_matched FROM documents d LEFT JOIN labels l USING (doc_id)"


def _attached(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "lang")
    lab = b.table(spark, d, "labels").withColumn("lang", F.lit("not taken"))
    return metadata.attach_new_columns(docs, lab, "doc_id")


@register("metadata_new_columns", DOCMETA)
def metadata_new_columns(spark, d):
    return _attached(spark, d)


@register(
    "metadata_match_summary",
    f"""SELECT count(*) AS cells, count(*) FILTER (metadata_matched) AS metadata_matches,
    count(*) FILTER (NOT metadata_matched) AS metadata_unmatched FROM ({DOCMETA})""",
)
def metadata_match_summary(spark, d):
    return metadata.match_summary(_attached(spark, d))


@register(
    "metadata_filling",
    with_ctes(
        OBS,
        """SELECT cell_id, coalesce(nullif(trim(library_id), ''), c_name) AS library_id, coalesce(nullif(trim(sampleid), ''), 'NAT' || c_nationkey) AS sampleid,
        c_mktsegment AS condition_meta FROM obs LEFT JOIN customer ON donor = c_custkey""",
    ),
)
def metadata_filling(spark, d):
    c = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("donor"),
        F.col("c_name").alias("library_id"),
        F.concat(F.lit("NAT"), F.col("c_nationkey").cast("string")).alias("sampleid"),
        F.col("c_mktsegment").alias("condition"),
    )
    out = metadata.attach_filling(b.obs(spark, d), c, "donor", ["library_id", "sampleid"], {"condition": "condition_meta"})
    return out.select("cell_id", "library_id", "sampleid", "condition_meta")


# order lines as metadata of orders: several lines a key, every seventh key blank on both sides
REPEATED = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'k' || o_orderkey END AS mk,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS sampleid FROM orders),
    m AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE 'k' || l_orderkey END AS mk, 'p' || l_partkey AS sampleid, l_returnflag AS condition,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS rn FROM lineitem),
    f AS (SELECT * FROM m WHERE mk <> '' AND rn = 1)"""


def _repeated(spark, d):
    key = lambda c: F.when(F.col(c) % 7 == 0, "").otherwise(F.concat(F.lit("k"), F.col(c).cast("string")))
    cells = b.table(spark, d, "orders").select(
        "o_orderkey", key("o_orderkey").alias("mk"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("sampleid")
    )
    meta = b.table(spark, d, "lineitem").select(
        key("l_orderkey").alias("mk"), "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("sampleid"),
        F.col("l_returnflag").alias("condition"), F.col("l_partkey").alias("part"),
    )
    return cells, meta, ["l_linenumber", "part", "condition"]


@register(
    "metadata_filling_repeated_keys",
    f"""{REPEATED} SELECT o_orderkey, coalesce(nullif(trim(o.sampleid), ''), f.sampleid) AS sampleid, f.condition AS condition_meta
    FROM o LEFT JOIN f USING (mk)""",
)
def metadata_filling_repeated_keys(spark, d):
    cells, meta, order = _repeated(spark, d)
    out = metadata.attach_filling(cells, meta, "mk", ["sampleid"], {"condition": "condition_meta"}, order)
    return out.select("o_orderkey", F.nullif("sampleid", F.lit("")).alias("sampleid"), "condition_meta")


@register(
    "metadata_new_columns_repeated_keys",
    f"{REPEATED} SELECT o_orderkey, f.condition, f.mk IS NOT NULL AS metadata_matched FROM o LEFT JOIN f USING (mk)",
)
def metadata_new_columns_repeated_keys(spark, d):
    cells, meta, order = _repeated(spark, d)
    return metadata.attach_new_columns(cells, meta, "mk", order).select("o_orderkey", "condition", "metadata_matched")


@register(
    "keep_first_rows",
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)
def keep_first_rows(spark, d):
    e = b.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return metadata.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@register(
    "stacked_metadata",
    """SELECT id, name, src_priority FROM (SELECT id, name, src_priority, row_number() OVER (PARTITION BY id ORDER BY src_priority) AS rn FROM (
      SELECT c_custkey AS id, min(c_name) AS name, 0 AS src_priority FROM customer GROUP BY 1
      UNION ALL SELECT s_suppkey * 3, min(s_name), 1 FROM supplier GROUP BY 1
      UNION ALL SELECT o_orderkey, o_orderpriority, 2 FROM orders)) WHERE rn = 1""",
)
def stacked_metadata(spark, d):
    # keys of the three sources overlap in part: every customer, every third number, every order
    c = b.table(spark, d, "customer").groupBy(F.col("c_custkey").alias("id"))
    s = b.table(spark, d, "supplier").groupBy((F.col("s_suppkey") * 3).alias("id"))
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    both = metadata.stack_sources([c.agg(F.min("c_name").alias("name")), s.agg(F.min("s_name").alias("name")), o])
    return metadata.keep_first(both, ["id"], ["src_priority"])


@register(
    "lookup_map",
    """SELECT o_orderkey, coalesce(a.v, o_orderpriority) AS mapped, coalesce(a.v, '') AS mapped_or_blank FROM orders
    LEFT JOIN (SELECT l_returnflag AS k, 'flag ' || l_returnflag AS v FROM lineitem GROUP BY 1) a ON CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE o_orderpriority END = a.k""",
)
def lookup_map(spark, d):
    flags = b.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("k"), F.concat(F.lit("flag "), "l_returnflag").alias("v")
    ).distinct()
    key = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise(F.col("o_orderpriority"))
    o = b.table(spark, d, "orders").select("o_orderkey", key.alias("key"))
    out = metadata.lookup_map(o, flags, "key", "k", "v", "mapped")
    return metadata.lookup_map(out, flags, "key", "k", "v", "mapped_or_blank", "").drop("key")


@register(
    "unique_symbol_map",
    """SELECT symbol, target FROM (SELECT p_name AS symbol, CASE WHEN p_size > 10 THEN p_brand END AS target,
    row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part WHERE p_size > 10) WHERE rn = 1""",
)
def unique_symbol_map(spark, d):
    p = b.table(spark, d, "part").withColumn("target", F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" "))
    return metadata.unique_symbol_map(p, "p_name", "target", "p_partkey")


@register("copied_labels", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def copied_labels(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", F.lit(7).alias("quality"))
    return metadata.copy_labels(docs, b.table(spark, d, "labels"), "doc_id", ["quality", "toxic", "not_there"])


@register(
    "replaced_columns",
    with_ctes(OBS, "SELECT cell_id, gse_id, coalesce(n, 0) AS n_lines FROM obs LEFT JOIN (SELECT l_orderkey AS cell_id, count(*) AS n FROM lineitem GROUP BY 1) USING (cell_id)"),
)
def replaced_columns(spark, d):
    n = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    cells = b.obs(spark, d).select("cell_id", "gse_id", F.lit(-1).alias("n_lines"))
    return metadata.replace_columns(cells, n, "cell_id").fillna(0, subset=["n_lines"])


@register(
    "carved_out",
    with_ctes(OBS, "SELECT gse_id, count(*) AS n FROM obs WHERE gse_id NOT IN ('NATION_1', 'NATION_7') GROUP BY 1"),
)
def carved_out(spark, d):
    rest, _ = metadata.carve_out(b.obs(spark, d), "gse_id", ["NATION_1", "NATION_7"])
    return rest.groupBy("gse_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "cells_with_metadata",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def cells_with_metadata(spark, d):
    return metadata.with_metadata(b.table(spark, d, "documents"), b.table(spark, d, "labels"), ["doc_id"]).select("doc_id", "source")


@register("duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return validate.duplicate_keys(b.table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@register(
    "readback_report",
    with_ctes(
        OBS,
        """SELECT count(*) AS rows, count(*) FILTER (coalesce(sampleid, '') = '') AS blank_keys,
        count(*) - count(DISTINCT (gse_id, coalesce(sampleid, ''))) AS duplicate_rows FROM obs""",
    ),
)
def readback_report(spark, d):
    return validate.readback_report(b.obs(spark, d), ["gse_id", "sampleid"])


@register(
    "axis_report",
    """WITH a AS (SELECT c_custkey AS k FROM customer), g AS (SELECT DISTINCT o_custkey * 2 AS k FROM orders),
    n AS (SELECT (SELECT count(*) FROM a) AS current_n, (SELECT count(*) FROM g) AS rebuilt_n,
    (SELECT count(*) FROM a ANTI JOIN g USING (k)) AS only_current, (SELECT count(*) FROM g ANTI JOIN a USING (k)) AS only_rebuilt)
    SELECT *, TRUE AS keys_unique, only_current = 0 AND only_rebuilt = 0 AS set_equal, only_current = 0 AS current_subset_of_rebuilt FROM n""",
)
def axis_report(spark, d):
    """Customers against doubled numbers of those who order: names on either side only."""
    a = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    g = b.table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("k")).distinct()
    return validate.axis_report(a, g, "k")


@register(
    "one_sided_names",
    "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1",
)
def one_sided_names(spark, d):
    a = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return validate.one_sided(a, b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@register(
    "reconciled_counts",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS expected_n, coalesce(b.n, 0) AS observed_n, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches
    FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k""",
)
def reconciled_counts(spark, d):
    a = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("e"))
    s = b.table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("o"))
    return validate.reconcile_counts(a, s, "k", "e", "o")
