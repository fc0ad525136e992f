"""Samples, top rows and numbering."""

from pyspark.sql import functions as F

from cytoquilt.operators import ordering, sampling
from workload import base as b
from workload.base import register, s6, with_ctes


def md5_order(key, seed):
    return f"md5({key} || '|{seed}'), {key}"


@register(
    "fixed_sample",
    f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY {md5_order('o_orderkey', 1)}) AS rn FROM orders) WHERE rn <= 3000",
)
def fixed_sample(spark, d):
    return sampling.fixed_sample(b.table(spark, d, "orders").select("o_orderkey"), 3000, ["o_orderkey"], 1)


@register(
    "nested_sample",
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {md5_order('o_orderkey', 2)}) AS r2 FROM
    (SELECT *, row_number() OVER (ORDER BY {md5_order('o_orderkey', 1)}) AS rn FROM orders) WHERE rn <= 3000) WHERE r2 <= 800""",
)
def nested_sample(spark, d):
    return sampling.nested_sample(b.table(spark, d, "orders").select("o_orderkey"), [(3000, 1), (800, 2)], ["o_orderkey"])


@register(
    "per_group_sample",
    with_ctes(
        ["obs"],
        f"SELECT cell_id, gse_id FROM (SELECT *, row_number() OVER (PARTITION BY gse_id ORDER BY {md5_order('cell_id', 42)}) AS rn FROM obs) WHERE rn <= 50",
    ),
)
def per_group_sample(spark, d):
    return sampling.per_group_sample(b.obs(spark, d).select("cell_id", "gse_id"), ["gse_id"], 50, ["cell_id"])


@register(
    "per_group_sample_large",
    with_ctes(
        ["obs"],
        f"SELECT cell_id, leiden FROM (SELECT *, row_number() OVER (PARTITION BY leiden ORDER BY {md5_order('cell_id', 42)}) AS rn FROM obs) WHERE rn <= 1500",
    ),
)
def per_group_sample_large(spark, d):
    return sampling.per_group_sample(b.obs(spark, d).select("cell_id", "leiden"), ["leiden"], 1500, ["cell_id"])


def _two_step(want, by, n, seed):
    return with_ctes(
        ["obs"],
        f"SELECT cell_id, {by} FROM (SELECT *, row_number() OVER (ORDER BY {md5_order('cell_id', seed + 1)}) AS r2 FROM drawn) WHERE r2 <= {n}",
        {
            "sz": f"SELECT {by}, count(*) AS size, (SELECT count(*) FROM obs) AS total FROM obs GROUP BY 1",
            "tg": f"SELECT {by}, least(size, {want})::BIGINT AS want FROM sz",
            "drawn": f"""SELECT cell_id, {by} FROM (SELECT o.cell_id, o.{by}, t.want, row_number() OVER (PARTITION BY o.{by} ORDER BY {md5_order('o.cell_id', seed)}) AS rn
                FROM obs o JOIN tg t ON t.{by} = o.{by}) WHERE rn <= want""",
        },
    )


@register("floor_sample", _two_step("greatest(500, round_even(least(2000, total) * (size / total), 0))", "leiden", 2000, 1))
def floor_sample(spark, d):
    return sampling.floor_sample(b.obs(spark, d).select("cell_id", "leiden"), "leiden", 2000, ["cell_id"])


@register("proportional_sample", _two_step("CASE WHEN total <= 1000 THEN size ELSE greatest(1, floor(1000 * (size / total))) END", "gse_id", 1000, 0))
def proportional_sample(spark, d):
    return sampling.proportional_sample(b.obs(spark, d).select("cell_id", "gse_id"), "gse_id", 1000, ["cell_id"])


STRATA_CTES = {
    "sz": "SELECT gse_id, leiden, count(*) AS cells FROM obs GROUP BY 1, 2",
    "s1": "SELECT *, least(cells, greatest(1, least(12, floor(1200 * cells / (SELECT sum(cells) FROM sz)))))::BIGINT AS t FROM sz",
    "s2": """SELECT *, CASE WHEN (SELECT sum(t) FROM s1) > 1200 THEN least(cells, greatest(1, floor(t * (1200.0::DOUBLE / (SELECT sum(t) FROM s1)))))::BIGINT ELSE t END AS t2 FROM s1""",
    "s3": """SELECT gse_id, leiden, cells, CASE WHEN t2 > 1 AND row_number() OVER (PARTITION BY t2 <= 1 ORDER BY t2 DESC, gse_id, leiden) <= (SELECT sum(t2) FROM s2) - 1200
        THEN t2 - 1 ELSE t2 END AS target_cells FROM s2""",
}


@register("strata_targets", with_ctes(["obs"], f"SELECT gse_id, leiden, cells, target_cells, {s6('target_cells / cells')} AS selection_fraction FROM s3", STRATA_CTES))
def strata_targets(spark, d):
    return b.rounded(sampling.strata_targets(b.obs(spark, d), ["gse_id", "leiden"], 1200, 12), "selection_fraction")


TIGHT = {k: v.replace("1200.0", "90.0").replace("1200", "90") for k, v in STRATA_CTES.items()}


@register("strata_targets_tight", with_ctes(["obs"], f"SELECT gse_id, leiden, cells, target_cells, {s6('target_cells / cells')} AS selection_fraction FROM s3", TIGHT))
def strata_targets_tight(spark, d):
    return b.rounded(sampling.strata_targets(b.obs(spark, d), ["gse_id", "leiden"], 90, 12), "selection_fraction")


@register(
    "strata_sample",
    with_ctes(
        ["obs"],
        f"""SELECT cell_id, gse_id, leiden FROM (SELECT o.cell_id, o.gse_id, o.leiden, s.target_cells, row_number() OVER (PARTITION BY o.gse_id, o.leiden
        ORDER BY {md5_order('o.cell_id', 0)}) AS rn FROM obs o JOIN s3 s ON s.gse_id = o.gse_id AND s.leiden = o.leiden) WHERE rn <= target_cells""",
        STRATA_CTES,
    ),
)
def strata_sample(spark, d):
    o = b.obs(spark, d).select("cell_id", "gse_id", "leiden")
    return sampling.strata_sample(o, ["gse_id", "leiden"], 1200, ["cell_id"], per_stratum=12).select("cell_id", "gse_id", "leiden")


@register("systematic_sample", "SELECT o_orderkey FROM orders WHERE (o_orderkey % 1000) % 35 = 0")
def systematic_sample(spark, d):
    """Every 35th row of every block of 1,000: the operator itself is a stride."""
    return sampling.systematic_sample(b.table(spark, d, "orders").select("o_orderkey"), 35, 1000, "o_orderkey")


@register("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def top_orders(spark, d):
    return sampling.top_rows(b.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 500, ["o_orderkey"])


@register(
    "collapsed_categories",
    with_ctes(
        ["obs"],
        """SELECT cell_id, CASE WHEN gse_id IN (SELECT gse_id FROM obs GROUP BY 1 ORDER BY count(*) DESC, gse_id LIMIT 7) THEN gse_id ELSE 'other' END AS gse_id FROM obs""",
    ),
)
def collapsed_categories(spark, d):
    return sampling.collapse_categories(b.obs(spark, d).select("cell_id", "gse_id"), "gse_id", 7)


@register(
    "duplicate_suffixes",
    """SELECT event_id, CASE WHEN rn > 1 THEN n || '__dup' || (rn - 1) ELSE n END AS unique_name FROM (SELECT event_id, n,
    row_number() OVER (PARTITION BY n ORDER BY event_id) AS rn FROM (SELECT event_id, CASE WHEN value > 20 THEN 'hot' ELSE 'u' || user_id END AS n FROM events))""",
)
def duplicate_suffixes(spark, d):
    name = F.when(F.col("value") > 20, "hot").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    e = b.table(spark, d, "events").select("event_id", name.alias("n"))
    out = ordering.grouped_row_number(e, ["n"], [F.col("event_id")], F.floor(F.col("event_id") / 512).cast("long"), "rn")
    unique = F.when(F.col("rn") > 1, F.concat_ws("__dup", "n", (F.col("rn") - 1).cast("string"))).otherwise(F.col("n"))
    return out.select("event_id", unique.alias("unique_name"))


@register("global_min_rank", "SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate_n) AS r FROM (SELECT o_orderkey, floor(o_totalprice / 10) AS o_orderdate_n FROM orders)")
def global_min_rank(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 10).alias("v"))
    return ordering.distributed_min_rank(o, "v", "r").select("o_orderkey", "r")
