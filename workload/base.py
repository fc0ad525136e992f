"""Stand-ins: the given tables seen as cells, genes and counts, in Spark and in SQL.

Cells are orders, genes are parts, a count is the summed quantity of an order
line, datasets are nations, tissues are regions, clusters are priorities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquilt.session import partitions_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under ``name`` and, where SQL can say it, its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r6(c, digits: int = 6):
    """Rounded, with negative zero turned to zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- Spark side -------------------------------------------------------------


def count_parts(spark: SparkSession, d: str) -> int:
    """Partitions for the order lines, whose number is in the footers of the files."""
    return partitions_for(spark, table(spark, d, "lineitem").count())


def counts(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, gene, count; order lines of the same part are added up."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene"), "l_quantity"
    )
    # an order line hardly ever repeats its part, so rows go by cell at once and totals of cells need no further exchange
    return li.repartition(count_parts(spark, d), "cell_id").groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("count"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    cust = table(spark, d, "customer")
    nat = table(spark, d, "nation")
    reg = table(spark, d, "region")
    return cust.join(nat, cust.c_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Cell table; batch columns are blank for part of the cells."""
    o = table(spark, d, "orders")
    j = o.join(customers(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("n_name").alias("gse_id"),
        F.col("r_name").alias("tissue"),
        F.col("o_orderpriority").alias("leiden"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("annotation"),
        F.col("c_custkey").alias("donor"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderstatus") == "F", F.col("c_name")).otherwise(" ").alias("library_id"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("S"), F.col("c_nationkey"))).alias("sampleid"),
        F.when(F.col("o_totalprice") > 250000, F.col("c_mktsegment")).otherwise("").alias("sample_id"),
    )


def var(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("gene"),
        F.col("p_partkey").alias("gene_pos"),
        F.col("p_name").alias("symbol"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").alias("size"),
    )


def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts with the dataset of the cell."""
    return counts(spark, d).join(obs(spark, d).select("cell_id", "gse_id"), "cell_id")


def dataset_var(spark: SparkSession, d: str) -> DataFrame:
    """Gene axis of every dataset: the genes seen in it."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene"))
    seen = li.join(obs(spark, d).select("cell_id", "gse_id"), "cell_id").select("gse_id", "gene").distinct()
    return seen.join(var(spark, d), "gene")


def symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).join(var(spark, d).select("gene", "symbol"), "gene")


# --- SQL side ---------------------------------------------------------------

CTE = {
    "counts": "SELECT l_orderkey AS cell_id, l_partkey AS gene, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2",
    "obs": """SELECT o_orderkey AS cell_id, n_name AS gse_id, r_name AS tissue, o_orderpriority AS leiden,
        o_orderstatus AS status, c_mktsegment AS annotation, c_custkey AS donor, o_totalprice AS price,
        CASE WHEN o_orderstatus = 'F' THEN c_name ELSE ' ' END AS library_id,
        CASE WHEN o_orderstatus = 'O' THEN 'S' || c_nationkey END AS sampleid,
        CASE WHEN o_totalprice > 250000 THEN c_mktsegment ELSE '' END AS sample_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "gv": """SELECT p_partkey AS gene, p_partkey AS gene_pos, p_name AS symbol, p_brand AS brand,
        p_type AS type, p_size AS size FROM part""",
    "dcounts": "SELECT c.cell_id, c.gene, c.count, o.gse_id FROM counts c JOIN obs o USING (cell_id)",
    "dvar": "SELECT DISTINCT d.gse_id, g.* FROM dcounts d JOIN gv g USING (gene)",
    "totals": "SELECT cell_id, sum(count) AS total FROM counts GROUP BY 1",
}


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text with the named shared CTEs first, then the query's own."""
    parts = [f"{n} AS ({CTE[n]})" for n in names] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def s6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


# panels on part names: plain lists, sized like the real ones
EXTRACT_PANELS = {
    "t": ("red widget", "red bolt", "red ring", "red plate", "blue widget", "blue bolt", "blue ring", "blue plate"),
    "gd": ("hot widget", "hot bolt", "hot ring", "hot plate", "hot rod", "hot gizmo"),
    "nk": ("old widget", "old bolt", "old ring", "old plate", "old rod", "old gizmo", "new bolt", "new ring"),
    "nk_strong": ("old bolt", "old ring", "old plate", "old rod", "new bolt", "new ring"),
    "contam": ("small widget", "small bolt", "small ring", "small plate", "large widget", "large bolt"),
}
GROUP_PANELS = {
    "myeloid": ("red rod", "red gizmo", "blue rod"),
    "bcell": ("hot rod", "hot gizmo"),
    "epithelial": ("old rod", "old gizmo", "small rod", "small gizmo"),
    "erythroid": ("large rod", "large gizmo"),
    "platelet": ("small ring", "small plate"),
}
