"""Tabular inputs: registry, counts, cell tables, harmonised metadata."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquilt.functions.columns import quote, require_columns
from cytoquilt.operators.audit import category_a
from cytoquilt.operators.metadata import stack_sources
from cytoquilt.schema import REGISTRY
from cytoquilt.sources.files import exists

log = logging.getLogger(__name__)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Dataset registry; fails where a required column is missing."""
    df = spark.read.option("header", True).csv(path)
    return require_columns(df, REGISTRY.fieldNames())


def read_category_a(spark: SparkSession, path: str) -> DataFrame:
    """Usable datasets of a written audit table, sorted; fails where there is none."""
    return category_a(spark.read.option("header", True).csv(path)).select("gse_id", "h5ad_path")


def read_counts(spark: SparkSession, path: str, datasets: Sequence[str] | None = None) -> DataFrame:
    """Long counts; a dataset list prunes partitions and is pushed to the scan."""
    df = spark.read.parquet(path)
    return df if datasets is None else df.where(F.col("gse_id").isin(*datasets))


def read_cells(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns of a cell table."""
    df = require_columns(spark.read.parquet(path), columns)
    return df.select(*[F.col(quote(c)) for c in columns])


def read_metadata(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Several metadata CSVs as text, stacked in order; missing files are skipped.

    ``src_priority`` says which file a row came from, ``row_ord`` its place there.
    """
    frames = []
    for path in paths:
        if not exists(spark, path):
            log.warning("metadata file not found, skipped: %s", path)
            continue
        df = spark.read.option("header", True).option("multiLine", False).csv(path)
        if columns is not None:
            df = df.select(*[F.col(quote(c)) for c in columns if c in df.columns])
        # file splits start at known offsets, rows keep their order inside a split
        frames.append(
            df.withColumns(
                {"_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
            ).withColumn("row_ord", F.struct("_start", "_id")).drop("_start", "_id")
        )
    return stack_sources(frames)


def prepared_or(spark: SparkSession, path: str, build) -> DataFrame:
    """Reads ``path`` where it is there already, else builds it, beside the target first, and reads it."""
    if not exists(spark, path):
        from cytoquilt.sinks.writers import write_milestone

        write_milestone(build(), path)
    return spark.read.parquet(path)


def pool_donors(wide: DataFrame, skip: Sequence[str] = (), row: str = "row_ord", prefixes: Sequence[str] = ("", "chip1", "chip2")) -> DataFrame:
    """Wide pool table to (pool, donors): values ';'-joined in row order, with prefixed copies."""
    pools = [c for c in wide.columns if c not in (*skip, row)]
    long = wide.select(row, *[F.col(quote(p)).cast("string") for p in pools]).unpivot(
        [row], [F.col(quote(p)) for p in pools], "pool", "donor"
    )
    joined = long.groupBy("pool").agg(
        F.array_sort(F.collect_list(F.struct(row, F.coalesce("donor", F.lit("nan")).alias("donor")))).alias("_d")
    )
    names = F.array(*[F.concat(F.lit(p), F.col("pool")) for p in prefixes])
    return joined.select(F.explode(names).alias("pool"), F.concat_ws(";", F.col("_d.donor")).alias("donors"))
