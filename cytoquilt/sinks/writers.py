"""Sinks: reports, partitioned milestones, staged replacement, provenance."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquilt.session import materialize
from cytoquilt.sources.files import exists, remove, rename


def write_report(df: DataFrame, path: str, order: Sequence[str | Column], one_file: bool = True) -> None:
    """Sorted CSV with a header: one file, or a sorted set of files for what is no summary."""
    ordered = df.orderBy(*order)
    if one_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").option("header", True).csv(path)


def write_export(df: DataFrame, path: str) -> None:
    """Gzip CSV of all rows, as many files as tasks."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_milestone(
    df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write beside the target, re-read, check, and only then take its place."""
    spark = df.sparkSession
    staging, old = f"{path}.staging", f"{path}.previous"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    if check is not None:
        check(spark.read.parquet(staging))
    if exists(spark, path):
        if exists(spark, old):
            remove(spark, old)
        rename(spark, path, old)
    rename(spark, staging, path)
    if exists(spark, old):
        remove(spark, old)
    return spark.read.parquet(path)


def backup_once(spark: SparkSession, path: str, backup: str) -> bool:
    """Copy a table to its backup unless there is one; says whether it copied."""
    if not exists(spark, path) or exists(spark, backup):
        return False
    spark.read.parquet(path).write.mode("ignore").parquet(backup)
    return True


def write_by_dataset(df: DataFrame, path: str, dataset: str = "gse_id") -> DataFrame:
    """All datasets in one write, one folder each, files of bounded size; gives one row per dataset written.

    A dataset that comes again replaces its own folder and leaves the others. Each
    write is recorded beside the data, in ``<path>.commits``: dataset, rows, and
    the write's id and time, which ``dataset_commits`` reads.
    """
    write_id = uuid.uuid4().hex
    seen = df.groupBy(F.col(dataset).cast("string").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
    stamped = materialize(seen.select("dataset", "rows", F.lit(write_id).alias("write_id"), F.current_timestamp().alias("written")))
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 50_000_000)
    writer.partitionBy(dataset).parquet(path)
    # only once the data are in place
    stamped.write.mode("append").parquet(f"{path}.commits")
    return stamped


def dataset_commits(spark: SparkSession, path: str) -> DataFrame:
    """The last write of every dataset under ``path``: dataset, rows, write_id, written."""
    log = spark.read.parquet(f"{path}.commits")
    last = log.groupBy("dataset").agg(F.max_by(F.struct("rows", "write_id", "written"), F.struct("written", "write_id")).alias("_last"))
    return last.select("dataset", "_last.rows", "_last.write_id", "_last.written")


def provenance(spark: SparkSession, method: str, parameters: dict, gene_sets: dict[str, Sequence[str]], ranges: dict) -> DataFrame:
    """One-row record of a run."""
    row = (
        method,
        {k: str(v) for k, v in parameters.items()},
        {k: [str(g) for g in v] for k, v in gene_sets.items()},
        {k: {n: float(x) for n, x in v.items()} for k, v in ranges.items()},
    )
    schema = (
        "method string, parameters map<string,string>, gene_sets map<string,array<string>>, "
        "ranges map<string,map<string,double>>"
    )
    return spark.createDataFrame([row], schema).withColumn("made_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def write_provenance(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)
