"""Session helpers: a tuned builder and a lineage cut that survives executor loss."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Names of bucketed tables begin with this.
BUCKETED = "cytoquilt_bucketed_"


def build_session(app: str = "cytoquilt", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive planning on; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named a temporary folder is taken, but only on one machine: on
    a cluster each executor would write to a disk that no other can read.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of a long count table that one task is to hold.
ROWS_PER_TASK = 250_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many rows: the session's, or more where a task would hold over ``ROWS_PER_TASK``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


@contextmanager
def partitions_by_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What runs inside shuffles into :func:`partitions_for` so many rows, not put together again, where that is more than the session's.

    Sums are still made in the tasks before the shuffle, which ``repartition`` would not allow. The settings
    are the session's and are put back at the end.
    """
    parts = "spark.sql.shuffle.partitions"
    n = partitions_for(spark, rows or 0)
    # sums in the tasks before the shuffle grow with what a task reads
    wanted = {parts: str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "16m"} if n > int(spark.conf.get(parts)) else {}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it from there.

    Used where one result feeds several later steps (gene means, group sizes,
    panel maps), so that a lost executor costs a re-read and not a re-run. The
    copy is columnar: later steps read only the columns they need, and its known
    size lets the planner choose the join.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` once as a table of the session's catalog in the shared folder, bucketed and sorted by ``keys``.

    The rows are shuffled here and no more: grouping, windows and joins by the keys
    find them where they are. ``buckets`` defaults to the session's shuffle partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{BUCKETED}{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    # one task a bucket, so a bucket is one file
    work = df.repartition(n, *keys)
    work.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def drop_materialized(spark: SparkSession) -> None:
    """Remove what the two functions above have written for this session, once no frame reads it any more."""
    from cytoquilt.sources.files import remove

    for table in spark.catalog.listTables(pattern=f"{BUCKETED}*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    remove(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables")
