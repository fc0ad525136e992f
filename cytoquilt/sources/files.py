"""File listing through the cluster's own file system, whatever it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def glob_paths(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Existing paths for several glob patterns, each once, in pattern order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, None] = {}
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        statuses = path.getFileSystem(conf).globStatus(path)
        for status in sorted(str(s.getPath().toString()) for s in (statuses or [])):
            found.setdefault(status)
    return list(found)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def rename(spark: SparkSession, old: str, new: str) -> None:
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(Path(old), Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def plain_path(path: Column) -> Column:
    """One spelling of a path: as given or as a scan reports it, local ones without scheme, escapes undone."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(decoded, "^file:/+", "/")
