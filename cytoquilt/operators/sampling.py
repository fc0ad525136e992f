"""Repeatable samples, top rows and top categories.

Rows are ordered by an md5 of their id and a seed, so a sample does not depend
on partitioning. Sizes follow the method; the members differ from any other
random generator's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.operators.ordering import draw_lowest, grouped_row_number, seeded_hash
from cytoquilt.session import materialize


def wanted(n: int) -> Callable[[DataFrame], DataFrame]:
    """The same target for every group."""
    return lambda sizes: sizes.withColumn("_want", F.lit(n))


def fixed_sample(df: DataFrame, n: int, id_cols: Sequence[str], seed: int | str = 1) -> DataFrame:
    """``n`` rows of the whole table (all rows where it has fewer)."""
    return draw_lowest(df, id_cols, [([], seed, wanted(n))])


def nested_sample(df: DataFrame, sizes: Sequence[tuple[int, int | str]], id_cols: Sequence[str]) -> DataFrame:
    """A sample of a sample, and so on: (rows, seed) of each step; the input is evaluated twice however many there are."""
    return draw_lowest(df, id_cols, [([], seed, wanted(n)) for n, seed in sizes])


def per_group_sample(df: DataFrame, by: Sequence[str], n: int, id_cols: Sequence[str], seed: int | str = 42) -> DataFrame:
    """Up to ``n`` rows per group.

    The rows of lowest seeded hash are drawn, whichever way: below 1,000, where
    Spark can cut a window in the tasks, every task first keeps only its own best
    ``n`` rows per group; above it hash buckets are counted.
    """
    if n < 1000:
        w = Window.partitionBy(*by).orderBy(seeded_hash(id_cols, seed), *id_cols)
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return draw_lowest(df, id_cols, [(by, seed, wanted(n))])


def floor_sample(
    df: DataFrame, by: str, n: int, id_cols: Sequence[str], seed: int = 1, floor: int = 500
) -> DataFrame:
    """Proportional per cluster but at least ``floor`` each, then capped at ``n``."""

    def targets(sizes: DataFrame) -> DataFrame:
        total = sizes.select(F.sum("_size")).scalar()
        share = F.rint(F.least(F.lit(n), total) * (F.col("_size") / total))
        return sizes.withColumn("_want", F.least(F.col("_size"), F.greatest(F.lit(floor), share)).cast("long"))

    return draw_lowest(df, id_cols, [([by], seed, targets), ([], seed + 1, wanted(n))])


def proportional_sample(df: DataFrame, by: str, n: int, id_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """Proportional per dataset, at least one row each, capped at ``n``."""

    def targets(sizes: DataFrame) -> DataFrame:
        total = sizes.select(F.sum("_size")).scalar()
        share = F.greatest(F.lit(1), F.floor(F.lit(n) * (F.col("_size") / total)))
        return sizes.withColumn("_want", F.when(total <= n, F.col("_size")).otherwise(F.least(F.col("_size"), share)).cast("long"))

    return draw_lowest(df, id_cols, [([by], seed, targets), ([], seed + 1, wanted(n))])


def strata_targets(df: DataFrame, by: Sequence[str], n: int, per_stratum: int = 2000) -> DataFrame:
    """Allocation of ``n`` rows to strata: floor share, clipped, scaled, trimmed.

    What is still too much after scaling comes off one row at a time from the
    largest strata that have more than one.
    """
    by = list(by)
    return targets_of(df.groupBy(*by).agg(F.count(F.lit(1)).alias("cells")), by, n, per_stratum)


def targets_of(sizes: DataFrame, by: Sequence[str], n: int, per_stratum: int) -> DataFrame:
    """The allocation from the strata's sizes alone (``by``, ``cells``)."""
    sizes = materialize(sizes)
    total = sizes.select(F.sum("cells")).scalar()
    share = F.floor(F.lit(n) * F.col("cells") / total)
    first = F.least(F.col("cells"), F.greatest(F.lit(1), F.least(F.lit(per_stratum), share)))
    step1 = sizes.withColumn("_t", first.cast("long"))
    given = step1.select(F.sum("_t")).scalar()
    shrunk = F.least(F.col("cells"), F.greatest(F.lit(1), F.floor(F.col("_t") * (F.lit(float(n)) / given))))
    step2 = step1.withColumn("_t2", F.when(given > n, shrunk).otherwise(F.col("_t")).cast("long"))
    surplus = step2.select(F.sum("_t2") - F.lit(n)).scalar()
    reducible = step2.withColumn("_one", F.col("_t2") <= 1)
    ranked = grouped_row_number(
        reducible, ["_one"], [F.desc("_t2"), *[F.asc(c) for c in by]], -F.col("_t2"), "_rank"
    )
    final = F.when(~F.col("_one") & (F.col("_rank") <= surplus), F.col("_t2") - 1).otherwise(F.col("_t2"))
    return ranked.select(
        *by, "cells", final.alias("target_cells"), (final / F.col("cells")).alias("selection_fraction")
    )


def strata_sample(
    df: DataFrame, by: Sequence[str], n: int, id_cols: Sequence[str], seed: int = 0, per_stratum: int = 2000
) -> DataFrame:
    """Rows drawn by :func:`strata_targets`."""

    def targets(sizes: DataFrame) -> DataFrame:
        return targets_of(sizes.withColumnRenamed("_size", "cells"), list(by), n, per_stratum).withColumnRenamed("target_cells", "_want")

    return draw_lowest(df, id_cols, [(by, seed, targets)])


def systematic_sample(df: DataFrame, every: int, chunk: int, position: str) -> DataFrame:
    """Every ``every``-th row, counting anew at each chunk start."""
    return df.where(F.pmod(F.pmod(F.col(position), F.lit(chunk)), F.lit(every)) == 0)


def top_rows(df: DataFrame, by: str, n: int, id_cols: Sequence[str]) -> DataFrame:
    """The ``n`` highest rows; ids break ties."""
    return df.orderBy(F.desc(by), *id_cols).limit(n)


def collapse_categories(df: DataFrame, column: str, top: int = 15, other: str = "other", out: str | None = None) -> DataFrame:
    """Keep the ``top`` most frequent values, the rest become ``other``."""
    best = (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), column)
        .limit(top)
        .select(column, F.lit(True).alias("_top"))
    )
    # ``best`` has at most ``top`` rows
    return (
        df.join(F.broadcast(best), column, "left")
        .withColumn(out or column, F.when(F.col("_top"), F.col(column)).otherwise(other))
        .drop("_top")
    )
