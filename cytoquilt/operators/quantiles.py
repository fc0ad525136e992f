"""Exact quantiles (linear interpolation) for groups of any size.

Distinct values are counted per group, with sums in the tasks first, and laid out
by ranges of (group, value) whose edges Spark samples from the data. Each range
is one task's work: totals per range find the range that holds a wanted rank, and
only the values of those ranges are summed up in order. A hot group, heavy tails
and NaN make no range larger than another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.operators.joining import sized_join
from cytoquilt.operators.ordering import bucket_offsets, ranged
from cytoquilt.session import materialize, partitions_by_rows


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None, rows: int | None = None
) -> DataFrame:
    """One row per group with one column per entry of ``probs``.

    ``weight`` says how many times a row counts, which lets implicit zeros enter
    as a single row. NULL values are left out; NaN is larger than any number. ``rows``
    is the number of rows of ``df``, where known: many get more ranges than the session has partitions.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    known = df.where(F.col(value).isNotNull())
    work = known.select(*keys, F.col(value).cast("double").alias("_v"), w.cast("long").alias("_w")).where("_w > 0")
    with partitions_by_rows(df.sparkSession, rows):
        values = ranged(work.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c")), [*keys, "_v"], "_part")
    hist = bucket_offsets(values, keys, "_part", F.col("_c"))
    hist = hist.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    named = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
            for name, p in probs.items()
        ]
    )
    asked = hist.withColumn("_ask", F.explode(named)).select(
        *keys, "_part", "_n", "_before", F.col("_ask.name").alias("_name"), F.col("_ask.pos").alias("_pos")
    )
    # zero-based ranks needed: floor(pos) and ceil(pos), each in exactly one range
    asked = asked.select(
        "*", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank")
    ).where("_rank >= _before and _rank < _before + _n")
    wanted = materialize(asked.select(*keys, "_part", "_before", "_name", "_pos", "_rank"))
    kept = sized_join(values, wanted.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi")
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    hit = (
        kept.withColumn("_upto", F.sum("_c").over(inside))
        .join(wanted, [*keys, "_part"])
        .withColumn("_local", F.col("_rank") - F.col("_before"))
        .where("_local < _upto and _local >= _upto - _c")
    )
    frac = F.max(F.col("_pos") - F.floor("_pos"))
    lower = F.min_by("_v", "_rank")
    upper = F.max_by("_v", "_rank")
    between = F.when(frac == 0, lower).otherwise(lower * (1 - frac) + upper * frac)
    picked = hit.groupBy(*keys, "_name").agg(between.alias("_q"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probs]
    )
