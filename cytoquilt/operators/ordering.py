"""Row numbers, ranks and top rows that never gather a whole group in one task.

A hot group may hold a third of all rows, so a plain window over the group is
not safe. Here each group is cut into order-preserving buckets, the buckets are
counted (map-side combine, one small row per bucket), a running sum over the
bucket counts gives every bucket its offset, and only the rows inside one bucket
are ordered by a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.operators.joining import sized_join
from cytoquilt.session import materialize

HASH_BUCKETS = 65_536


def seeded_hash(id_cols: Sequence[str], seed: int | str) -> Column:
    """Hex digest used as a random but repeatable order of rows."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))


def hash_bucket(digest: Column) -> Column:
    """First four hex digits as a number: buckets follow the digest order."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def ranged(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` written in ranges of ``order`` of about equal size, with the range's number.

    The edges are sampled from the data, so ``name`` is monotone in the order
    whatever the values look like. It is written, since another run could sample
    other edges.
    """
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str, weight: Column | None = None) -> DataFrame:
    """One row per (keys, bucket): its size ``_n`` and the rows before it ``_before``.

    The running sum sees at most one row per bucket and group.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(*keys, bucket).agg(size.alias("_n"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))


def grouped_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    bucket: Column,
    name: str = "row_number",
) -> DataFrame:
    """Exact ``row_number`` per group; ``bucket`` must be monotone in the order."""
    work = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(work, keys, "_bucket").drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order_by)
    numbered = work.withColumn("_inside", F.row_number().over(inside))
    return (
        sized_join(numbered, offsets, [*keys, "_bucket"], "inner", computed=True)
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", "_bucket")
    )


ABOVE_ALL = "g"  # sorts behind every hex digest


def hash_cuts(digests: DataFrame, keys: Sequence[str], digest: str, targets: DataFrame) -> DataFrame:
    """(keys, ``_cut``, ``_ties``, ``_spare``) for every group of ``targets`` (keys, ``_want``) that has rows and a positive target.

    The ``_want`` rows of lowest digest are those below ``_cut`` and ``_ties`` of
    those at it; ``_spare`` more at it stay out, which only happens where rows
    repeat their ids. A histogram over digest prefixes finds the bucket of the cut,
    and only that bucket's rows are ordered.
    """
    keys = list(keys)
    work = digests.select(*keys, F.col(digest).alias("_digest"), hash_bucket(F.col(digest)).alias("_bucket"))
    sizes = work.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumns({"_before": F.sum("_n").over(along) - F.col("_n"), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
    asked = sizes.join(targets.select(*keys, F.col("_want").cast("long").alias("_want")).where("_want > 0"), keys)
    asked = materialize(asked.where("(_want >= _total and _before = 0) or (_want < _total and _before < _want and _want <= _before + _n)"))
    whole = asked.where("_want >= _total")
    whole = whole.select(*keys, F.lit(ABOVE_ALL).alias("_cut"), F.lit(0).cast("long").alias("_ties"), F.lit(0).cast("long").alias("_spare"))
    part = asked.where("_want < _total").select(*keys, "_bucket", (F.col("_want") - F.col("_before")).alias("_k"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_digest")
    rows = sized_join(work, part, [*keys, "_bucket"]).withColumns(
        {"_row": F.row_number().over(inside), "_first": F.rank().over(inside), "_same": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_bucket", "_digest"))}
    )
    ties = (F.col("_k") - F.col("_first") + 1).cast("long")
    cut = rows.where("_row = _k").select(*keys, F.col("_digest").alias("_cut"), ties.alias("_ties"), (F.col("_same") - ties).alias("_spare"))
    return whole.unionByName(cut)


def below_cuts(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str], digest: str, cuts: DataFrame, spare: bool) -> DataFrame:
    """Rows of ``df`` that :func:`hash_cuts` lets stay: one filter, and where ``spare`` says that ids repeat, a number within equal digests."""
    own = df.columns
    kept = sized_join(df, cuts, list(keys)).where(F.col(digest) <= F.col("_cut"))
    if spare:
        same = Window.partitionBy(*keys, digest).orderBy(*id_cols)
        kept = kept.withColumn("_row", F.row_number().over(same)).where((F.col(digest) < F.col("_cut")) | (F.col("_row") <= F.col("_ties")))
    return kept.select(*own)


def draw_lowest(
    df: DataFrame, id_cols: Sequence[str], steps: Sequence[tuple[Sequence[str], int | str, Callable[[DataFrame], DataFrame]]]
) -> DataFrame:
    """Rows of lowest seeded hash, in one or more steps, each drawing from what the step before has left.

    A step is (keys, seed, targets): ``targets`` gets the sizes of the groups it
    finds (keys, ``_size``) and gives (keys, ``_want``). Digests are written once
    with their keys and all steps are worked out on them, so ``df`` is evaluated
    twice whatever the steps: for the digests and for the rows.
    """
    steps = [([*keys] or ["_all"], seed, targets) for keys, seed, targets in steps]
    named = {f"_digest{i}": seeded_hash(id_cols, seed) for i, (_, seed, _) in enumerate(steps)}
    one_group = {"_all": F.lit(0)} if any(keys == ["_all"] for keys, _, _ in steps) else {}
    rows = df.withColumns({**one_group, **named})
    group_columns = list(dict.fromkeys(k for keys, _, _ in steps for k in keys))
    left = materialize(rows.select(*dict.fromkeys([*group_columns, *id_cols, *named])))
    for i, (keys, _, targets) in enumerate(steps):
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        cuts = materialize(hash_cuts(left, keys, f"_digest{i}", targets(sizes)))
        spare = not cuts.where("_spare > 0").isEmpty()
        left = below_cuts(left, keys, id_cols, f"_digest{i}", cuts, spare)
        rows = below_cuts(rows, keys, id_cols, f"_digest{i}", cuts, spare)
    return rows.select(*df.columns)


def take_lowest_hash(
    df: DataFrame,
    keys: Sequence[str],
    id_cols: Sequence[str],
    seed: int | str,
    target: str,
) -> DataFrame:
    """Keep, per group, the ``target`` rows with the lowest seeded hash.

    ``target`` is a column holding the wanted size of the row's group.
    """
    wanted = df.groupBy(*keys).agg(F.max(target).alias("_want")) if keys else df.agg(F.max(target).alias("_want")).withColumn("_all", F.lit(0))
    return draw_lowest(df, id_cols, [(keys, seed, lambda sizes: wanted)])


def distributed_min_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``rank`` with ties taking the lowest place, over the whole table.

    Distinct values are counted first, so any number of ties is one row; the
    running sums then work on one range of values at a time. ``df`` is read twice,
    so hand in a written table where it is costly to work out.
    """
    distinct = ranged(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), [value], "_part")
    totals = distinct.groupBy("_part").agg(F.sum("_n").alias("_bn"))
    # one row per range, so the unpartitioned running sum is bounded
    over_parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select("_part", (F.sum("_bn").over(over_parts) - F.col("_bn")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranks = (
        distinct.withColumn("_run", F.sum("_n").over(inside) - F.col("_n"))
        .join(offsets, "_part")
        .select(value, (F.col("_run") + F.col("_before") + F.lit(1)).alias(name))
    )
    return sized_join(df, ranks, value, "inner", computed=True)
