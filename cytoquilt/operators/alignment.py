"""Stacking datasets and lining up cells and genes of two versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquilt.functions.genes import is_noncoding_name
from cytoquilt.functions.numbers import is_integer_like
from cytoquilt.operators.matrix import CELL
from cytoquilt.operators.validate import require_unique

INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1


def stack_counts(frames: Sequence[DataFrame]) -> DataFrame:
    """Outer stack of long counts: a gene missing in one dataset is simply absent."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def stack_cells(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def align_to_base(counts: DataFrame, base: DataFrame) -> DataFrame:
    """Counts of base genes only; absent base genes are zero by the data model."""
    return counts.join(base.select("gene"), "gene", "left_semi")


def drop_noncoding(counts: DataFrame, symbol: str = "gene") -> DataFrame:
    return counts.where(~is_noncoding_name(symbol))


def rescue_counts(raw: DataFrame, current_genes: DataFrame) -> DataFrame:
    """Raw counts of the current genes; fails where a current gene has no raw source.

    ``raw_genes`` of the raw matrix are those that occur in ``raw``.
    """
    missing = current_genes.select("gene").join(raw.select("gene"), "gene", "left_anti").limit(10).collect()
    if missing:
        raise ValueError(f"current genes absent from the raw matrix: {[r[0] for r in missing]}")
    return align_to_base(raw, current_genes)


def integer_report(counts: DataFrame) -> DataFrame:
    """One row: stored values, range, whole-number check, fits 32-bit integers."""
    row = counts.agg(
        F.count(F.lit(1)).alias("nnz"),
        F.coalesce(F.min("count"), F.lit(0.0)).alias("min_value"),
        F.coalesce(F.max("count"), F.lit(0.0)).alias("max_value"),
        F.coalesce(F.bool_and(is_integer_like("count")), F.lit(True)).alias("integer_like"),
    )
    fits = F.col("integer_like") & (F.col("min_value") >= INT32_MIN) & (F.col("max_value") <= INT32_MAX)
    return row.withColumn("fits_int32", fits)


def align_counts(
    counts: DataFrame, current_cells: DataFrame, current_genes: DataFrame, key: str | None = None,
    cell: Sequence[str] = CELL,
) -> DataFrame:
    """Rebuilt counts on the current cells and genes.

    With ``key`` the cells are matched by that alignment key, which has to be
    unique on both sides; the result carries the current cell ids.
    """
    rows = align_to_base(counts, current_genes)
    if key is None:
        return rows.join(current_cells.select(*cell), list(cell), "left_semi")
    require_unique(current_cells, [key], "current alignment keys")
    require_unique(counts.select(key, *cell).distinct(), [key], "rebuilt alignment keys")
    side = current_cells.select(key, *[F.col(c).alias(f"_{c}") for c in cell])
    joined = rows.drop(*[c for c in cell if c != key]).join(side, key)
    return joined.select(*[F.col(f"_{c}").alias(c) for c in cell], "gene", "count")
