"""Checks that fail loudly, and the tables behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquilt.functions.columns import quote


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*[F.col(quote(k)) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    preview = duplicate_keys(df, keys).limit(20).collect()
    if preview:
        raise ValueError(f"{what} has duplicate keys {list(keys)}: {[tuple(r) for r in preview]}")
    return df


def require_matched(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "rows") -> None:
    """Every left key must be in the right table; shows up to 20 that are not."""
    preview = left.join(right, list(keys), "left_anti").select(*keys).limit(20).collect()
    if preview:
        raise ValueError(f"unmatched {what}: {[tuple(r) for r in preview]}")


def one_to_one_faults(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that keep two tables from matching one to one: (keys, rows on the left, rows on the right, fault).

    Both sides go through one grouping of their tagged keys, summed in the task
    first: repeated keys on either side and left keys without a right row.
    """
    own = [F.col(quote(k)) for k in keys]
    tagged = left.select(*own, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select(*own, F.lit(0), F.lit(1)))
    seen = tagged.groupBy(*own).agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))
    none = F.lit(False)
    for k in own:
        none = none | k.isNull()
    fault = (
        F.when(F.col("left_n") > 1, "left duplicate").when(F.col("right_n") > 1, "right duplicate")
        .when((F.col("left_n") > 0) & (none | (F.col("right_n") == 0)), "unmatched")
    )
    return seen.withColumn("fault", fault).where("fault is not null")


def require_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], left_name: str = "left", right_name: str = "right") -> None:
    """Unique keys on both sides and a right row for every left one; shows up to 20 keys that break it."""
    preview = one_to_one_faults(left, right, keys).limit(20).collect()
    if preview:
        shown = [tuple(r)[: len(keys)] + (r["fault"].replace("left", left_name).replace("right", right_name),) for r in preview]
        raise ValueError(f"{left_name} and {right_name} do not match one to one on {list(keys)}: {shown}")


def readback_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows with a blank key, surplus rows of repeated keys."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | (F.coalesce(F.col(quote(k)).cast("string"), F.lit("")) == "")
    per_key = df.groupBy(*[F.col(quote(k)) for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(blank).alias("_blank")
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_blank"), F.lit(0)).alias("blank_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def reconcile_counts(expected: DataFrame, observed: DataFrame, key: str, expected_n: str, observed_n: str) -> DataFrame:
    """Expected against observed counts over the union of keys."""
    both = expected.select(key, F.col(expected_n).alias("expected_n")).join(
        observed.select(key, F.col(observed_n).alias("observed_n")), key, "full_outer"
    )
    both = both.fillna(0, subset=["expected_n", "observed_n"])
    return both.withColumn("matches", F.col("expected_n") == F.col("observed_n"))


def require_reconciled(expected: DataFrame, observed: DataFrame, key: str, expected_n: str, observed_n: str) -> None:
    bad = reconcile_counts(expected, observed, key, expected_n, observed_n).where("not matches").limit(20).collect()
    if bad:
        raise ValueError(f"counts differ: {[tuple(r) for r in bad]}")


def require_shape(cells: DataFrame, genes: DataFrame, n_cells: int, n_genes: int) -> None:
    got = (cells.count(), genes.count())
    if got != (n_cells, n_genes):
        raise ValueError(f"shape mismatch: expected {(n_cells, n_genes)}, got {got}")


def axis_report(current: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """One row comparing two axes: sizes, one-sided names, equality, uniqueness."""
    a = current.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = rebuilt.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, key, "full_outer").fillna(0, subset=["_a", "_b"])
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = both.agg(
        n("_a").alias("current_n"),
        n("_b").alias("rebuilt_n"),
        F.count_if((F.col("_a") > 0) & (F.col("_b") == 0)).alias("only_current"),
        F.count_if((F.col("_b") > 0) & (F.col("_a") == 0)).alias("only_rebuilt"),
        F.count_if((F.col("_a") > 1) | (F.col("_b") > 1)).alias("_repeated"),
    )
    return row.withColumns(
        {
            "keys_unique": F.col("_repeated") == 0,
            "set_equal": (F.col("_repeated") == 0) & (F.col("only_current") == 0) & (F.col("only_rebuilt") == 0),
            "current_subset_of_rebuilt": F.col("only_current") == 0,
        }
    ).drop("_repeated")


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Names found on the left only, in order; a caller may take the first few."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti").orderBy(key)


def treg_invariants(summary: DataFrame, label: str = "label") -> DataFrame:
    """Clusters labelled Treg that break either marker invariant."""
    treg = F.col(label) == "Treg"
    return summary.agg(
        F.count_if(treg).alias("treg_clusters"),
        F.count_if(treg & (F.col("cd8_marker_mean") > F.col("cd4_marker_mean"))).alias("cd8_above_cd4"),
        F.count_if(treg & (F.col("nk_marker_mean") >= 0.35)).alias("nk_not_low"),
    )


def receptor_sanity(before: DataFrame, after: DataFrame, tcr: DataFrame, by: str, suspicious: float = 0.95) -> DataFrame:
    """Coverage per group after a receptor merge, with a flag for near-total pairing."""
    dup = duplicate_keys(tcr, ["sample_id", "barcode_core"]).agg(F.count(F.lit(1)).alias("duplicate_receptor_keys"))
    b = before.groupBy(by).agg(F.count(F.lit(1)).alias("cells_before"))
    a = after.groupBy(by).agg(
        F.count(F.lit(1)).alias("cells_after"),
        F.count_if(F.col("TCRseq") == "yes").alias("cells_with_tcr"),
        F.count_if(F.col("has_TRA_TRB_paired")).alias("cells_paired_ab"),
        F.count_if(F.col("has_TRG_TRD_paired")).alias("cells_paired_gd"),
    )
    out = b.join(a, by, "full_outer").fillna(0)
    paired = F.col("cells_paired_ab") / F.nullif(F.col("cells_after"), F.lit(0))
    return out.withColumns(
        {
            "rows_unchanged": F.col("cells_before") == F.col("cells_after"),
            "paired_fraction": F.coalesce(paired, F.lit(0.0)),
            "suspicious": F.coalesce(paired >= suspicious, F.lit(False)),
            "duplicate_receptor_keys": dup.scalar(),
        }
    )
