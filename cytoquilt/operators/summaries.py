"""Grouped summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.functions.columns import quote
from cytoquilt.functions.text import clean, clean_tissue


def value_counts(df: DataFrame, column: str, name: str = "cell_n") -> DataFrame:
    """Rows per value, most frequent first, then by name."""
    return df.groupBy(F.col(quote(column))).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.col(quote(column)))


def group_audit(df: DataFrame, by: str, distinct: dict[str, str], conditions: dict[str, Column]) -> DataFrame:
    """Size, distinct values and rows fulfilling each condition, per group.

    ``distinct`` maps an output name to a column. Each distinct count goes through
    its own (group, value) aggregate, so a hot group is spread by value.
    """
    out = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("cell_n"), *[F.count_if(c).alias(n) for n, c in conditions.items()]
    )
    for name, column in distinct.items():
        one = (
            df.where(F.col(quote(column)).isNotNull())
            .groupBy(by, F.col(quote(column)).alias("_v"))
            .agg(F.lit(1).alias("_x"))
            .groupBy(by)
            .agg(F.count(F.lit(1)).alias(name))
        )
        out = out.join(one, by, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def distinct_values_long(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(group, value, column_name) with counts over several columns, blanks left out."""
    long = df.select(by, *[clean(F.col(quote(c))).alias(c) for c in columns]).unpivot(
        [by], [F.col(quote(c)) for c in columns], "column_name", "value"
    )
    return long.where("value <> ''").groupBy(by, "column_name", "value").agg(F.count(F.lit(1)).alias("cell_n"))


def threshold_by_group(cells: DataFrame, by: str, condition: Column) -> DataFrame:
    """Positive cells per group, share within the group and of all positive cells.

    Groups without any positive cell stay in.
    """
    positive = F.coalesce(condition, F.lit(False))
    out = cells.groupBy(by).agg(F.count(F.lit(1)).alias("total_cells"), F.count_if(positive).alias("positive_cells"))
    everything = cells.select(F.count_if(positive)).scalar()
    return out.withColumns(
        {
            "positive_fraction_within_group": F.col("positive_cells") / F.col("total_cells"),
            "share_of_all_positive_cells": F.when(everything > 0, F.col("positive_cells") / everything).otherwise(0.0),
        }
    )


def threshold_overview(table: DataFrame, metric: str) -> DataFrame:
    """One row over :func:`threshold_by_group`: totals and spread across groups."""
    p = F.col("positive_cells")
    return table.agg(
        F.lit(metric).alias("metric_name"),
        F.sum(p).alias("total_positive_cells"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(p > 0).alias("n_groups_with_positive"),
        F.avg(p).alias("mean_per_group"),
        F.percentile(p, 0.5).alias("median_per_group"),
        F.max(p).alias("max_in_one_group"),
    )


def selected_by_group(cells: DataFrame, by: str, condition: Column) -> DataFrame:
    return cells.where(condition).groupBy(by).agg(F.count(F.lit(1)).alias("n_cells")).orderBy(F.desc("n_cells"), by)


def gdt_criteria(
    cells: DataFrame,
    sorted_flag: str = "Sorted_gdT",
    paired_ab: str = "has_TRA_TRB_paired",
    paired_gd: str = "has_TRG_TRD_paired",
    any_ab: str = "has_any_ab_tcr",
    score: str = "trd_minus_trab",
    label: str = "simple_annotation",
    threshold: float = 0.4,
) -> DataFrame:
    """Three independent criteria for gamma-delta cells, their union, doublet proxy."""
    doublet = F.col(paired_ab) & F.col(paired_gd)
    return cells.withColumns(
        {
            "doublet": doublet,
            "criterion_a": F.col(sorted_flag),
            "criterion_b": F.col(paired_gd) & ~doublet,
            "criterion_c": (F.col(score) > threshold) & ~F.col(any_ab) & (F.col(label) != "NK_cell"),
        }
    ).withColumn("any_three", F.col("criterion_a") | F.col("criterion_b") | F.col("criterion_c"))


def gdt_statistics(cells: DataFrame, paired_gd: str = "has_TRG_TRD_paired", label: str = "simple_annotation") -> DataFrame:
    """Nine counts, long form; input from :func:`gdt_criteria`."""
    gdt = F.col(label) == "gdT_cell"
    named = {
        "total_cells": F.lit(True),
        "sorted_gdT_true": F.col("criterion_a"),
        "paired_TRG_TRD_not_doublet": F.col("criterion_b"),
        "score_gap_no_ab_not_NK": F.col("criterion_c"),
        "doublet_proxy": F.col("doublet"),
        "union_any_of_three": F.col("any_three"),
        "gdT_annotated": gdt,
        "gdT_annotated_paired_TRG_TRD": gdt & F.col(paired_gd),
        "gdT_annotated_any_of_three": gdt & F.col("any_three"),
    }
    row = cells.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    return row.unpivot([], list(named), "metric", "value")


def gdt_overlap(cells: DataFrame) -> DataFrame:
    """The seven disjoint regions of the three criteria, zero where empty."""
    a, b, c = (F.col(f"criterion_{x}") for x in "abc")
    named = {
        "a_only": a & ~b & ~c,
        "b_only": ~a & b & ~c,
        "c_only": ~a & ~b & c,
        "a_and_b_only": a & b & ~c,
        "a_and_c_only": a & ~b & c,
        "b_and_c_only": ~a & b & c,
        "all_three": a & b & c,
    }
    row = cells.agg(*[F.count_if(x).alias(n) for n, x in named.items()])
    return row.unpivot([], list(named), "category", "n_cells")


def fraction_within(cells: DataFrame, tissue: str, subset: Column, condition: Column) -> DataFrame:
    """Share of the subset fulfilling a condition, by cleaned tissue."""
    out = (
        cells.where(subset)
        .groupBy(clean_tissue(F.col(quote(tissue))).alias("tissue"))
        .agg(F.count(F.lit(1)).alias("subset_cells"), F.count_if(condition).alias("meeting"))
    )
    return out.withColumn("fraction", F.col("meeting") / F.nullif(F.col("subset_cells"), F.lit(0)))


def pairing_states(cells: DataFrame, paired: str = "has_paired", none: str = "has_none") -> DataFrame:
    """Cells by receptor state: paired alpha/beta, none, or anything else."""
    state = (
        F.when(F.col(paired), "Paired TRA/TRB").when(F.col(none), "No TCR").otherwise("Other TCR state").alias("state")
    )
    return cells.groupBy(state).agg(F.count(F.lit(1)).alias("n_cells"))


def pairing_counts(cells: DataFrame, ab: str = "has_TRA_TRB_paired", gd: str = "has_TRG_TRD_paired") -> DataFrame:
    return cells.agg(
        F.count(F.lit(1)).alias("sampled_cells"),
        F.count_if(ab).alias("paired_ab"),
        F.count_if(gd).alias("paired_gd"),
        F.count_if(F.col(ab) & F.col(gd)).alias("paired_both"),
    )


def label_crosstab(cells: DataFrame, by: Sequence[str], name: str = "n_cells") -> DataFrame:
    return cells.groupBy(*[F.col(quote(c)) for c in by]).agg(F.count(F.lit(1)).alias(name))


def integration_summary(cells: DataFrame, columns: dict[str, str], confidence: str, other: Column) -> DataFrame:
    """One row: cells, distinct values of several columns, mean confidence, 'other' cells."""
    row = cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(confidence).alias("mean_confidence"),
        F.count_if(other).alias("reference_other_cells"),
    ).withColumn("_one", F.lit(1))
    for name, column in columns.items():
        one = cells.select(F.col(quote(column)).alias("_v")).where("_v is not null").groupBy("_v").agg(F.lit(1).alias("_x"))
        row = row.join(one.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1)), "_one")
    return row.drop("_one")


def prep_stats(obs: DataFrame, by: str, sample: str, ab: str, gd: str, flag: str) -> DataFrame:
    """Per input: cells, non-blank samples, paired cells, and whether every flag is true."""
    out = obs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col(ab)).alias("n_paired_ab"),
        F.count_if(F.col(gd)).alias("n_paired_gd"),
        F.bool_and(F.lower(F.col(flag).cast("string")) == "true").alias("all_flagged"),
    )
    samples = (
        obs.where(F.coalesce(F.col(sample), F.lit("")) != "").groupBy(by, sample).agg(F.lit(1).alias("_x"))
        .groupBy(by).agg(F.count(F.lit(1)).alias("n_samples"))
    )
    return out.join(samples, by, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def missing_genes(base: DataFrame, var: DataFrame, by: str) -> DataFrame:
    """Base genes each dataset lacks."""
    n_base = base.select("gene").distinct().select(F.count(F.lit(1))).scalar()
    have = var.join(base.select("gene").distinct(), "gene", "left_semi").groupBy(by, "gene").agg(F.lit(1).alias("_x"))
    datasets = var.select(by).distinct()
    out = datasets.join(have.groupBy(by).agg(F.count(F.lit(1)).alias("n_shared")), by, "left").fillna(0)
    return out.withColumn("n_missing", n_base - F.col("n_shared"))


def build_summary(obs: DataFrame, var: DataFrame, by: str) -> DataFrame:
    """Intake: cells, genes, samples, libraries and receptor cells per dataset."""
    out = group_audit(
        obs.withColumns({"_s": F.nullif(clean("sample_id"), F.lit("")), "_l": F.nullif(clean("library_id"), F.lit(""))}),
        by,
        {"samples": "_s", "libraries": "_l"},
        {"tcr_yes_cells": F.lower(clean("TCRseq")) == "yes"},
    ).withColumnRenamed("cell_n", "n_obs")
    return out.join(var.groupBy(by).agg(F.count(F.lit(1)).alias("n_vars")), by, "left")


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal bins over the observed range; the top edge is in the last bin."""
    low = df.select(F.min(value)).scalar()
    high = df.select(F.max(value)).scalar()
    width = (high - low) / F.lit(bins)
    pos = F.floor((F.col(value) - low) / F.when(width > 0, width))
    b = F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, value: str, edges: int = 60, at_least: float = 500.0) -> DataFrame:
    """Counts between ``edges`` log-spaced edges from 1; values below 1 count as 1.

    The last edge is the larger of the maximum and ``at_least``.
    """
    v = F.greatest(F.col(value).cast("double"), F.lit(1.0))
    top = df.select(F.log10(F.greatest(F.max(v), F.lit(at_least)))).scalar()
    bins = edges - 1
    b = F.least(F.floor(F.log10(v) / top * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scope_metrics(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: total cells and distinct values of each named column."""
    row = cells.agg(F.count(F.lit(1)).alias("total_cells")).withColumn("_one", F.lit(1))
    for name, column in columns.items():
        seen = cells.groupBy(F.col(quote(column)).alias("_v")).agg(F.lit(1).alias("_x")).where("_v is not null")
        row = row.join(seen.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1)), "_one")
    return row.drop("_one")


def display_top(table: DataFrame, count: str, name: str, n: int = 30) -> DataFrame:
    return table.orderBy(F.desc(count), name).limit(n)
