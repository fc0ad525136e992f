"""Conservative clean-up of candidate cells and rarely detected genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.constants import (
    CLEANUP_PANELS,
    KEY_GENES,
    MAX_CELL_TOTAL,
    MIN_GENE_CELLS,
    REASON_PRIORITY,
)
from cytoquilt.functions.genes import is_mitochondrial
from cytoquilt.functions.numbers import is_finite
from cytoquilt.operators.joining import sized_join
from cytoquilt.operators.matrix import CELL, resolve_panel, with_every_cell, with_group_flags
from cytoquilt.session import materialize, partitions_for


def total_hits() -> Column:
    return F.col("t_hits") + F.col("gd_hits") + F.col("nk_hits") + F.col("nk_strong_hits")


def first_pass_decisions(cells: DataFrame) -> DataFrame:
    """Flags obvious off-target cells and likely doublets from extraction scores."""
    no_support = (
        (total_hits() == 0) & (F.col("t_score") == 0) & (F.col("gd_score") == 0) & (F.col("nk_score") == 0)
    )
    obvious = (F.col("contam_score") >= 1.5) & (F.col("selection_reason") == "annotation_only") & no_support
    doublet = (F.col("contam_score") >= 2.0) & (F.col("t_score") >= 1.5) & (F.col("nk_score") >= 1.5)
    return cells.withColumns(
        {
            "remove_off_target": obvious,
            "remove_doublet": doublet,
            "remove": obvious | doublet,
            "remove_reason": F.when(obvious, "obvious_non_tnk").when(doublet, "high_conf_doublet").otherwise("kept"),
        }
    )


def group_scores(
    obs: DataFrame,
    counts: DataFrame,
    var: DataFrame,
    panels: dict[str, Sequence[str]] = CLEANUP_PANELS,
    by: Sequence[str] = (),
    cell: Sequence[str] = CELL,
    mito: Column | None = None,
) -> DataFrame:
    """Totals and log-of-mean score of every off-target group, one pass over counts.

    The score is log1p(1e4 * (sum over the group / genes found) / max(total, 1)).
    """
    symbols = sorted({g for genes in panels.values() for g in genes})
    panel = materialize(resolve_panel(var, symbols, by, exact=True))
    keys = [*by, *[c for c in cell if c not in by]]
    work = sized_join(counts, with_group_flags(panel, panels), [*by, "gene"], "left")
    is_mt = is_mitochondrial("gene") if mito is None else mito
    sums = [F.coalesce(F.sum(F.col(f"in_{name}") * F.col("count")), F.lit(0.0)).alias(f"_s_{name}") for name in panels]
    profile = work.groupBy(*keys).agg(
        F.sum("count").alias("total"),
        F.count_if(F.col("count") != 0).alias("n_genes"),
        F.sum(F.when(is_mt, F.col("count")).otherwise(0.0)).alias("_mt"),
        *sums,
    )
    found = panel.groupBy(*by).agg(
        *[F.count_if(F.col("panel_symbol").isin(*genes)).alias(f"_k_{name}") for name, genes in panels.items()]
    )
    wide = with_every_cell(obs, profile, keys)
    if by:
        wide = sized_join(wide, found, list(by), "left")
        k_of = {n: F.coalesce(F.col(f"_k_{n}"), F.lit(0)) for n in panels}
    else:
        k_of = {n: found.select(f"_k_{n}").scalar() for n in panels}
    depth = F.greatest(F.col("total"), F.lit(1.0))
    out = [F.col(c) for c in obs.columns] + [
        F.col("total"),
        F.col("n_genes"),
        (F.col("_mt") / depth).alias("pct_mt"),
    ]
    for name in panels:
        k = k_of[name]
        out.append(
            F.when(k > 0, F.log1p(F.lit(1e4) * (F.col(f"_s_{name}") / k) / depth)).otherwise(0.0).alias(f"{name}_score")
        )
    return wide.select(*out)


def dominant_label(top: Column, names: Sequence[str] = tuple(CLEANUP_PANELS)) -> Column:
    """Group whose score equals the highest one; the earlier name wins a tie."""
    label = None
    for n in names:
        hit = F.col(f"{n}_score") == top
        label = F.when(hit, n) if label is None else label.when(hit, n)
    return label


def second_pass_reasons(scored: DataFrame) -> DataFrame:
    """Removal reason per cell: the first of the fixed priority list, else kept.

    Input: output of :func:`group_scores` with extraction scores and hits.
    """
    # one projection per step: later steps refer to columns, so that no expression
    # is copied into every place it is used in
    work = scored.withColumns(
        {
            "support": F.greatest("t_score", "gd_score", "nk_score"),
            "total_hits": total_hits(),
            "dominant_score": F.greatest(*[F.col(f"{n}_score") for n in CLEANUP_PANELS]),
        }
    )
    support, hits, top = F.col("support"), F.col("total_hits"), F.col("dominant_score")
    work = work.withColumns(
        {"dominant_label": dominant_label(top), "_weak": (support <= 0.75) & (hits <= 1)}
    )
    weak, label = F.col("_weak"), F.col("dominant_label")
    work = work.withColumn("_gate", (top >= 1.20) & weak & (top >= support + 0.35))

    def own(name: str) -> Column:
        s = F.col(f"{name}_score")
        return (s >= 1.00) & weak & (s >= support + 0.35)

    flags = {
        "low_quality": (F.col("n_genes") < 100)
        | (F.col("total") < 150)
        | ((F.col("pct_mt") >= 0.30) & (F.col("n_genes") < 200)),
        "extreme_phase1_contam": (F.col("contam_score") >= 1.75) & (support <= 0.50) & (hits == 0),
        "myeloid_conflict": F.col("_gate") & (label == "myeloid"),
        "bcell_conflict": F.col("_gate") & (label == "bcell"),
        "epithelial_conflict": own("epithelial"),
        "erythroid_conflict": own("erythroid"),
        "platelet_conflict": own("platelet"),
    }
    reason = F.coalesce(*[F.when(flags[name], F.lit(name)) for name in REASON_PRIORITY], F.lit("kept"))
    return work.withColumn("remove_reason", reason).drop("_weak", "_gate")


def cells_per_gene(counts: DataFrame, kept: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Number of kept cells with a stored non-zero value, per gene.

    The kept cells filter before the aggregate; partial counts absorb hot genes.
    """
    rows = counts.where("count <> 0").join(kept.select(*cell), list(cell), "left_semi")
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("cells_detected"))


def gene_summary(
    var: DataFrame, detected: DataFrame, min_cells: int = MIN_GENE_CELLS, key_genes: Sequence[str] = KEY_GENES,
    symbol: str = "gene",
) -> DataFrame:
    """Every gene with its detection count, keep flag and key-gene flag."""
    out = var.join(detected, "gene", "left").withColumn("cells_detected", F.coalesce("cells_detected", F.lit(0)))
    return out.withColumns(
        {"keep_gene": F.col("cells_detected") >= min_cells, "key_gene": F.col(symbol).isin(*key_genes)}
    )


def keep_detected_genes(counts: DataFrame, summary: DataFrame) -> DataFrame:
    """Counts of kept genes; fails where no gene is left."""
    kept = summary.where("keep_gene").select("gene")
    if kept.limit(1).count() == 0:
        raise ValueError("no gene passes the detection filter")
    return counts.join(kept, "gene", "left_semi")


def value_sanity(counts: DataFrame, cell: Sequence[str] = CELL, limit: float = MAX_CELL_TOTAL) -> DataFrame:
    """Cells with NaN, infinite or negative values or an extreme total, with a reason."""
    ok = is_finite("count") & (F.col("count") >= 0)
    per_cell = counts.groupBy(*cell).agg(F.sum("count").alias("total"), F.bool_or(~ok).alias("_bad"))
    # NaN sorts above every number in Spark, but is not an extreme total here
    extreme = (F.col("total") > limit) & ~F.isnan("total")
    reason = (
        F.when(F.col("_bad") & extreme, "invalid_and_extreme")
        .when(F.col("_bad"), "invalid_matrix_values")
        .when(extreme, "extreme_library_size")
        .otherwise("kept")
    )
    return per_cell.select(*cell, "total", reason.alias("sanity_reason"))


def count_space_filter(
    counts: DataFrame, min_genes: int, min_cells: int, max_mito_pct: float,
    cell: Sequence[str] = CELL, mito: Column | None = None,
) -> DataFrame:
    """Cells by detected genes, then genes by cells, then cells by mito percent.

    The counts are written once, and so is what the first two filters leave; the tasks of the joins by gene follow its rows.
    """
    stored = materialize(counts.where("count <> 0"))
    n = partitions_for(counts.sparkSession, stored.count())
    stored = stored.repartition(n, *cell)
    rich = stored.groupBy(*cell).agg(F.count(F.lit(1)).alias("_g")).where(F.col("_g") >= min_genes).select(*cell)
    step1 = materialize(stored.join(rich, list(cell), "left_semi")).repartition(n, "gene")
    common = step1.groupBy("gene").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_cells).select("gene")
    step2 = materialize(step1.join(common, "gene", "left_semi")).repartition(n, *cell)
    is_mt = is_mitochondrial("gene", ignore_case=True) if mito is None else mito
    share = step2.groupBy(*cell).agg(
        (F.lit(100.0) * F.sum(F.when(is_mt, F.col("count")).otherwise(0.0)) / F.nullif(F.sum("count"), F.lit(0.0))).alias("_pct")
    )
    clean = share.where(F.col("_pct") < max_mito_pct).select(*cell)
    return step2.join(clean, list(cell), "left_semi")


def before_after(cells: DataFrame, by: str = "gse_id", removed: Column | None = None) -> DataFrame:
    """Cells before and after per dataset in one pass, with the kept fraction."""
    gone = (F.col("remove_reason") != "kept") if removed is None else removed
    out = cells.groupBy(by).agg(
        F.count(F.lit(1)).alias("cells_before"), F.count_if(~gone).alias("cells_after")
    )
    return out.withColumns(
        {
            "cells_removed": F.col("cells_before") - F.col("cells_after"),
            "retained_fraction": F.col("cells_after") / F.col("cells_before"),
        }
    )


def cleanup_summary(cells: DataFrame, genes: DataFrame, reasons: Sequence[str], min_cells: int) -> DataFrame:
    """One row: cells and genes before and after, removals per reason, key genes."""
    by_reason = [F.count_if(F.col("remove_reason") == r).alias(f"removed_{r}") for r in reasons]
    left = cells.agg(
        F.count(F.lit(1)).alias("cells_before"),
        F.count_if(F.col("remove_reason") == "kept").alias("cells_after"),
        F.count_if(F.col("remove_reason") != "kept").alias("cells_removed_total"),
        *by_reason,
    )
    right = genes.agg(
        F.count(F.lit(1)).alias("genes_before"),
        F.count_if("keep_gene").alias("genes_after"),
        F.count_if(~F.col("keep_gene")).alias("genes_removed"),
        F.lit(min_cells).cast("long").alias("min_gene_cells"),
        F.count_if(F.col("key_gene") & F.col("keep_gene")).alias("key_genes_kept"),
        F.count_if(F.col("key_gene") & ~F.col("keep_gene")).alias("key_genes_dropped"),
    )
    # two one-row tables side by side
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def reason_counts(cells: DataFrame, reason: str = "remove_reason") -> DataFrame:
    return cells.groupBy(reason).agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("cells"), reason)
