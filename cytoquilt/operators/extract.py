"""Marker- and annotation-based extraction of candidate cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.constants import ANNOTATION_NEGATIVE, ANNOTATION_POSITIVE, EXTRACTION_PANELS
from cytoquilt.functions.columns import quote
from cytoquilt.functions.genes import canonical_symbol_py
from cytoquilt.functions.text import matches_any
from cytoquilt.operators.joining import sized_join
from cytoquilt.operators.matrix import cell_profile, resolve_panel, with_every_cell, with_group_flags
from cytoquilt.session import materialize


def annotation_flags(
    columns: Sequence[str],
    positive: Sequence[str] = ANNOTATION_POSITIVE,
    negative: Sequence[str] = ANNOTATION_NEGATIVE,
) -> tuple[Column, Column]:
    """(kept by annotation, ruled out by annotation).

    A column speaks against a cell only where that same column does not speak
    for it. Values are looked at as text, so NULL reads as 'None' or 'nan' and
    matches nothing.
    """
    keep, against = F.lit(False), F.lit(False)
    for name in columns:
        yes = matches_any(F.col(quote(name)), positive)
        no = matches_any(F.col(quote(name)), negative)
        keep, against = keep | yes, against | (no & ~yes)
    return keep, against


def availability(panel: DataFrame, panels: dict[str, Sequence[str]], by: Sequence[str]) -> DataFrame:
    """Number of genes of each marker group that each dataset has: wide ``k_<group>``."""
    return panel.groupBy(*by).agg(
        *[
            F.count_if(F.col("panel_symbol").isin(*[canonical_symbol_py(g) for g in genes])).alias(f"k_{name}")
            for name, genes in panels.items()
        ]
    )


def availability_table(
    datasets: DataFrame,
    var: DataFrame,
    panels: dict[str, Sequence[str]] = EXTRACTION_PANELS,
    by: Sequence[str] = ("gse_id",),
) -> DataFrame:
    """Long form: dataset, marker group, genes present (0 where none)."""
    symbols = sorted({g for genes in panels.values() for g in genes})
    wide = availability(resolve_panel(var, symbols, by), panels, by)
    filled = datasets.select(*by).distinct().join(wide, list(by), "left").fillna(0)
    long = filled.unpivot(list(by), [f"k_{n}" for n in panels], "marker_group", "genes_present")
    return long.withColumn("marker_group", F.upper(F.regexp_replace("marker_group", "^k_", "")))


def marker_profile(
    obs: DataFrame,
    counts: DataFrame,
    var: DataFrame,
    panels: dict[str, Sequence[str]] = EXTRACTION_PANELS,
    by: Sequence[str] = ("gse_id",),
    cell: Sequence[str] = ("cell_id",),
) -> DataFrame:
    """Hits and mean-of-logs score of every marker group for every cell.

    The score averages log1p(1e4 * count / total) over the group's genes that
    the dataset has; it is 0 where it has none.
    """
    groups = {n: [canonical_symbol_py(g) for g in genes] for n, genes in panels.items()}
    panel = materialize(resolve_panel(var, sorted({g for gs in groups.values() for g in gs}), by))
    keys = [*by, *[c for c in cell if c not in by]]
    # cell totals from all counts; the few panel rows are cut out before they meet
    # them, and both sides are then partitioned by cell
    totals = cell_profile(counts, by=by, cell=cell)
    rows = sized_join(counts, with_group_flags(panel, groups), [*by, "gene"])
    logs = F.log1p(F.col("count") * F.lit(1e4) / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")))
    found = F.when(F.col("count") > 0, 1.0).otherwise(0.0)
    sums = []
    for name in groups:
        sums.append(F.sum(F.col(f"in_{name}") * found).cast("int").alias(f"{name}_hits"))
        sums.append(F.sum(F.col(f"in_{name}") * logs).alias(f"_s_{name}"))
    marked = rows.join(totals.drop("n_genes"), keys).groupBy(*keys).agg(*sums)
    wide = with_every_cell(with_every_cell(obs, totals, keys), marked, keys)
    wide = sized_join(wide, availability(panel, panels, by), list(by), "left")
    out = [F.col(quote(c)) for c in obs.columns] + ["total", "n_genes"]
    for name in groups:
        k = F.coalesce(F.col(f"k_{name}"), F.lit(0))
        out.append(F.col(f"{name}_hits"))
        out.append(F.when(k > 0, F.col(f"_s_{name}") / k).otherwise(0.0).alias(f"{name}_score"))
    return wide.select(*out)


def select_candidates(profile: DataFrame, annotation_columns: Sequence[str], **patterns) -> DataFrame:
    """Adds ``annotation_keep``, ``marker_keep``, ``keep`` and ``selection_reason``."""
    ann, against = annotation_flags(annotation_columns, **patterns)
    work = profile.withColumn("annotation_keep", ann).withColumn("_against", against)
    by_hits = (
        (F.col("t_hits") >= 1)
        | (F.col("gd_hits") >= 1)
        | ((F.col("nk_hits") >= 2) & (F.col("nk_strong_hits") >= 1))
    )
    by_score = (F.col("t_score") >= 0.60) | (F.col("gd_score") >= 0.35) | (F.col("nk_score") >= 0.80)
    weak = F.col("t_hits") + F.col("gd_hits") + F.col("nk_hits") <= 1
    contaminated = (F.col("contam_score") >= 1.25) & weak & ~F.col("annotation_keep")
    work = work.withColumn("marker_keep", (by_hits | by_score) & ~contaminated)
    reason = (
        F.when(F.col("annotation_keep") & ~F.col("marker_keep"), "annotation_only")
        .when(F.col("annotation_keep") & F.col("marker_keep"), "annotation_and_marker")
        .otherwise("marker_only")
    )
    return (
        work.withColumn("keep", F.col("annotation_keep") | (F.col("marker_keep") & ~F.col("_against")))
        .withColumn("selection_reason", reason)
        .drop("_against")
    )


def selection_summary(cells: DataFrame, by: str = "gse_id", population: str = "input") -> DataFrame:
    """Per dataset: sizes, flag intersections and mean scores of the kept cells.

    ``population='retained'`` counts the flags over kept cells only.
    """
    base = cells if population == "input" else cells.where("keep")
    ann, mark = F.col("annotation_keep"), F.col("marker_keep")
    means = [
        F.avg(F.when(F.col("keep"), F.col(f"{n}_score"))).alias(f"mean_{n}_score_candidates")
        for n in ("t", "nk", "gd", "contam")
    ]
    out = base.groupBy(by).agg(
        F.count(F.lit(1)).alias("input_n"),
        F.count_if("keep").alias("candidate_n"),
        F.count_if(ann).alias("annotation_positive_n"),
        F.count_if(mark).alias("marker_positive_n"),
        F.count_if(ann & mark).alias("annotation_and_marker_n"),
        F.count_if(ann & ~mark).alias("annotation_only_n"),
        F.count_if(~ann & mark).alias("marker_only_n"),
        *means,
    )
    return out.withColumn("candidate_fraction", F.col("candidate_n") / F.col("input_n"))
