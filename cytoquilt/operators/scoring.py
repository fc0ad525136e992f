"""Control-matched gene-module scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.constants import CONTROL_BINS, CONTROL_SIZE, MODULE_PATTERNS, TARGET_SUM
from cytoquilt.functions.numbers import log1p_norm
from cytoquilt.operators.joining import sized_join
from cytoquilt.operators.matrix import CELL
from cytoquilt.operators.ordering import distributed_min_rank, seeded_hash
from cytoquilt.operators.quantiles import grouped_quantiles
from cytoquilt.session import materialize, materialize_bucketed, partitions_for

SCORES = ("tra", "trb", "trab", "trd")


def find_modules(
    var: DataFrame, patterns: dict[str, str] = MODULE_PATTERNS, unions: dict[str, Sequence[str]] | None = None,
    symbol: str = "gene",
) -> DataFrame:
    """Module membership by gene-name pattern: (module, gene), each pair once."""
    unions = {"trab": ("tra", "trb")} if unions is None else unions
    names = [F.when(F.col(symbol).rlike(p), F.lit(m)) for m, p in patterns.items()]
    for union, parts in unions.items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.col(symbol).rlike(patterns[part])
        names.append(F.when(hit, F.lit(union)))
    listed = var.select("gene", F.explode(F.array_compact(F.array(*names))).alias("module"))
    return listed.select("module", "gene").distinct()


def require_modules(modules: DataFrame, names: Sequence[str]) -> None:
    found = {r[0] for r in modules.select("module").distinct().collect()}
    empty = [n for n in names if n not in found]
    if empty:
        raise ValueError(f"modules without genes: {empty}")


def normalized_store(counts: DataFrame, cell: Sequence[str] = CELL, buckets: int | None = None) -> DataFrame:
    """(cell, gene, value): normalised counts, written once and bucketed by cell.

    The one shuffle of the count rows: totals come from a window on the way, and
    means and scores read the table without another exchange of its rows. Buckets follow the number
    of rows; without ``buckets`` they are counted first, which a table in files answers from its footers.
    """
    total = F.sum("count").over(Window.partitionBy(*cell))
    n = buckets or partitions_for(counts.sparkSession, counts.count())
    rows = counts.repartition(n, *cell).withColumn("_total", total)
    return materialize_bucketed(rows.select(*cell, "gene", log1p_norm("count", "_total", TARGET_SUM).alias("value")), cell, n)


def gene_means(store: DataFrame, var: DataFrame, n_cells) -> DataFrame:
    """Mean normalised expression of every gene over all cells, zeros included.

    ``store`` holds (gene, value) of stored pairs; sums are made in the task, so a row per task and gene is shuffled.
    """
    sums = store.groupBy("gene").agg(F.sum("value").alias("_s"))
    return var.select("gene").join(sums, "gene", "left").select(
        "gene", (F.coalesce(F.col("_s"), F.lit(0.0)) / n_cells).alias("mean_expr")
    )


def expression_bins(means: DataFrame, bins: int = CONTROL_BINS, digits: int | None = None) -> DataFrame:
    """Bin of every gene: lowest-place rank by mean, cut into equal counts.

    ``digits`` rounds the means first, which makes ties independent of the order
    of summation.
    """
    work = means.where(F.abs("mean_expr") < F.lit(float("inf")))
    if digits is not None:
        work = work.withColumn("mean_expr", F.round("mean_expr", digits))
    # one row per gene, read several times below
    work = materialize(work)
    if round(work.count() / (bins - 1)) <= 0:
        raise ValueError("too few genes for the control bins")
    per_bin = work.select(F.rint(F.count(F.lit(1)) / F.lit(bins - 1))).scalar()
    ranked = distributed_min_rank(work, "mean_expr", "_rank")
    return ranked.select("gene", "mean_expr", F.floor(F.col("_rank") / per_bin).alias("bin"))


def control_genes(
    binned: DataFrame, modules: DataFrame, size: int = CONTROL_SIZE, seed: int = 1
) -> DataFrame:
    """Up to ``size`` genes of every bin a module touches, then less its own genes.

    The draw comes before the subtraction, so fewer than ``size`` may stay. Fails
    where a module is left without any. All modules draw alike from a bin, so every bin
    is drawn from once, where its rows are: a few bins of a few modules are sent to the genes.
    """
    touched = modules.join(binned.select("gene", "bin"), "gene").select("module", "bin").distinct()
    pool = binned.select("gene", "bin").join(F.broadcast(touched.select("bin").distinct()), "bin", "left_semi")
    w = Window.partitionBy("bin").orderBy(seeded_hash(["gene"], seed), "gene")
    drawn = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).join(F.broadcast(touched), "bin")
    found = drawn.join(modules, ["module", "gene"], "left_anti").select("module", "gene").distinct()
    # one row per module
    without = modules.select("module").distinct().join(found, "module", "left_anti").collect()
    if without:
        raise ValueError(f"no control genes found for {sorted(r[0] for r in without)}")
    return found


def module_weights(modules: DataFrame, controls: DataFrame, names: Sequence[str] = SCORES) -> DataFrame:
    """One row per gene with the signed weight it has in every module score."""
    both = modules.select("module", "gene", F.lit(1.0).alias("sign")).unionByName(
        controls.select("module", "gene", F.lit(-1.0).alias("sign"))
    )
    sizes = both.groupBy("module", "sign").agg(F.count(F.lit(1)).alias("_n"))
    weighted = both.join(sizes, ["module", "sign"]).withColumn("_w", F.col("sign") / F.col("_n"))
    return weighted.groupBy("gene").agg(
        *[F.sum(F.when(F.col("module") == m, F.col("_w")).otherwise(0.0)).alias(f"w_{m}") for m in names]
    )


def module_scores(
    obs: DataFrame,
    store: DataFrame,
    weights: DataFrame,
    names: Sequence[str] = SCORES,
    cell: Sequence[str] = CELL,
) -> DataFrame:
    """Score of every cell for every module: weighted sum over module and control genes.

    ``store`` is that of :func:`normalized_store`. The small weight table filters
    its rows where they are, and a cell's rows are in one bucket.
    """
    rows = sized_join(store, weights, ["gene"])
    scored = rows.groupBy(*cell).agg(*[F.sum(F.col("value") * F.col(f"w_{m}")).alias(f"{m}_score") for m in names])
    out = obs.join(scored, list(cell), "left").fillna(0.0, subset=[f"{m}_score" for m in names])
    if {"trd", "trab"} <= set(names):
        out = out.withColumn("trd_minus_trab", F.col("trd_score") - F.col("trab_score"))
    return out


def min_max_scaled(df: DataFrame, column: str):
    """0-1 scaling by the global range; a constant column becomes 0."""
    low = df.select(F.min(column)).scalar()
    high = df.select(F.max(column)).scalar()
    span = high - low
    flat = F.abs(span) <= F.lit(1e-9) * F.greatest(F.abs(low), F.abs(high))
    return F.when(flat, F.lit(0.0)).otherwise((F.col(column) - low) / F.when(~flat, span))


def add_scaled_scores(scores: DataFrame) -> DataFrame:
    """Scaled TRD and TRAB scores and their difference.

    ``scores`` should be materialised: the global range is a separate read of it.
    """
    return scores.withColumns(
        {
            "trab_score_scaled": min_max_scaled(scores, "trab_score"),
            "trd_score_scaled": min_max_scaled(scores, "trd_score"),
        }
    ).withColumn("trd_minus_trab_scaled", F.col("trd_score_scaled") - F.col("trab_score_scaled"))


def score_cells(
    obs: DataFrame,
    counts: DataFrame,
    var: DataFrame,
    modules: DataFrame,
    names: Sequence[str] = SCORES,
    cell: Sequence[str] = CELL,
    bins: int = CONTROL_BINS,
    control_size: int = CONTROL_SIZE,
    seed: int = 1,
    digits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Gene means, control draw and module scores in sequence, scaled scores last."""
    store = normalized_store(counts, cell, buckets)
    n_cells = obs.select(F.count(F.lit(1))).scalar()
    binned = materialize(expression_bins(gene_means(store, var, n_cells), bins, digits))
    modules = modules.where(F.col("module").isin(*names))
    weights = materialize(module_weights(modules, control_genes(binned, modules, control_size, seed), names))
    return materialize(module_scores(obs, store, weights, names, cell))


def score_summary(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float] | None = None
) -> DataFrame:
    """Size, mean, population deviation, range and exact quantiles of each score.

    ``df`` should be materialised: its rows are counted first, by which the quantiles are cut into ranges.
    """
    probs = probs or {"p01": 0.01, "p05": 0.05, "median": 0.50, "p95": 0.95, "p99": 0.99}
    long = df.select(*columns).unpivot([], list(columns), "score_name", "v")
    basic = long.groupBy("score_name").agg(
        F.count("v").alias("n_cells"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    return basic.join(grouped_quantiles(long, ["score_name"], "v", probs, rows=df.count() * len(columns)), "score_name")


def grouped_score_table(
    df: DataFrame, by: str, means: Sequence[str], medians: Sequence[str]
) -> DataFrame:
    """Cells, mean scores and exact median scores per cluster, dataset or tissue."""
    base = df.where(F.col(by).isNotNull())
    out = base.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_cells"), *[F.avg(c).alias(f"{c}_mean") for c in means]
    )
    long = base.select(by, *medians).unpivot([by], list(medians), "_score", "_v")
    med = grouped_quantiles(long, [by, "_score"], "_v", {"_m": 0.5}, rows=df.count() * len(medians))
    wide = med.groupBy(by).agg(
        *[F.max(F.when(F.col("_score") == c, F.col("_m"))).alias(f"{c}_median") for c in medians]
    )
    return out.join(wide, by, "left")
