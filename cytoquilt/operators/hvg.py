"""Variable genes: batch-wise variance against a mean trend."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.constants import TARGET_SUM
from cytoquilt.functions.genes import variable_gene_flags
from cytoquilt.operators.joining import sized_join
from cytoquilt.operators.matrix import CELL
from cytoquilt.operators.quantiles import grouped_quantiles
from cytoquilt.session import materialize


#: Factor that makes the median absolute deviation of normal values their standard deviation.
MAD_SCALE = 1.482602218505602


def exclusion_table(var: DataFrame, symbol: str = "gene") -> DataFrame:
    """Gene table with the flags that keep a gene out of the selection."""
    return var.withColumns(variable_gene_flags(F.col(symbol)))


def exclusion_summary(flags: DataFrame, selected: int) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("genes_total"),
        F.count_if(~F.col("exclude_from_hvg")).alias("genes_allowed"),
        F.count_if("exclude_from_hvg").alias("genes_excluded_total"),
        F.count_if("exclude_mitochondrial").alias("genes_excluded_mitochondrial"),
        F.count_if("exclude_ribosomal").alias("genes_excluded_ribosomal"),
        F.count_if("exclude_noncoding_like").alias("genes_excluded_noncoding_like"),
        F.lit(selected).cast("long").alias("hvgs_selected"),
    )


def batch_moments(counts: DataFrame, obs: DataFrame, batch: str, cell: Sequence[str] = CELL) -> DataFrame:
    """Mean and sample variance of raw counts per batch and gene, zeros included.

    Only genes seen in a batch have a row; the others have mean and variance 0.
    """
    sizes = obs.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(obs.select(*cell, batch), list(cell))
    sums = rows.groupBy(batch, "gene").agg(
        F.sum("count").alias("s1"), F.sum(F.col("count") * F.col("count")).alias("s2")
    )
    out = sized_join(sums, sizes, [batch], computed=True)
    mean = F.col("s1") / F.col("n")
    var = F.when(F.col("n") > 1, (F.col("s2") - F.col("s1") * mean) / (F.col("n") - 1))
    return out.select(batch, "gene", "n", mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("variance"))


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic regression with tricube weights at the ascending points ``at``."""
    k = min(max(int(np.ceil(span * len(x))), 4), len(x))
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    fitted, low = np.empty(len(at)), 0
    for i, point in enumerate(at):
        # the k nearest are a run of the sorted values, which only moves up
        while low + k < len(xs) and xs[low + k] - point < point - xs[low]:
            low += 1
        d = xs[low : low + k] - point
        h = max(np.abs(d).max(), 1e-12) * 1.0000001
        u = d / h
        w = (1 - np.abs(u) ** 3) ** 3
        design = np.stack((np.ones(k), u, u * u))
        coef, *_ = np.linalg.lstsq((design * w) @ design.T, (design * w) @ ys[low : low + k], rcond=None)
        fitted[i] = coef[0]
    return fitted


def _trend(pdf: pd.DataFrame, batch: str, span: float) -> pd.DataFrame:
    """Fitted deviation of every gene of one batch (the genome bounds its rows)."""
    out = pdf[[batch, "gene", "n", "mean"]].copy()
    ok = (pdf["variance"] > 0) & (pdf["mean"] > 0)
    reg = np.ones(len(pdf))
    if ok.sum() > 3:
        x = np.log10(pdf.loc[ok, "mean"].to_numpy())
        y = np.log10(pdf.loc[ok, "variance"].to_numpy())
        points, where = np.unique(x, return_inverse=True)
        reg[ok.to_numpy()] = np.sqrt(10 ** local_quadratic(x, y, points, span)[where])
    out["reg_std"] = reg
    out["clip"] = reg * np.sqrt(pdf["n"].to_numpy()) + pdf["mean"].to_numpy()
    out["constant"] = ~ok.to_numpy()
    return out


def normalized_variance(
    counts: DataFrame, obs: DataFrame, batch: str, cell: Sequence[str] = CELL, span: float = 0.3
) -> DataFrame:
    """Variance of clipped standardised counts per batch and gene.

    The trend is fitted per batch in pandas on one row per gene; both passes over
    the counts are plain aggregates.
    """
    moments = batch_moments(counts, obs, batch, cell)
    schema = (
        f"{batch} {dict(moments.dtypes)[batch]}, gene {dict(moments.dtypes)['gene']}, n long, mean double, "
        "reg_std double, clip double, constant boolean"
    )
    fitted = materialize(moments.groupBy(batch).applyInPandas(lambda pdf: _trend(pdf, batch, span), schema))
    rows = counts.join(obs.select(*cell, batch), list(cell))
    clipped = F.least(F.col("count"), F.col("clip"))
    sums = (
        rows.join(fitted.select(batch, "gene", "clip"), [batch, "gene"])
        .groupBy(batch, "gene")
        .agg(F.sum(clipped).alias("c1"), F.sum(clipped * clipped).alias("c2"))
    )
    out = sums.join(fitted, [batch, "gene"])
    value = (F.col("n") * F.col("mean") * F.col("mean") + F.col("c2") - F.lit(2.0) * F.col("c1") * F.col("mean")) / (
        (F.col("n") - 1) * F.col("reg_std") * F.col("reg_std")
    )
    return out.select(
        batch, "gene", F.when(F.col("constant") | (F.col("n") < 2), F.lit(0.0)).otherwise(value).alias("norm_variance")
    )


def normalized_dispersion(moments: DataFrame, n_bins: int = 20) -> DataFrame:
    """(gene, mean, dispersion, bin, disp_norm) of genes by their mean and variance over all cells.

    Dispersion is variance over mean. Genes are cut into bins at the percentiles
    5, 10, ... of the mean, and a gene's value is its distance from the median
    dispersion of its bin, in units of the bin's median absolute deviation from
    it (times 1.4826). Genes of mean 0 have no dispersion and no value; in a bin
    whose deviation is 0 the median itself counts as 0 and the others have none.
    """
    seen = moments.where("mean > 0").select("gene", "mean", (F.col("variance") / F.col("mean")).alias("dispersion"))
    seen = materialize(seen)
    probs = {f"p{i}": i / n_bins for i in range(1, n_bins)}
    edges = grouped_quantiles(seen.withColumn("_all", F.lit(0)), ["_all"], "mean", probs)
    edges = edges.select("_all", F.array_sort(F.array_distinct(F.array(*probs))).alias("_edges"))
    # one row on the right side
    placed = seen.withColumn("_all", F.lit(0)).join(F.broadcast(edges), "_all")
    binned = materialize(placed.select("gene", "mean", "dispersion", F.size(F.filter("_edges", lambda e: e < F.col("mean"))).alias("bin")))
    middle = grouped_quantiles(binned, ["bin"], "dispersion", {"_median": 0.5})
    away = binned.join(middle, "bin").withColumn("_away", F.abs(F.col("dispersion") - F.col("_median")))
    away = materialize(away)
    spread = grouped_quantiles(away, ["bin"], "_away", {"_mad": 0.5})
    out = away.join(spread, "bin")
    scaled = (F.col("dispersion") - F.col("_median")) / (F.col("_mad") * MAD_SCALE)
    flat = F.when(F.col("_away") == 0, F.lit(0.0))
    return out.select("gene", "mean", "dispersion", "bin", F.when(F.col("_mad") > 0, scaled).otherwise(flat).alias("disp_norm"))


def fallback_genes(moments: DataFrame, var: DataFrame, n: int, symbol: str = "gene") -> DataFrame:
    """The ``n`` allowed genes of largest normalised dispersion, for data whose trend cannot be fitted; fails where there are fewer."""
    ranked = exclusion_table(var, symbol).join(normalized_dispersion(moments), "gene")
    chosen = ranked.where(~F.col("exclude_from_hvg") & F.col("disp_norm").isNotNull()).orderBy(F.desc("disp_norm"), "gene").limit(n)
    chosen = materialize(chosen.select("gene", "mean", "dispersion", "bin", "disp_norm"))
    found = chosen.count()
    if found < n:
        raise ValueError(f"only {found} of {n} allowed variable genes found")
    return chosen


def whole_moments(counts: DataFrame, obs: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(gene, mean, variance) of log-normalised counts taken back to their scale, over all cells, zeros included.

    Counts are scaled to equal cell totals; sums are made in the task.
    """
    n = obs.select(F.count(F.lit(1))).scalar()
    total = F.sum("count").over(Window.partitionBy(*cell))
    scaled = counts.withColumn("_t", total).select("gene", (F.col("count") * F.lit(float(TARGET_SUM)) / F.col("_t")).alias("x"))
    sums = scaled.groupBy("gene").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    mean = F.col("s1") / n
    return sums.select("gene", mean.alias("mean"), F.greatest((F.col("s2") - F.col("s1") * mean) / (n - 1), F.lit(0.0)).alias("variance"))


def has_trend(counts: DataFrame, obs: DataFrame, batch: str, cell: Sequence[str] = CELL) -> bool:
    """Whether some batch has more than three genes that vary, which the trend needs; one row per batch reaches the driver."""
    varying = F.count_if((F.col("variance") > 0) & (F.col("mean") > 0))
    return not batch_moments(counts, obs, batch, cell).groupBy(batch).agg(varying.alias("_n")).where("_n > 3").isEmpty()


def rank_genes(norm: DataFrame, var: DataFrame, batch: str, n_top: int) -> DataFrame:
    """Median rank over the batches where a gene is among the top ``n_top``.

    The window runs over the genes of one batch, which the genome bounds.
    """
    w = Window.partitionBy(batch).orderBy(F.desc("norm_variance"), "gene")
    top = norm.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < n_top)
    stats = top.groupBy("gene").agg(
        F.percentile("_r", 0.5).alias("median_rank"), F.count(F.lit(1)).alias("n_batches")
    )
    return var.join(stats, "gene", "left")


def select_variable_genes(
    counts: DataFrame, obs: DataFrame, var: DataFrame, batch: str, n: int, cell: Sequence[str] = CELL,
    symbol: str = "gene",
) -> DataFrame:
    """The ``n`` allowed genes with the lowest median rank; fails where there are fewer.

    Where no batch has a trend to be fitted, genes are ranked by normalised dispersion over all cells instead.
    """
    n_genes = var.count()
    pool = min(n_genes, max(3 * n, n + 5000))
    if not has_trend(counts, obs, batch, cell):
        return fallback_genes(whole_moments(counts, obs, cell), var, n, symbol)
    ranked = rank_genes(normalized_variance(counts, obs, batch, cell), exclusion_table(var, symbol), batch, pool)
    chosen = (
        ranked.where(~F.col("exclude_from_hvg") & F.col("median_rank").isNotNull())
        .orderBy("median_rank", F.desc("n_batches"), "gene")
        .limit(n)
    )
    found = chosen.count()
    if found < n:
        raise ValueError(f"only {found} of {n} allowed variable genes found")
    return chosen.select("gene", "median_rank", "n_batches")
