"""Operators on the long sparse count table ``(cell..., gene, count)``.

A pair that is not there counts as zero. Anything that needs every cell starts
from the cell table, anything that needs every gene from the gene table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.functions.genes import canonical_symbol, canonical_symbol_py, is_mitochondrial
from cytoquilt.functions.numbers import log1p_norm, pseudo_count
from cytoquilt.operators.joining import sized_join

CELL = ("cell_id",)


def panel_name(symbol: str) -> str:
    """Column name of one densified panel gene."""
    return "g_" + "".join(ch if ch.isalnum() else "_" for ch in symbol)


def resolve_panel(
    var: DataFrame,
    symbols: Iterable[str],
    by: Sequence[str] = (),
    gene: str = "gene",
    symbol: str = "symbol",
    position: str = "gene_pos",
    exact: bool = False,
) -> DataFrame:
    """Gene key of every panel symbol that a dataset has: its first occurrence.

    Later genes with the same symbol are not summed. At most one row per dataset
    and panel symbol.
    """
    if exact:
        name, wanted = F.col(symbol), list(symbols)
    else:
        name, wanted = canonical_symbol(symbol), [canonical_symbol_py(s) for s in symbols]
    hits = var.select(*by, gene, position, name.alias("panel_symbol")).where(F.col("panel_symbol").isin(*wanted))
    w = Window.partitionBy(*by, "panel_symbol").orderBy(position)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", position)


def with_group_flags(panel: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Panel genes with one 0/1 column ``in_<group>`` per marker group."""
    return panel.withColumns(
        {f"in_{n}": F.when(F.col("panel_symbol").isin(*gs), 1.0).otherwise(0.0) for n, gs in groups.items()}
    )


def cell_profile(
    counts: DataFrame,
    panel: DataFrame | None = None,
    symbols: Sequence[str] = (),
    by: Sequence[str] = (),
    cell: Sequence[str] = CELL,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Totals, detected genes and densified panel genes of each cell in one pass.

    One shuffle, with map-side combine: a partition sends at most one row per
    cell. ``panel`` is the output of :func:`resolve_panel`.
    """
    work = counts
    if panel is not None:
        work = sized_join(work, panel, [*by, "gene"], "left")
    aggs = [
        F.sum("count").alias("total"),
        F.count_if(F.col("count") != 0).alias("n_genes"),
    ]
    for s in symbols:
        aggs.append(F.max(F.when(F.col("panel_symbol") == s, F.col("count"))).alias(panel_name(s)))
    for name, expr in (extra or {}).items():
        aggs.append(expr.alias(name))
    keys = [*by, *[c for c in cell if c not in by]]
    return work.groupBy(*keys).agg(*aggs)


def with_every_cell(obs: DataFrame, profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join from the cell table; cells without any count get zeros."""
    joined = obs.join(profile, list(keys), "left")
    new = [c for c in profile.columns if c not in keys]
    # only absent rows become zero; a NaN that was there stays visible
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in new})


def cell_totals(
    counts: DataFrame, cell: Sequence[str] = CELL, mito: Column | None = None
) -> DataFrame:
    """Total count, detected genes and mitochondrial share of each cell."""
    is_mt = is_mitochondrial("gene") if mito is None else mito
    out = counts.groupBy(*cell).agg(
        F.sum("count").alias("total"),
        F.count_if(F.col("count") != 0).alias("n_genes"),
        F.sum(F.when(is_mt, F.col("count")).otherwise(0.0)).alias("_mt"),
    )
    return out.withColumn("pct_mt", F.col("_mt") / F.greatest(F.col("total"), F.lit(1.0))).drop("_mt")


def normalized(
    counts: DataFrame,
    totals: DataFrame,
    cell: Sequence[str] = CELL,
    target: float = 1e4,
    keep: DataFrame | None = None,
) -> DataFrame:
    """log1p of depth-scaled counts, long and sparse.

    ``keep`` (a small gene table) is applied before the join on the cell, so
    that only its genes are shuffled. With both tables bucketed on the cell the
    join needs no shuffle at all.
    """
    rows = counts if keep is None else sized_join(counts, keep.select("gene"), ["gene"], "left_semi")
    return (
        rows.join(totals.select(*cell, "total"), list(cell))
        .withColumn("value", log1p_norm("count", "total", target))
        .drop("total", "count")
    )


def panel_expression(
    obs: DataFrame,
    counts: DataFrame,
    panel: DataFrame,
    symbols: Sequence[str],
    by: Sequence[str] = (),
    cell: Sequence[str] = CELL,
    raw: bool = False,
) -> DataFrame:
    """Selected genes as columns for every cell: log1p values or raw counts."""
    keys = [*by, *[c for c in cell if c not in by]]
    wide = with_every_cell(obs, cell_profile(counts, panel, symbols, by, cell), keys)
    cols = [
        (F.col(panel_name(s)) if raw else log1p_norm(panel_name(s), "total")).alias(panel_name(s)) for s in symbols
    ]
    rest = [c for c in wide.columns if not c.startswith("g_")]
    return wide.select(*rest, *cols)


def unique_gene_names(var: DataFrame, bucket: Column, by: Sequence[str] = (), name: str = "gene") -> DataFrame:
    """Suffix later duplicates of a gene name: TRAC, TRAC-1, TRAC-2 ..."""
    from cytoquilt.operators.ordering import grouped_row_number

    numbered = grouped_row_number(var, [*by, name], [F.col("gene_pos")], bucket, "_rn")
    unique = F.when(F.col("_rn") > 1, F.concat_ws("-", name, F.col("_rn") - 1)).otherwise(F.col(name))
    return numbered.withColumn("unique_gene", unique).drop("_rn")


def choose_counts(counts: DataFrame, by: Sequence[str] = ("gse_id",), integer_like: Column | None = None) -> DataFrame:
    """Per dataset, the matrix to use: the counts layer where there is one, else X.

    Input has a ``matrix`` column (``X``, ``layer:counts``, ``raw``). Output has
    one row per dataset with the source chosen and how it was judged.
    """
    from cytoquilt.functions.numbers import is_integer_like

    ok = is_integer_like("count") if integer_like is None else integer_like
    stats = counts.groupBy(*by).agg(
        F.bool_or(F.col("matrix") == "layer:counts").alias("_layer"),
        F.count_if(F.col("matrix") == "X").alias("_x"),
        F.coalesce(F.bool_and(F.when(F.col("matrix") == "X", ok)), F.lit(True)).alias("_int"),
    )
    source = (
        F.when(F.col("_layer"), "layers[counts]")
        .when(F.col("_x") == 0, "X_empty")
        .when(F.col("_int"), "X_integer_like")
        .otherwise("X_noninteger_like")
    )
    return stats.select(*by, source.alias("count_matrix_source"))


def select_counts(counts: DataFrame, chosen: DataFrame, by: Sequence[str] = ("gse_id",)) -> DataFrame:
    """Rows of the matrix that :func:`choose_counts` picked."""
    marked = sized_join(counts, chosen, list(by))
    wanted = F.when(F.col("count_matrix_source") == "layers[counts]", "layer:counts").otherwise("X")
    return marked.where(F.col("matrix") == wanted).drop("matrix", "count_matrix_source")


def inverse_log_counts(
    values: DataFrame,
    obs: DataFrame,
    total_column: str,
    position: str = "cell_pos",
    probe: int | None = None,
    cell: Sequence[str] = CELL,
) -> tuple[DataFrame, float]:
    """Counts back from log1p values where the data look depth-normalised to 1e4.

    The median of the back-transformed row sums over all cells (the first
    ``probe`` of them where that is given) decides; outside 9,500 to 10,500 the
    values are handed back as they came. Returns the table and that median.
    """
    from cytoquilt.operators.quantiles import grouped_quantiles

    first = (obs if probe is None else obs.where(F.col(position) < probe)).select(*cell)
    sums = sized_join(values, first, list(cell), "right").groupBy(*cell).agg(
        F.coalesce(F.sum(F.expm1("count")), F.lit(0.0)).alias("s")
    )
    median = grouped_quantiles(sums, [], "s", {"m": 0.5}).first()["m"] or 0.0
    if not 9500.0 <= median <= 10500.0:
        return values, median
    total = F.col(total_column).cast("double")
    if obs.where(total.isNull() | F.isnan(total)).limit(1).count():
        raise ValueError(f"{total_column} is missing for some cells; counts cannot be inferred")
    joined = values.join(obs.select(*cell, total.alias("_n")), list(cell))
    return (
        joined.withColumn("count", pseudo_count("count", "_n")).drop("_n").where("count <> 0"),
        median,
    )


def best_name_column(var: DataFrame, candidates: Sequence[str], base: DataFrame, current: str) -> DataFrame:
    """The gene-name column with most genes in the base set; ties keep the earlier.

    ``base`` has one column ``gene``. One row: the chosen column and its overlap.
    """
    from cytoquilt.functions.text import blank_to_null

    names = [current, *[c for c in candidates if c in var.columns and c != current]]
    long = var.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name_column"), blank_to_null(n).alias("gene"))
                    for i, n in enumerate(names)
                ]
            )
        ).alias("v")
    ).select("v.*")
    marked = long.join(base.select("gene").distinct().withColumn("_in", F.lit(1)), "gene", "left")
    overlap = marked.groupBy("pos", "name_column").agg(F.count("_in").alias("overlap"))
    return overlap.orderBy(F.desc("overlap"), "pos").limit(1).select("name_column", "overlap")

