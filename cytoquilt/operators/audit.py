"""Dataset audit: what kind of numbers a matrix holds and what can be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.constants import COUNTS_LAYER_PRIORITY, KEY_GENES
from cytoquilt.functions.columns import metadata_fields
from cytoquilt.functions.numbers import is_finite, is_integer_like

AUDIT_STATES = (
    "scaled_or_integrated_X", "raw_like_X", "recoverable_counts_layer", "recoverable_raw_slot",
    "normalized_or_noninteger_X", "unreadable_or_unknown",
)


def matrix_stats(counts: DataFrame, by: str = "gse_id", first_values: int | None = None) -> DataFrame:
    """Per dataset and matrix: stored values, negatives, whole-number share, maximum.

    All values are looked at unless ``first_values`` restricts it to the first
    stored ones by a ``value_pos`` column. Non-finite values are left out.
    """
    stored = counts.groupBy(by, "matrix").agg(F.count(F.lit(1)).alias("nnz"))
    looked = counts if first_values is None else counts.where(F.col("value_pos") < first_values)
    fine = is_finite("count")
    v = F.when(fine, F.col("count"))
    seen = looked.groupBy(by, "matrix").agg(
        F.bool_or(v < 0).alias("has_negative"),
        F.avg(F.when(fine, is_integer_like("count").cast("double"))).alias("integer_like_fraction"),
        F.max(v).alias("max_value"),
    )
    return stored.join(seen, [by, "matrix"], "left")


def classify_state(
    x_negative: Column, x_integer: Column, has_counts: Column, counts_integer: Column,
    has_raw: Column, raw_integer: Column,
) -> dict[str, Column]:
    """State, category and reason. A fraction of exactly 0.98 is enough."""
    cases = [
        (F.coalesce(x_negative, F.lit(False)), "scaled_or_integrated_X", "C",
         "negative values in X: scaled or integrated data"),
        (F.coalesce(x_integer >= 0.98, F.lit(False)), "raw_like_X", "A", "X is integer-like: usable as raw counts"),
        (has_counts & F.coalesce(counts_integer >= 0.98, F.lit(False)), "recoverable_counts_layer", "B",
         "a counts layer is there and integer-like"),
        (has_raw & F.coalesce(raw_integer >= 0.98, F.lit(False)), "recoverable_raw_slot", "B",
         "a raw matrix is there and integer-like"),
        (F.coalesce(~x_negative, F.lit(False)), "normalized_or_noninteger_X", "C",
         "X is not integer-like and no raw counts can be recovered"),
    ]
    rest = ("unreadable_or_unknown", "C", "no reliable raw-count source could be told")
    out = {}
    for i, name in enumerate(("state_label", "category", "category_reason")):
        chain = None
        for cond, *texts in cases:
            chain = F.when(cond, texts[i]) if chain is None else chain.when(cond, texts[i])
        out[name] = chain.otherwise(rest[i])
    return out


def gene_axis_stats(var: DataFrame, by: str = "gse_id", symbol: str = "symbol", first: int | None = None) -> DataFrame:
    """Genes, repeated names, naming style of all names (or of the ``first`` ones), key genes present."""
    upper = F.upper(F.col(symbol))
    early = F.lit(True) if first is None else F.col("gene_pos") < first
    share = lambda cond: F.avg(F.when(early, cond.cast("double")))
    style = (
        F.when(F.col("_ensg") >= 0.7, "ensembl_like")
        .when(F.col("_symbol") >= 0.7, "gene_symbol_like")
        .when(F.col("_ensg").isNull(), "empty")
        .otherwise("mixed_or_custom")
    )
    flags = [F.max(F.when(upper == g, F.lit(g))).alias(f"_g{i}") for i, g in enumerate(KEY_GENES)]
    # names are counted per name first, so a distinct count never sits on one task
    out = var.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_vars"),
        share(upper.startswith("ENSG")).alias("_ensg"),
        share(upper.rlike("^[A-Z0-9_.-]+$")).alias("_symbol"),
        *flags,
    )
    names = var.groupBy(by, symbol).agg(F.count(F.lit(1)).alias("_n"))
    repeated = names.groupBy(by).agg((F.sum("_n") - F.count(F.lit(1))).alias("duplicate_var_names"))
    present = F.concat_ws(";", *[F.col(f"_g{i}") for i in range(len(KEY_GENES))])
    return out.join(repeated, by).select(
        by, "n_vars", "duplicate_var_names", style.alias("gene_naming_style"), present.alias("tcr_genes_present")
    )


def audit_datasets(
    registry: DataFrame,
    counts: DataFrame,
    obs: DataFrame,
    var: DataFrame,
    by: str = "gse_id",
    symbol: str = "symbol",
    first_values: int | None = None,
    obs_columns: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One audit row per registered dataset, with its state and category.

    ``obs_columns`` gives the cell columns each dataset really has; without it
    the columns of ``obs`` hold for all.
    """
    stats = matrix_stats(counts, by, first_values)
    # the counts layer by name: the listed names in order, else any that speaks of counts
    named = F.lower(F.substring_index("matrix", "layer:", -1))
    place = F.coalesce(*[F.when(named == n, F.lit(i)) for i, n in enumerate(COUNTS_LAYER_PRIORITY)], F.when(named.contains("count"), F.lit(99)))
    place = F.when(F.col("matrix").startswith("layer:"), place)
    layer = F.min(F.when(place.isNotNull(), F.struct(place.alias("place"), "matrix", "integer_like_fraction")))

    def pick(cond: Column, col: str) -> Column:
        return F.max(F.when(cond, F.col(col)))

    is_x, is_raw = F.col("matrix") == "X", F.col("matrix") == "raw"
    flat = stats.groupBy(by).agg(
        pick(is_x, "nnz").alias("x_nnz"),
        pick(is_x, "has_negative").alias("x_has_negative"),
        pick(is_x, "integer_like_fraction").alias("x_integer_like_fraction"),
        pick(is_x, "max_value").alias("x_max"),
        layer.isNotNull().alias("has_counts_layer"),
        layer["integer_like_fraction"].alias("counts_integer_like_fraction"),
        F.bool_or(is_raw).alias("has_raw"),
        pick(is_raw, "integer_like_fraction").alias("raw_integer_like_fraction"),
    )
    cells = obs.groupBy(by).agg(F.count(F.lit(1)).alias("n_obs"))
    out = registry.join(flat, by, "left").join(cells, by, "left").join(gene_axis_stats(var, by, symbol), by, "left")
    out = out.withColumns(
        {
            "has_counts_layer": F.coalesce("has_counts_layer", F.lit(False)),
            "has_raw": F.coalesce("has_raw", F.lit(False)),
            "x_density": F.col("x_nnz")
            / F.nullif(F.col("n_obs").cast("double") * F.col("n_vars"), F.lit(0.0)),
        }
    )
    out = out.withColumns(
        classify_state(
            F.col("x_has_negative"), F.col("x_integer_like_fraction"), F.col("has_counts_layer"),
            F.col("counts_integer_like_fraction"), F.col("has_raw"), F.col("raw_integer_like_fraction"),
        )
    )
    if obs_columns is None:
        fields = metadata_fields([c for c in obs.columns if c != by])
        return out.withColumns({f"{k}_fields": F.lit(v) for k, v in fields.items()})
    for kind in ("donor", "sample", "library"):
        chain = F.lit("")
        for gse, columns in obs_columns.items():
            chain = F.when(F.col(by) == gse, metadata_fields(columns)[kind]).otherwise(chain)
        out = out.withColumn(f"{kind}_fields", chain)
    return out


def category_counts(audit: DataFrame) -> DataFrame:
    return (
        audit.groupBy("category", "state_label")
        .agg(F.count(F.lit(1)).alias("datasets"))
        .orderBy("category", F.desc("datasets"), "state_label")
    )


def field_coverage(audit: DataFrame, fields: Sequence[str] = ("donor_fields", "sample_fields", "library_fields")) -> DataFrame:
    """Datasets with and without each kind of field, long form."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = audit.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("field_type"), has(c).alias("has")) for c in fields])).alias("f")
    ).select("f.*")
    return rows.groupBy("field_type").agg(
        F.count_if("has").alias("datasets_with_field"), F.count_if(~F.col("has")).alias("datasets_without_field")
    )


def category_a(audit: DataFrame, by: str = "gse_id") -> DataFrame:
    """Datasets whose X can be used as it is; fails where there is none."""
    good = audit.where("category = 'A'")
    if good.limit(1).count() == 0:
        raise ValueError("no category A dataset in the audit")
    return good.orderBy(by)
