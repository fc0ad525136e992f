"""Attaching per-cell metadata by checked keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.functions.columns import quote
from cytoquilt.functions.text import blank_to_null, clean_intake, prefer
from cytoquilt.operators.validate import require_one_to_one, require_unique


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order.

    Each task keeps its own first row per key before the shuffle, so a key with
    very many rows is not gathered in one place.
    """
    w = Window.partitionBy(*[F.col(quote(k)) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stack_sources(frames: Sequence[DataFrame], priority: str = "src_priority") -> DataFrame:
    """Metadata tables on top of each other, remembering which came first."""
    out = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn(priority, F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no metadata table to read")
    return out


def export_columns(obs: DataFrame, dataset: str, sample: str, cell: str) -> DataFrame:
    """Adds project name, sampleid and barcodes as cleaned copies."""
    return obs.withColumns(
        {
            "project name": clean_intake(F.col(quote(dataset))),
            "sampleid": clean_intake(F.col(quote(sample))),
            "barcodes": clean_intake(F.col(quote(cell))),
        }
    )


def join_one_to_one(
    obs: DataFrame, metadata: DataFrame, keys: Sequence[str], fill: dict[str, str] | None = None, check: bool = True
) -> DataFrame:
    """Left join where every cell must match exactly one metadata row.

    ``fill`` maps a metadata column to the cell column used where it is blank.
    """
    if check:
        require_one_to_one(obs, metadata, keys, "cells", "metadata")
    clash = [c for c in metadata.columns if c in obs.columns and c not in keys]
    meta = metadata.select(*[F.col(quote(c)).alias(f"{c}_meta" if c in clash else c) for c in metadata.columns])
    out = obs.join(meta, list(keys), "left")
    for target, fallback in (fill or {}).items():
        source = f"{target}_meta" if target in clash else target
        out = out.withColumn(target, prefer(F.col(quote(source)), F.col(quote(fallback))))
    return out


def one_per_key(side: DataFrame, key: str, order: Sequence[str | Column] | None = None) -> DataFrame:
    """``side`` without blank keys and with one row per key: the first in ``order``, then by its values."""
    plain = [f.name for f in side.schema if f.name != key and f.dataType.typeName() not in ("map", "variant")]
    named = [c for c in ("src_priority", "row_ord") if c in side.columns] if order is None else list(order)
    filled = side.where(F.coalesce(F.btrim(F.col(quote(key)).cast("string")), F.lit("")) != "")
    return keep_first(filled, [key], [*named, *[F.col(quote(c)) for c in plain]])


def attach_new_columns(
    obs: DataFrame, metadata: DataFrame, key: str, order: Sequence[str | Column] | None = None
) -> DataFrame:
    """Left lookup that adds only columns the cells do not have, plus ``metadata_matched``.

    Blank keys match nothing, and a repeated key counts with its first row, so no
    cell is multiplied.
    """
    new = [c for c in metadata.columns if c not in obs.columns]
    side = one_per_key(metadata, key, order).select(key, *[F.col(quote(c)) for c in new], F.lit(True).alias("metadata_matched"))
    return obs.join(side, key, "left").withColumn(
        "metadata_matched", F.coalesce("metadata_matched", F.lit(False))
    )


def match_summary(attached: DataFrame) -> DataFrame:
    return attached.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("metadata_matched").alias("metadata_matches"),
        F.count_if(~F.col("metadata_matched")).alias("metadata_unmatched"),
    )


def attach_filling(
    obs: DataFrame, metadata: DataFrame, key: str, fill: Sequence[str], take: dict[str, str],
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Left lookup: existing text wins for ``fill``; ``take`` columns are renamed in.

    Blank keys match nothing, and a repeated key counts with its first row, so no
    cell is multiplied.
    """
    side = one_per_key(metadata, key, order).select(
        key,
        *[F.col(quote(c)).alias(f"_m_{c}") for c in fill],
        *[F.col(quote(src)).alias(dst) for src, dst in take.items()],
    )
    out = obs.join(side, key, "left")
    for c in fill:
        have = F.col(quote(c)) if c in obs.columns else F.lit("")
        out = out.withColumn(c, prefer(have, F.col(quote(f"_m_{c}"))))
    return out.drop(*[f"_m_{c}" for c in fill])


def lookup_map(
    cells: DataFrame, table: DataFrame, key: str, table_key: str, value: str, out: str, fallback: str | None = None
) -> DataFrame:
    """Dictionary-style lookup; no hit gives the key itself or ``fallback``."""
    from cytoquilt.operators.joining import sized_join

    side = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v")).groupBy("_k").agg(F.max("_v").alias("_v"))
    joined = sized_join(cells.withColumn("_k", F.col(key)), side, ["_k"], "left")
    rest = F.col(key) if fallback is None else F.lit(fallback)
    return joined.withColumn(out, F.coalesce(F.nullif(F.col("_v"), F.lit("")), rest)).drop("_k", "_v")


def unique_symbol_map(table: DataFrame, symbol: str, target: str, order: str) -> DataFrame:
    """symbol -> target, blanks dropped, first row per symbol."""
    clean = table.select(blank_to_null(symbol).alias("symbol"), blank_to_null(target).alias("target"), order)
    return keep_first(clean.where("symbol is not null and target is not null"), ["symbol"], [order]).drop(order)


def copy_labels(sample: DataFrame, full: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Newly made label columns of the full table, unique on ``key``, onto an existing sample."""
    require_unique(full, [key], "full table")
    present = [c for c in columns if c in full.columns]
    return sample.drop(*present).join(full.select(key, *present), key, "left")


def replace_columns(obs: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Adds or replaces columns from a table unique on ``key``; a new version, nothing in place."""
    require_unique(new, [key], "new columns")
    cols = [c for c in new.columns if c != key]
    return obs.drop(*cols).join(new, key, "left")


def with_metadata(df: DataFrame, metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the metadata table has; no row is multiplied, columns stay."""
    return df.join(metadata.select(*[F.col(quote(k)) for k in keys]), list(keys), "left_semi")


def carve_out(df: DataFrame, key: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rest, side table) by a list of dataset names."""
    listed = F.coalesce(F.col(key).isin(*names), F.lit(False))
    return df.where(~listed), df.where(listed)
