"""Label and batch-key expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.constants import T_LABEL_TERMS
from cytoquilt.functions.columns import quote
from cytoquilt.functions.text import as_col, blank_to_null, strip

# column -> (word in the key, name of the level); order is the order of preference
LADDER = (
    ("library_id", "library"),
    ("sampleid", "sampleid"),
    ("sample_id", "sample"),
    ("phase1_library_label", "phase1_library"),
    ("phase1_sample_label", "phase1_sample"),
)


def superclass(c: Column | str) -> Column:
    """Coarse class of a detailed label; natural killer is tested first."""
    text = F.lower(F.coalesce(strip(c), F.lit("")))
    nk = F.contains(text, F.lit("natural killer")) | (text == "nk cell")
    t = F.lit(False)
    for term in T_LABEL_TERMS:
        t = t | F.contains(text, F.lit(term))
    return F.when(nk, "NK_cell").when(t, "T_cell").otherwise("reference_other")


def with_batch_key(
    obs: DataFrame,
    dataset: str = "source_gse_id",
    ladder: Sequence[tuple[str, str]] = LADDER,
    key: str = "batch_key",
    level: str = "batch_level",
) -> DataFrame:
    """Batch key from the first non-blank column of the ladder, else the dataset."""
    gse = F.coalesce(blank_to_null(F.col(quote(dataset))), F.lit("unknown_gse"))
    key_col, level_col = None, None
    for name, word in ladder:
        if name not in obs.columns:
            continue
        value = blank_to_null(F.col(quote(name)))
        made = F.concat(gse, F.lit(f"|{word}|"), value)
        key_col = F.when(value.isNotNull(), made) if key_col is None else key_col.when(value.isNotNull(), made)
        level_col = (
            F.when(value.isNotNull(), name) if level_col is None else level_col.when(value.isNotNull(), name)
        )
    if key_col is None:
        return obs.withColumn(key, gse).withColumn(level, F.lit("gse"))
    return obs.withColumn(key, key_col.otherwise(gse)).withColumn(level, level_col.otherwise("gse"))


def mapped(c: Column | str, mapping: dict[str, str], default: Column | str | None = None) -> Column:
    """Literal dictionary lookup; unmapped values stay or take ``default``."""
    src = as_col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(src == old, new) if out is None else out.when(src == old, new)
    rest = src if default is None else (F.lit(default) if isinstance(default, str) else default)
    return rest if out is None else out.otherwise(rest)


def contains_ladder(c: Column | str, mapping: dict[str, str], default: str = "") -> Column:
    """First entry whose text is contained in the value."""
    src = as_col(c)
    out = None
    for piece, new in mapping.items():
        hit = F.contains(src, F.lit(piece))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(default)


def pool_from_suffix(barcode: Column | str, pools: Sequence[str]) -> Column:
    """Pool name from the 1-based number after the last dash of a barcode."""
    number = F.substring_index(as_col(barcode), "-", -1).try_cast("int")
    return F.when(number >= 1, F.get(F.array(*[F.lit(p) for p in pools]), number - 1))
