"""Schema-level helpers: they look at column names, never at rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoquilt.constants import (
    ANNOTATION_HINTS,
    DONOR_HINTS,
    LIBRARY_HINTS,
    SAMPLE_HINTS,
)
from cytoquilt.functions.text import blank_to_null, clean_intake


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def annotation_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if any(h in c.lower() for h in ANNOTATION_HINTS)]


def first_hinted_column(columns: Sequence[str], hints: Sequence[str]) -> str:
    """First match by hint order, then by column order; '' where none fits."""
    return next((c for h in hints for c in columns if h in c.lower()), "")


def metadata_fields(columns: Iterable[str]) -> dict[str, str]:
    """Donor, sample and library candidates, each sorted and ';'-joined."""
    kinds = {"donor": DONOR_HINTS, "sample": SAMPLE_HINTS, "library": LIBRARY_HINTS}
    by_lower = {c.lower(): c for c in columns}
    return {
        kind: ";".join(sorted({c for low, c in by_lower.items() if any(h in low for h in hints)}))
        for kind, hints in kinds.items()
    }


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def text_from(df: DataFrame, candidates: Sequence[str], default: str = "") -> Column:
    """The first column that exists, even where it is blank."""
    for name in candidates:
        if name in df.columns:
            return blank_to_null(F.col(quote(name)))
    return F.lit(default)


def write_safe(df: DataFrame) -> DataFrame:
    """Text cleaned to '', booleans without NULL, other types as they are."""

    def fix(field: T.StructField) -> Column:
        c = F.col(quote(field.name))
        if isinstance(field.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(False))
        elif isinstance(field.dataType, T.StringType):
            c = clean_intake(c)
        return c.alias(field.name)

    return df.select(*[fix(f) for f in df.schema.fields])


def reorder(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, the rest after them in their order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*[F.col(quote(c)) for c in first + [c for c in df.columns if c not in first]])


def keep_exactly(df: DataFrame, keep: Sequence[str], flag_prefix: str = "has_") -> DataFrame:
    """Only ``keep``, in that order; what is missing becomes '' or false."""
    cols = []
    for name in keep:
        if name in df.columns:
            cols.append(F.col(quote(name)))
        else:
            cols.append(F.lit(False if name.startswith(flag_prefix) else "").alias(name))
    return df.select(*cols)


def drop_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])
