"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytoquilt.functions.text import as_col, strip


def is_integer_like(c: Column | str) -> Column:
    """Close to a whole number: within 1e-6 + 1e-5 times that number."""
    v = as_col(c)
    whole = F.rint(v)
    return F.abs(v - whole) <= F.lit(1e-6) + F.lit(1e-5) * F.abs(whole)


def is_finite(c: Column | str) -> Column:
    v = as_col(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def number_or_zero(c: Column | str, dtype: str = "double") -> Column:
    """Text or number as a number, 0 where it cannot be read."""
    read = strip(c).try_cast("double")
    return F.coalesce(F.when(~F.isnan(read), read), F.lit(0.0)).cast(dtype)


def log1p_norm(count: Column | str, total: Column | str, target: float = 1e4) -> Column:
    """log1p of the count scaled to ``target`` per cell; 0 for an empty cell."""
    c, t = as_col(count), as_col(total)
    return F.when(t > 0, F.log1p(c * F.lit(target) / t)).otherwise(F.lit(0.0))


def log1p_clipped(count: Column | str, total: Column | str, target: float = 1e4) -> Column:
    """As ``log1p_norm`` but the total is never taken below 1."""
    return F.log1p(F.lit(target) * as_col(count) / F.greatest(as_col(total), F.lit(1.0)))


def pseudo_count(log_value: Column | str, cell_total: Column | str) -> Column:
    """Counts back from log1p(1e4-scaled) values, rounded half to even."""
    return F.rint(F.expm1(as_col(log_value)) * as_col(cell_total) / F.lit(1e4))
