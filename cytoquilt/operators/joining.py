"""Joins of a large table with a usually smaller one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cytoquilt.session import materialize


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", computed: bool = False) -> DataFrame:
    """Join whose way the planner chooses by the bytes of ``right``.

    ``computed`` says that the right side is worth writing once: its size is then
    known before the join is planned. Where it is small it is broadcast, else
    both sides are shuffled and adaptive execution splits skewed partitions.
    """
    return left.join(materialize(right) if computed else right, on, how)
