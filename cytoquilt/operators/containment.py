"""Texts of one table that stand inside texts of another, by an inverted index of character n-grams.

If a text stands inside another, so does each of its n-grams. A short text asks
for one n-gram only, the one that the fewest long texts have; the long texts that
have it are candidates, and each is checked. An n-gram that none has ends the
search. The longer the text, the longer its n-grams, so that they are rare.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.session import materialize

#: n-gram lengths; a text asks with the largest that it is long enough for
LENGTHS = (1, 2, 4, 8, 16)


def asking_length(text: Column) -> Column:
    """The largest n-gram length that the text has room for; NULL for an empty text."""
    n = F.length(text)
    return F.greatest(F.lit(None).cast("int"), *[F.when(n >= k, F.lit(k)) for k in LENGTHS])


def grams(text: Column, length: Column) -> Column:
    """Distinct n-grams of that length."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, length)))


def all_grams(text: Column) -> Column:
    """Distinct n-grams of every length in use."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(F.length(text) >= k, grams(text, F.lit(k))).otherwise(none) for k in LENGTHS]))


def contained_pairs(short: DataFrame, long: DataFrame, keys: Sequence[str], inner: str, outer: str) -> DataFrame:
    """(keys, inner, outer) for every text ``inner`` of ``short`` inside a text ``outer`` of ``long`` with equal keys.

    Both sides are taken once per distinct keys and text; empty and null texts
    take no part. Work grows with the candidates of the rarest n-grams, not with
    the product of the sides.
    """
    keys = list(keys)
    asks = short.where(F.length(inner) > 0).select(*keys, inner).distinct()
    asks = asks.select(*keys, inner, F.explode(grams(F.col(inner), asking_length(F.col(inner)))).alias("_gram"))
    has = long.where(F.length(outer) > 0).select(*keys, outer).distinct()
    has = has.select(*keys, outer, F.explode(all_grams(F.col(outer))).alias("_gram"))
    # postings of the n-grams that are asked for, read for their sizes and for the candidates
    postings = materialize(has.join(asks.select(*keys, "_gram").distinct(), [*keys, "_gram"], "left_semi"))
    sizes = postings.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rated = asks.join(sizes, [*keys, "_gram"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy(*keys, inner).agg(F.min(F.struct("_n", "_gram")).alias("_best")).where("_best._n > 0")
    rarest = rarest.select(*keys, inner, F.col("_best._gram").alias("_gram"))
    found = rarest.join(postings, [*keys, "_gram"]).where(F.contains(F.col(outer), F.col(inner)))
    return found.select(*keys, inner, outer)
