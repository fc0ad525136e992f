"""Places of regular-expression matches with built-in functions only.

A text split at a pattern and the list of its matches give every match's place:
the lengths before it add up to its start. Running sums go by blocks, so a text
with very many matches stays far from quadratic work. Places are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, quoted

BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A kind of span: pattern (Java), which matches count (on the matched text), and when to look at all."""

    name: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    when: Callable[[Column], Column] | None = None


def held(df: DataFrame, columns: Sequence[Column], name: str, value: Column) -> DataFrame:
    """``columns`` and a computed one that later expressions read instead of working it out again."""
    return df.select(*columns, F.explode(F.array(value)).alias(name))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def starts_before(values: Column, blocks: Column, i: Column) -> Column:
    """Sum of the first ``i`` of ``values``; ``blocks`` has the sums of each BLOCK of them."""
    full = F.floor(i / BLOCK).cast("int")
    return total(F.slice(blocks, F.lit(1), full)) + total(F.slice(values, full * BLOCK + 1, i - full * BLOCK))


def add_spans(
    df: DataFrame, text: str, kinds: Sequence[Kind], name: str, active: Callable[[Kind], Column] | None = None
) -> DataFrame:
    """``df`` with ``name``: array<struct<start, kind_no, end, kind, hit>> ordered by start and then kind.

    Leftmost non-overlapping matches of each kind; those that ``keep`` refuses
    are dropped. A null text has none. ``active`` may switch a kind off by row.
    """
    found_name, blocks_name = fresh(df, "_found", "_blocks")
    own = [quoted(c) for c in df.columns]
    t = quoted(text)

    def find(k: Kind) -> Column:
        look = t.isNotNull() if k.when is None else k.when(t)
        if active is not None:
            look = active(k) & look
        hits = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))
        gaps = F.transform(F.split(t, k.pattern, -1), lambda x: F.length(x))
        return F.when(look & t.rlike(k.pattern), F.struct(gaps.alias("gaps"), hits.alias("hits")))

    df = held(df, own, found_name, F.struct(*[find(k).alias(f"k{i}") for i, k in enumerate(kinds)]))

    def sums(i: int) -> Column:
        f = quoted(found_name)[f"k{i}"]
        lens = F.zip_with(f["gaps"], f["hits"], lambda g, h: g + F.coalesce(F.length(h), F.lit(0)))
        return F.when(f.isNotNull(), F.struct(f["gaps"].alias("gaps"), f["hits"].alias("hits"), lens.alias("lens")))

    df = held(df, own, found_name, F.struct(*[sums(i).alias(f"k{i}") for i in range(len(kinds))]))

    def block_sums(i: int) -> Column:
        f = quoted(found_name)[f"k{i}"]
        upto = F.floor((F.size(f["lens"]) - 1) / BLOCK).cast("int")
        return F.when(f.isNotNull(), F.transform(F.sequence(F.lit(0), upto), lambda b: total(F.slice(f["lens"], b * BLOCK + 1, F.lit(BLOCK)))))

    df = held(df, [*own, quoted(found_name)], blocks_name, F.struct(*[block_sums(i).alias(f"k{i}") for i in range(len(kinds))]))

    def spans(i: int, k: Kind) -> Column:
        f, blocks = quoted(found_name)[f"k{i}"], quoted(blocks_name)[f"k{i}"]

        def one(hit: Column, j: Column) -> Column:
            start = starts_before(f["lens"], blocks, j) + F.element_at(f["gaps"], j + 1)
            return F.struct(
                start.alias("start"), F.lit(i).alias("kind_no"), (start + F.length(hit)).alias("end"), F.lit(k.name).alias("kind"), hit.alias("hit")
            )

        out = F.transform(f["hits"], one)
        out = out if k.keep is None else F.filter(out, lambda s: k.keep(s["hit"]))
        return F.coalesce(out, F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,hit:string>>"))

    return df.select(*own, F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(kinds)])).alias(name))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, pattern: str, label: Callable[[Column], Column]) -> Column:
    """``text`` with each match of ``pattern`` put through ``label``, in one pass over split and matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.concat(g, F.when(h.isNull(), F.lit("")).otherwise(F.coalesce(label(h), h))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)
