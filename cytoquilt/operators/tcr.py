"""Receptor tables: standardising, one row per cell, sample-aware merge, flags.

The join key is always sample plus barcode core. A barcode alone is never used:
the same barcode turns up in many samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.constants import CHAIN_NUMBER_FIELDS, CHAIN_TEXT_FIELDS, CHAINS_ALL
from cytoquilt.functions.barcodes import barcode_core, full_barcode
from cytoquilt.functions.columns import quote
from cytoquilt.functions.numbers import number_or_zero
from cytoquilt.functions.text import blank_to_null, clean_intake, first_nonblank, is_truthy
from cytoquilt.operators.metadata import keep_first
from cytoquilt.operators.validate import require_unique
from cytoquilt.session import materialize

KEY = ("sample_id", "barcode_core")


def text_columns(chains: Sequence[str]) -> list[str]:
    return [f"{ch}_{f}" for ch in chains for f in CHAIN_TEXT_FIELDS]


def number_columns(chains: Sequence[str]) -> list[str]:
    return [f"{ch}_{f}" for ch in chains for f in CHAIN_NUMBER_FIELDS]


def _existing(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(quote(n)) for n in names if n in df.columns]


def _text(df: DataFrame, *names: str) -> Column:
    return first_nonblank(*_existing(df, names)) if _existing(df, names) else F.lit("")


def standardize_contigs(
    contigs: DataFrame, sample: str = "sample_id", chains: Sequence[str] = CHAINS_ALL, order: str | None = None
) -> DataFrame:
    """Contig rows in one schema; rows without barcode or with other chains go."""
    out = contigs.select(
        clean_intake(F.col(quote(sample))).alias("sample_id"),
        barcode_core(full_barcode("barcode"), cleaned=True).alias("barcode_core"),
        F.upper(F.col("chain").cast("string")).alias("chain"),
        _text(contigs, "cdr3").alias("cdr3"),
        _text(contigs, "v_gene").alias("v"),
        _text(contigs, "d_gene").alias("d"),
        _text(contigs, "j_gene").alias("j"),
        _text(contigs, "cdr3_nt").alias("cdr3_nt"),
        _text(contigs, "raw_clonotype_id").alias("clone_id"),
        (number_or_zero("umis", "long") if "umis" in contigs.columns else F.lit(0).cast("long")).alias("umis"),
        (number_or_zero("reads", "long") if "reads" in contigs.columns else F.lit(0).cast("long")).alias("reads"),
        *([F.col(order).alias("row_ord")] if order else []),
    )
    return out.where((F.col("barcode_core") != "") & F.col("chain").isin(*chains))


def best_contig(contigs: DataFrame) -> DataFrame:
    """One contig per sample, barcode and chain: most umis, then most reads, then first."""
    return keep_first(contigs, [*KEY, "chain"], [F.desc("umis"), F.desc("reads"), F.col("row_ord")])


def first_value_contig(contigs: DataFrame) -> DataFrame:
    """One row per chain: first non-empty of every text field, highest numbers."""
    firsts = [
        F.coalesce(F.min_by(f, F.when(F.col(f) != "", F.col("row_ord"))), F.lit("")).alias(f)
        for f in CHAIN_TEXT_FIELDS
    ]
    return contigs.groupBy(*KEY, "chain").agg(*firsts, *[F.max(f).alias(f) for f in CHAIN_NUMBER_FIELDS])


def pivot_chains(per_chain: DataFrame, chains: Sequence[str] = CHAINS_ALL) -> DataFrame:
    """One row per cell with the columns of every chain; '' or 0 where a chain is absent."""
    aggs = []
    for ch in chains:
        here = F.col("chain") == ch
        aggs += [F.coalesce(F.max(F.when(here, F.col(f))), F.lit("")).alias(f"{ch}_{f}") for f in CHAIN_TEXT_FIELDS]
        aggs += [F.coalesce(F.max(F.when(here, F.col(f))), F.lit(0)).alias(f"{ch}_{f}") for f in CHAIN_NUMBER_FIELDS]
    return per_chain.groupBy(*KEY).agg(*aggs)


def canonical_receptors(
    contigs: DataFrame, sample: str = "sample_id", order: str = "row_ord", rule: str = "best",
    chains: Sequence[str] = CHAINS_ALL,
) -> DataFrame:
    """Contigs to one row per cell. ``rule``: 'best' contig or 'first' non-empty values."""
    std = standardize_contigs(contigs, sample, chains, order)
    return pivot_chains(best_contig(std) if rule == "best" else first_value_contig(std), chains)


def standardize_wide(
    wide: DataFrame,
    sample: str,
    barcode: str,
    fields: dict[str, Sequence[str]],
    clone: str | None = None,
    chains: Sequence[str] = ("TRA", "TRB"),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Wide receptor tables of any layout in the canonical schema.

    ``fields`` maps a canonical column to source columns in order of preference
    (Alpha1 before Alpha2, expr before umis before reads); what is not listed or
    not there is '' or 0. ``keep`` takes further columns along, such as the row order.
    """
    cols = [
        *[F.col(quote(c)) for c in keep],
        clean_intake(F.col(quote(sample))).alias("sample_id"),
        barcode_core(full_barcode(F.col(quote(barcode))), cleaned=True).alias("barcode_core"),
    ]
    for ch in chains:
        for f in CHAIN_TEXT_FIELDS:
            sources = fields.get(f"{ch}_{f}", [clone] if f == "clone_id" and clone else [])
            cols.append(_text(wide, *sources).alias(f"{ch}_{f}"))
        for f in CHAIN_NUMBER_FIELDS:
            cols.append(number_or_zero(_text(wide, *fields.get(f"{ch}_{f}", [])), "long").alias(f"{ch}_{f}"))
    return wide.select(*cols)


def one_row_per_cell(tcr: DataFrame, order: str = "row_ord", chains: Sequence[str] = ("TRA", "TRB")) -> DataFrame:
    """Collapses repeated keys: highest numbers, first non-empty texts in row order."""
    work = tcr.withColumns({k: clean_intake(k) for k in KEY}).where("sample_id <> '' and barcode_core <> ''")
    aggs = []
    for c in text_columns(chains):
        value = clean_intake(c)
        aggs.append(F.coalesce(F.min_by(value, F.when(value != "", F.col(order))), F.lit("")).alias(c))
    aggs += [F.max(number_or_zero(c, "long")).alias(c) for c in number_columns(chains)]
    return work.groupBy(*KEY).agg(*aggs)


def merge_receptors(obs: DataFrame, tcr: DataFrame, chains: Sequence[str] = ("TRA", "TRB")) -> DataFrame:
    """Receptor columns onto the cells by sample and barcode core, plus ``TCRseq``.

    Fails where ``tcr`` is not unique on its key, so that no cell is multiplied.
    Old receptor columns of the cells are replaced, not mixed.
    """
    texts, numbers = text_columns(chains), number_columns(chains)
    # read by the check and by the join
    tcr = require_unique(materialize(tcr.select(*KEY, *texts, *numbers)), list(KEY), "receptors")
    base = obs.drop(*[c for c in texts + numbers + ["TCRseq", "barcode_core"] if c in obs.columns])
    base = base.withColumns({"barcode_core": barcode_core("barcode"), "sample_id": clean_intake("sample_id")})
    out = base.join(tcr.select(*KEY, *texts, *numbers), list(KEY), "left")
    out = out.fillna("", subset=texts).fillna(0, subset=numbers)
    found = F.lit(False)
    for c in texts:
        found = found | ((F.col(c) != "") & (F.col(c) != "0"))
    for c in numbers:
        found = found | (F.col(c) != 0)
    return out.withColumn("TCRseq", F.when(found, "yes").otherwise("no")).drop("barcode_core")


def receptor_flags(obs: DataFrame) -> DataFrame:
    """Paired and any-chain flags from CDR3 text or upstream ``has_*`` text, and ``TCRseq``."""

    def has(ch: str) -> Column:
        flag = F.lit(False)
        if f"{ch}_cdr3" in obs.columns:
            flag = F.coalesce(blank_to_null(f"{ch}_cdr3"), F.lit("")) != ""
        if f"has_{ch}" in obs.columns:
            flag = flag | is_truthy(f"has_{ch}")
        return flag

    tra, trb, trg, trd = (has(ch) for ch in CHAINS_ALL)
    any_ab, any_gd = tra | trb, trg | trd
    seen = any_ab | any_gd
    if "TCRseq" in obs.columns:
        seen = seen | is_truthy("TCRseq") | F.coalesce(
            F.lower(blank_to_null("TCRseq")).isin("yes", "detected", "available"), F.lit(False)
        )
    return obs.withColumns(
        {
            "has_TRA_TRB_paired": tra & trb,
            "has_TRG_TRD_paired": trg & trd,
            "has_any_ab_tcr": any_ab,
            "has_any_gd_tcr": any_gd,
            "TCRseq": F.when(seen, "yes").otherwise("no"),
        }
    )


PRESENCE = ("has_tra", "has_trb", "has_tra_or_trb", "has_paired", "has_none")


def presence_lookup(metadata: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Alpha/beta presence per key, first row per key."""
    tra = F.coalesce(blank_to_null("TRA_cdr3"), F.lit("")) != ""
    trb = F.coalesce(blank_to_null("TRB_cdr3"), F.lit("")) != ""
    flags = dict(zip(PRESENCE, (tra, trb, tra | trb, tra & trb, ~(tra | trb)), strict=True))
    first = keep_first(metadata, keys, list(order))
    return first.select(*[F.col(quote(k)) for k in keys], *[c.alias(n) for n, c in flags.items()])


def attach_presence(cells: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many-to-one lookup; cells without an entry get false throughout."""
    return cells.join(lookup, list(keys), "left").fillna(False, subset=list(PRESENCE))


def productive_gd(contigs: DataFrame) -> DataFrame:
    """Gamma/delta chains that carry both an amino-acid and a nucleotide CDR3."""
    ok = F.lit(True)
    for c in ("chain", "cdr3", "cdr3_nt"):
        ok = ok & (clean_intake(c) != "")
    return contigs.where(F.upper("chain").isin("TRG", "TRD") & ok)

