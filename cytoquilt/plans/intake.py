"""Config-driven intake of new datasets into the shared cell schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.constants import (
    BASE_CELL_COLUMNS,
    CHAINS_ALL,
    DATASET_ID_COLUMNS,
    KEEP_COLUMNS,
    METADATA_ALIASES,
    METADATA_DEFAULTS,
    ORIGINAL_ID_COLUMNS,
    STALE_COLUMNS,
)
from cytoquilt.functions.barcodes import (
    barcode_from_name,
    cdr3_of_chain,
    global_cell_id,
    library_cell_id,
    stripped_core,
)
from cytoquilt.functions.columns import drop_present, keep_exactly, quote, text_from, write_safe
from cytoquilt.functions.text import clean_intake
from cytoquilt.operators.ordering import grouped_row_number
from cytoquilt.operators.tcr import (
    merge_receptors,
    number_columns,
    one_row_per_cell,
    receptor_flags,
    text_columns,
)

RECEPTOR_COLUMNS = [f"{ch}_{f}" for ch in CHAINS_ALL for f in
                    ("cdr3", "v", "d", "j", "cdr3_nt", "clone_id", "umis", "reads", "c_gene")]
FLAG_COLUMNS = ["has_TRA_TRB_paired", "has_TRG_TRD_paired", "has_any_ab_tcr", "has_any_gd_tcr"]
PREPARED_COLUMNS = [*KEEP_COLUMNS, *RECEPTOR_COLUMNS, *FLAG_COLUMNS]


@dataclass(frozen=True)
class Repair:
    """Dataset-specific corrections after alias resolution.

    ``always`` overwrites, ``if_all_blank`` fills a column only where it is blank
    for every cell of the dataset.
    """

    always: dict[str, str] = field(default_factory=dict)
    if_all_blank: dict[str, str] = field(default_factory=dict)


def prepare_cells(obs: DataFrame, alias: str, name: str, position: str, bucket_rows: int = 1_000_000,
                  repair: Repair = Repair()) -> DataFrame:
    """Any cell table in the fixed keep-list schema.

    ``name`` is the cell-name column, ``position`` a dense row number (the order
    in which repeated names get their ``__dupN`` suffix). An alias stands for the
    first listed column that exists, even where it is blank.
    """
    work = drop_present(obs, STALE_COLUMNS)
    given = text_from(work, DATASET_ID_COLUMNS, alias)
    work = work.withColumn("_gse", F.coalesce(F.nullif(given, F.lit("")), F.lit(alias)))
    seen = work.groupBy("_gse").agg(F.lit(1).alias("_x")).orderBy("_gse").limit(2).collect()
    single = seen[0]["_gse"] if len(seen) == 1 else None
    fallback = single or alias

    cols: dict[str, Column] = {}
    for target, sources in METADATA_ALIASES.items():
        default = METADATA_DEFAULTS.get(target, "")
        if target in ("project name", "sample_id", "sampleid", "library_id"):
            default = fallback
        if target in ("sampleid", "library_id") and not set(sources) & set(work.columns):
            # the first row's sample stands in for the whole table
            sample = F.coalesce(text_from(work, METADATA_ALIASES["sample_id"], fallback), F.lit(""))
            cols[target] = F.coalesce(work.select(F.min_by(sample, position)).scalar(), F.lit(fallback))
            continue
        cols[target] = F.coalesce(text_from(work, sources, default), F.lit(""))
    derived = barcode_from_name(F.col(quote(name)))
    codes = F.coalesce(F.nullif(cols["barcodes"], F.lit("")), derived)
    cols["barcodes"] = codes
    cols["barcode"] = F.coalesce(F.nullif(cols["barcode"], F.lit("")), codes)
    cols["barcode_core"] = F.coalesce(F.nullif(cols["barcode_core"], F.lit("")), stripped_core(codes))
    original = F.coalesce(text_from(work, ORIGINAL_ID_COLUMNS, ""), F.lit(""))
    cols["original_cell_id"] = F.coalesce(F.nullif(original, F.lit("")), F.col(quote(name)).cast("string"))
    work = work.select(
        "*", *[c.alias(f"_new_{i}") for i, c in enumerate(cols.values())]
    )
    # Spark reads names without regard to case, so "Tissue" makes way for "tissue"
    made = {n.lower() for n in cols}
    keep_old = [c for c in work.columns if not c.startswith("_new_") and c.lower() not in made]
    work = work.select(
        *[F.col(quote(c)) for c in keep_old], *[F.col(f"_new_{i}").alias(n) for i, n in enumerate(cols)]
    )
    work = drop_present(work, ["source_gse_id"]).withColumnRenamed("_gse", "source_gse_id")

    if single is None:
        work = work.withColumn("cell_id", F.col(quote(name)).cast("string"))
    else:
        base = global_cell_id(F.lit(single), "original_cell_id")
        work = work.withColumn("_base", base)
        bucket = F.floor(F.col(position) / F.lit(bucket_rows)).cast("long")
        work = grouped_row_number(work, ["_base"], [F.col(position)], bucket, "_nth")
        suffixed = F.concat_ws("__dup", "_base", (F.col("_nth") - 1).cast("string"))
        work = work.withColumn("cell_id", F.when(F.col("_nth") > 1, suffixed).otherwise(F.col("_base")))
    work = receptor_flags(work)
    for column, value in repair.always.items():
        work = work.withColumn(column, F.lit(value))
    for column, value in repair.if_all_blank.items():
        any_text = work.select(F.count_if(F.col(quote(column)) != "")).scalar()
        work = work.withColumn(column, F.when(any_text == 0, F.lit(value)).otherwise(F.col(quote(column))))
    return write_safe(keep_exactly(work, ["cell_id", *PREPARED_COLUMNS]))


@dataclass(frozen=True)
class IntakeSpec:
    """What a new dataset adds to the shared builder: its columns as expressions."""

    gse_id: str
    columns: dict[str, Callable[[DataFrame], Column]]
    source_note: str = ""
    matrix_file: str = ""
    platform_id: str = ""
    technology_simple: str = "10x 5'"


def build_cells(cells: DataFrame, spec: IntakeSpec, tcr: DataFrame | None = None, order: str = "row_ord") -> DataFrame:
    """Cells of one new dataset: derived columns, receptor merge, final ids."""
    made = cells.withColumns({name: make(cells) for name, make in spec.columns.items()})
    if tcr is not None:
        unique = one_row_per_cell(tcr, order) if order in tcr.columns else tcr
        made = merge_receptors(made, unique)
    for needed in ("sample_id", "library_id", "barcode"):
        if needed not in made.columns:
            raise ValueError(f"{spec.gse_id} lacks the column {needed}")
    yes = F.lower(clean_intake("TCRseq")) == "yes" if "TCRseq" in made.columns else F.lit(False)

    def flag(column: str) -> Column:
        have = clean_intake(column) if column in made.columns else F.lit("")
        return F.when(yes, "yes").otherwise(have)

    constants = {
        "gse_id": F.lit(spec.gse_id),
        "source_note": F.lit(spec.source_note),
        "matrix_file": F.lit(spec.matrix_file),
        "platform_id": F.lit(spec.platform_id),
        "technology_simple": F.lit(spec.technology_simple),
        "tcr_vdj_flag": flag("tcr_vdj_flag"),
        "tcr_availability": flag("tcr_availability"),
        "cell_id": library_cell_id("library_id", "sample_id", "barcode"),
    }
    return write_safe(made.withColumns(constants))


def paired_text_receptors(cells: DataFrame, pairs: str, clone: str, order: str = "row_ord") -> DataFrame:
    """Receptor table from one text column such as ``TRB:x;TRA:y`` per cell."""
    from cytoquilt.functions.barcodes import barcode_core

    texts, numbers = text_columns(("TRA", "TRB")), number_columns(("TRA", "TRB"))
    cols = {c: F.lit("") for c in texts} | {c: F.lit(0).cast("long") for c in numbers}
    for ch in ("TRA", "TRB"):
        cols[f"{ch}_cdr3"] = cdr3_of_chain(F.col(quote(pairs)), ch)
        cols[f"{ch}_clone_id"] = clean_intake(F.col(quote(clone)))
    return cells.select(
        clean_intake("sample_id").alias("sample_id"),
        barcode_core("barcode").alias("barcode_core"),
        F.col(order),
        *[c.alias(n) for n, c in cols.items()],
    )


def base_metadata(cells: DataFrame, receptor: Sequence[str] | None = None) -> DataFrame:
    """The shared metadata header of intake cells; what is missing is ''."""
    receptor = receptor or text_columns(("TRA", "TRB")) + number_columns(("TRA", "TRB"))
    header = [*BASE_CELL_COLUMNS, *receptor, "barcode"]
    return cells.select(
        *[(clean_intake(F.col(quote(c))) if c in cells.columns else F.lit("")).alias(c) for c in header]
    )


def candidate_metadata(candidates: DataFrame, base: DataFrame, header: Sequence[str]) -> DataFrame:
    """Candidate cells with their base metadata in a given header; every one must match."""
    from cytoquilt.operators.metadata import join_one_to_one

    keys = ["gse_id", "cell_id"]
    joined = join_one_to_one(candidates, base, keys, {"sample_id": "sample_label"})
    joined = joined.withColumns(
        {
            "sampleid": F.col("sample_id"),
            "tcr_availability": F.when(F.lower(clean_intake("TCRseq")) == "yes", "yes").otherwise(
                clean_intake("tcr_availability")
            ),
        }
    )
    return keep_exactly(joined, list(header))
