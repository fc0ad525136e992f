"""Whole jobs: each one composes operators and returns plain DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.constants import CLUSTER_GENE_GROUPS, KEY_GENES, MIN_GENE_CELLS, REASON_PRIORITY
from cytoquilt.functions.columns import annotation_columns, first_hinted_column, quote
from cytoquilt.functions.text import clean, portable_label
from cytoquilt.operators import audit as audit_ops
from cytoquilt.operators import cleanup as clean_ops
from cytoquilt.operators import clusters as cluster_ops
from cytoquilt.operators import extract as extract_ops
from cytoquilt.operators import hvg as hvg_ops
from cytoquilt.operators import metadata as meta_ops
from cytoquilt.operators import rules as rule_ops
from cytoquilt.operators import scoring as score_ops
from cytoquilt.operators import summaries as sum_ops
from cytoquilt.operators.alignment import (
    align_counts,
    drop_noncoding,
    integer_report,
    rescue_counts,
    stack_cells,
    stack_counts,
)
from cytoquilt.operators.joining import sized_join
from cytoquilt.operators.matrix import best_name_column, choose_counts, inverse_log_counts, resolve_panel, select_counts
from cytoquilt.operators.sampling import per_group_sample, strata_sample, systematic_sample
from cytoquilt.operators.validate import axis_report
from cytoquilt.plans.intake import Repair, prepare_cells
from cytoquilt.session import materialize


def audit(registry: DataFrame, counts: DataFrame, obs: DataFrame, var: DataFrame, **options) -> dict[str, DataFrame]:
    """Dataset audit with its two report tables."""
    table = audit_ops.audit_datasets(registry, counts, obs, var, **options)
    return {
        "audit": table,
        "categories": audit_ops.category_counts(table),
        "field_coverage": audit_ops.field_coverage(table),
    }


def label_columns(obs: DataFrame) -> dict[str, Column]:
    """Donor, sample, library and annotation label of a cell table, found by column name."""
    from cytoquilt.constants import DONOR_HINTS, LIBRARY_HINTS, SAMPLE_HINTS

    names = {
        "donor_label": first_hinted_column(obs.columns, DONOR_HINTS),
        "sample_label": first_hinted_column(obs.columns, SAMPLE_HINTS),
        "library_label": first_hinted_column(obs.columns, LIBRARY_HINTS),
        "annotation_label": next(iter(annotation_columns(obs.columns)), ""),
    }
    return {out: (portable_label(F.col(quote(c))) if c else F.lit("")) for out, c in names.items()}


def extract(
    counts: DataFrame, obs: DataFrame, var: DataFrame, panels: dict[str, Sequence[str]] | None = None, by: str = "gse_id"
) -> dict[str, DataFrame]:
    """Candidate cells, their counts, and the per-dataset tables."""
    from cytoquilt.constants import EXTRACTION_PANELS

    panels = panels or EXTRACTION_PANELS
    columns = annotation_columns(obs.columns)
    profile = extract_ops.marker_profile(obs.withColumns(label_columns(obs)), counts, var, panels, (by,))
    cells = materialize(extract_ops.select_candidates(profile, columns))
    kept = cells.where("keep")
    return {
        "cells": kept,
        "counts": counts.join(kept.select(by, "cell_id"), [by, "cell_id"], "left_semi"),
        "summary": extract_ops.selection_summary(cells, by),
        "availability": extract_ops.availability_table(obs, var, panels, (by,)),
    }


def cleanup_first(
    counts: DataFrame, cells: DataFrame, var: DataFrame, min_gene_cells: int = MIN_GENE_CELLS, by: str = "gse_id"
) -> dict[str, DataFrame]:
    """Conservative pass on extraction scores, then the gene detection filter."""
    decided = materialize(clean_ops.first_pass_decisions(cells))
    return _finish_cleanup(counts, decided, var, min_gene_cells, by, ("obvious_non_tnk", "high_conf_doublet"))


def cleanup_second(
    counts: DataFrame, cells: DataFrame, var: DataFrame, min_gene_cells: int = MIN_GENE_CELLS, by: str = "gse_id",
    every_n: int = 35, chunk: int = 20_000, position: str = "cell_pos",
) -> dict[str, DataFrame]:
    """Quality and off-target pass on counts, then the gene detection filter."""
    decided = materialize(clean_ops.second_pass_reasons(clean_ops.group_scores(cells, counts, var)))
    out = _finish_cleanup(counts, decided, var, min_gene_cells, by, REASON_PRIORITY)
    if position in decided.columns:
        out["sampled"] = systematic_sample(decided, every_n, chunk, position)
    return out


def _finish_cleanup(counts, decided, var, min_cells, by, reasons):
    kept = decided.where("remove_reason = 'kept'")
    genes = materialize(
        clean_ops.gene_summary(var, clean_ops.cells_per_gene(counts, kept), min_cells, KEY_GENES)
    )
    slim = counts.join(kept.select("cell_id"), "cell_id", "left_semi")
    return {
        "cells": kept,
        "removed": decided.where("remove_reason <> 'kept'"),
        "counts": clean_ops.keep_detected_genes(slim, genes),
        "genes": genes,
        "by_dataset": clean_ops.before_after(decided, by),
        "summary": clean_ops.cleanup_summary(decided, genes, reasons, min_cells),
        "reasons": clean_ops.reason_counts(decided),
    }


def replace_metadata(
    obs: DataFrame, metadata: DataFrame, keys: Sequence[str], fill: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Checked one-to-one metadata join and its per-dataset count."""
    joined = meta_ops.join_one_to_one(obs, metadata, keys, fill)
    return {"cells": joined, "by_dataset": sum_ops.value_counts(joined, keys[0], "rows")}


def score(
    counts: DataFrame, obs: DataFrame, var: DataFrame, modules: DataFrame | None = None, cluster: str = "leiden",
    dataset: str = "source_gse_id", **options,
) -> dict[str, DataFrame]:
    """Module scores, scaled scores and the three summary tables."""
    modules = score_ops.find_modules(var) if modules is None else modules
    score_ops.require_modules(modules, score_ops.SCORES)
    scores = materialize(score_ops.add_scaled_scores(score_ops.score_cells(obs, counts, var, modules, **options)))
    raw = [f"{m}_score" for m in score_ops.SCORES] + ["trd_minus_trab"]
    scaled = ["trab_score_scaled", "trd_score_scaled", "trd_minus_trab_scaled"]
    medians = ["trd_minus_trab", "trd_minus_trab_scaled"]
    return {
        "scores": scores,
        "modules": modules,
        "summary": score_ops.score_summary(scores, raw + scaled),
        "by_cluster": score_ops.grouped_score_table(scores, cluster, raw + scaled, medians),
        "by_dataset": score_ops.grouped_score_table(scores, dataset, raw + scaled, medians),
    }


def annotate(
    obs: DataFrame, counts: DataFrame, var: DataFrame, cluster: str = "leiden", dataset: str = "source_gse_id",
    tissue: str = "tissue", panels: dict[str, Sequence[str]] | None = None, symbol: str = "gene",
) -> dict[str, DataFrame]:
    """Cluster labels from marker medians, the change table, labelled cells."""
    groups = panels or CLUSTER_GENE_GROUPS
    symbols = sorted({g for gs in groups.values() for g in gs})
    panel = resolve_panel(var, symbols, symbol=symbol, exact=True)
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    summary = cluster_ops.cluster_marker_summary(obs, counts, totals, panel, cluster, dataset, groups)
    labelled = materialize(cluster_ops.classify_clusters(summary))
    changes = cluster_ops.label_changes(labelled, cluster_ops.legacy_labels(labelled, cluster), cluster)
    cells = cluster_ops.label_cells(obs, labelled, cluster)
    return {
        "clusters": labelled,
        "changes": changes,
        "cells": cells,
        "by_dataset": sum_ops.label_crosstab(cells, [dataset, "label"]),
        "by_tissue": sum_ops.label_crosstab(cells, [tissue, "label"]),
    }


def apply_rules(
    obs: DataFrame, metadata: DataFrame, rules: dict, layout: rule_ops.RuleLayout, bundles: DataFrame | None = None,
    key: str = "metadata_key", dataset: str = "source_gse_id", mode: str = "normalized", examples: int = 5000,
    fill: Sequence[str] = ("project name", "sampleid", "sample_id", "library_id", "technology_simple"),
    take: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Full-table label correction with its export and report tables."""
    take = take or {"condition": "condition_meta", "sample_type": "sample_type", "donor_patient": "donor_patient"}
    full = meta_ops.attach_filling(obs, metadata, key, fill, take)
    if bundles is not None:
        full = rule_ops.attach_bundles(full, bundles, layout.series_fields, dataset, layout.normalizer)
    full = materialize(rule_ops.apply_rules(full, rules, layout, dataset, mode))
    unknown = F.col(layout.out) == rules.get("unknown_label", "unknown")
    first = next(iter(take.values()))
    return {
        "cells": full,
        "by_dataset": sum_ops.group_audit(
            full, dataset, {"unique_corrected": layout.out},
            {"original_blank": clean(F.col(quote(first))) == "", "corrected_unknown": unknown},
        ),
        "value_counts": sum_ops.value_counts(full, layout.out),
        "reason_counts": sum_ops.value_counts(full, f"{layout.out}_reason"),
        "unknown_examples": full.where(unknown).orderBy(key).limit(examples),
    }


def audit_rules(
    obs: DataFrame, metadata: DataFrame, rules: dict, layout: rule_ops.RuleLayout, bundles: DataFrame | None = None,
    key: str = "metadata_key", dataset: str = "source_gse_id", cell: str = "obs_name",
    fill: Sequence[str] = ("project name", "sampleid", "sample_id", "library_id", "technology_simple"),
    take: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Bounded review: a sample per dataset, dataset rules on raw text."""
    take = take or {"condition": "condition_meta", "sample_type": "sample_type", "donor_patient": "donor_patient"}
    sampled = per_group_sample(obs, [dataset], rules["sample_per_gse"], [cell], rules["random_seed"])
    full = meta_ops.attach_filling(sampled, metadata, key, fill, take)
    if bundles is not None:
        full = rule_ops.attach_bundles(full, bundles, layout.series_fields, dataset, layout.normalizer)
    full = materialize(rule_ops.apply_rules(full, rules, layout, dataset, "raw"))
    unknown = F.col(layout.out) == rules.get("unknown_label", "unknown")
    reviewed = [*dict.fromkeys([*take.values()][:2]), layout.out]
    return {
        "cells": full,
        "by_dataset": sum_ops.group_audit(
            full, dataset, {f"unique_{c}": c for c in reviewed}, {"unknown_cells": unknown}
        ),
        "distinct_values": sum_ops.distinct_values_long(full, dataset, reviewed),
    }


@dataclass(frozen=True)
class PrepareInput:
    """One dataset to be put on the base genes.

    ``counts`` holds (cell_id, gene, count, matrix), ``cells`` the cell table as it
    came, ``var`` the gene keys in ``gene`` with further name columns and ``gene_pos``.
    """

    alias: str
    counts: DataFrame
    cells: DataFrame
    var: DataFrame
    name: str = "cell_id"
    position: str = "cell_pos"
    total_column: str | None = None
    repair: Repair = Repair()


def prepare_input(given: PrepareInput, base: DataFrame, name_columns: Sequence[str]) -> dict[str, DataFrame]:
    """Counts of one dataset on the base genes, its cells in the fixed schema, and one row of statistics.

    The gene-name column with the greatest overlap with the base is taken, the
    first gene of each name; then the counts layer or the stored matrix, and where
    that holds log-normalised values and cell totals are known, counts are taken
    back from them. The counts are written once, on the base genes.
    """
    base = materialize(base.select("gene").distinct())
    # one row: the column's name
    names = best_name_column(given.var, name_columns, base, "gene").first()["name_column"]
    renamed = meta_ops.unique_symbol_map(given.var.select("gene", "gene_pos", F.col(quote(names)).alias("_name")), "_name", "gene", "gene_pos")
    renamed = renamed.select(F.col("target").alias("gene"), F.col("symbol").alias("base_gene"))
    tagged = given.counts.withColumn("gse_id", F.lit(given.alias))
    chosen = choose_counts(tagged)
    values, source = select_counts(tagged, materialize(chosen)).drop("gse_id"), chosen.select("count_matrix_source").scalar()
    if given.total_column is not None:
        values, median = inverse_log_counts(values, given.cells, given.total_column, given.position)
        source = F.when(F.lit(9500.0 <= median <= 10500.0), F.lit("inferred_from_log")).otherwise(source)
    on_base = sized_join(values, renamed.join(base.withColumnRenamed("gene", "base_gene"), "base_gene"), ["gene"], computed=True)
    counts = materialize(on_base.select("cell_id", F.col("base_gene").alias("gene"), "count"))
    cells = materialize(prepare_cells(given.cells, given.alias, given.name, given.position, repair=given.repair))
    have = renamed.select(F.col("base_gene").alias("gene")).join(base, "gene", "left_semi").select(F.count(F.lit(1)).alias("n"))
    stats = sum_ops.prep_stats(cells.withColumn("_in", F.lit(given.alias)), "_in", "sample_id", "has_TRA_TRB_paired", "has_TRG_TRD_paired", "Sorted_gdT")
    stats = stats.withColumns(
        {
            "name_column": F.lit(names), "count_matrix_source": source, "n_genes_before_align": F.lit(given.var.count()).cast("long"),
            "n_genes_after_align": base.select(F.count(F.lit(1))).scalar(), "n_missing_vs_base": base.select(F.count(F.lit(1))).scalar() - have.scalar(),
        }
    ).withColumnRenamed("_in", "alias")
    return {"counts": counts, "cells": cells, "stats": stats}


def prepare(inputs: Sequence[PrepareInput], base: DataFrame, name_columns: Sequence[str]) -> dict[str, DataFrame]:
    """All inputs on the base genes, stacked, with one row of statistics each."""
    done = [(given.alias, prepare_input(given, base, name_columns)) for given in inputs]
    counts = stack_counts([d["counts"].withColumn("alias", F.lit(alias)) for alias, d in done])
    cells = stack_cells([d["cells"].withColumn("alias", F.lit(alias)) for alias, d in done])
    return {"counts": counts, "cells": cells, "stats": stack_cells([d["stats"] for _, d in done])}


def integrate(
    counts: DataFrame, obs: DataFrame, var: DataFrame, batch: str, strata: Sequence[str], n_genes: int, n_cells: int,
    per_stratum: int = 2000, symbol: str = "gene", cell: str = "cell_id", trend: bool = True, seed: int = 0,
) -> dict[str, DataFrame]:
    """Data parts of an integration: variable genes, the training cells and their counts, and the run's figures.

    Genes come from the mean-variance trend, or from the dispersion ranking where
    there is none or ``trend`` is off. Training cells are drawn by strata. Only the
    drawn cells' counts of the chosen genes are written.
    """
    counts = materialize(counts)
    chosen = (
        hvg_ops.select_variable_genes(counts, obs, var, batch, n_genes, (cell,), symbol)
        if trend else hvg_ops.fallback_genes(hvg_ops.whole_moments(counts, obs, (cell,)), var, n_genes, symbol)
    )
    genes = materialize(chosen)
    training = materialize(strata_sample(obs, strata, n_cells, [cell], seed, per_stratum))
    slim = sized_join(counts, genes.select("gene"), ["gene"], "left_semi").join(training.select(cell), cell, "left_semi")
    flags = hvg_ops.exclusion_table(var, symbol)
    summary = hvg_ops.exclusion_summary(flags, n_genes).withColumns(
        {
            "cells_total": obs.select(F.count(F.lit(1))).scalar(), "cells_training": training.select(F.count(F.lit(1))).scalar(),
            "batches": training.select(F.count_distinct(F.col(quote(batch)))).scalar(),
        }
    )
    return {"genes": genes, "cells": training, "counts": materialize(slim), "summary": summary}


@dataclass(frozen=True)
class RescueSettings:
    min_genes_per_cell: int
    min_cells_per_gene: int
    max_mito_pct: float


def rescue_from_raw(raw: DataFrame, current_genes: DataFrame) -> dict[str, DataFrame]:
    """Raw counts of the current genes and the number check on them."""
    counts = rescue_counts(raw, current_genes)
    return {"counts": counts, "report": integer_report(counts)}


def rescue_from_inputs(
    rebuilt: DataFrame, rebuilt_cells: DataFrame, current_cells: DataFrame, current_genes: DataFrame,
    settings: RescueSettings, key: str = "alignment_key", dry_run: bool = True,
) -> dict[str, DataFrame]:
    """Rebuilt counts through the stated filters, compared with the current axes.

    ``dry_run`` stops at the comparison; otherwise the counts are put on the
    current cells and genes by the alignment key.
    """
    slim = clean_ops.count_space_filter(
        drop_noncoding(rebuilt), settings.min_genes_per_cell, settings.min_cells_per_gene, settings.max_mito_pct
    )
    slim = materialize(slim)
    left = rebuilt_cells.join(slim.select("cell_id").distinct(), "cell_id", "left_semi")
    out = {
        "counts": slim,
        "cells_report": axis_report(current_cells, left, key),
        "genes_report": axis_report(current_genes, slim.select("gene").distinct(), "gene"),
    }
    if not dry_run:
        keyed = slim.join(left.select("cell_id", key), "cell_id")
        out["repaired"] = align_counts(keyed, current_cells, current_genes, key)
    return out

