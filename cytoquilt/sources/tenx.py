"""Matrix Market triplets with their barcode and feature lists as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoquilt.functions.columns import quote
from cytoquilt.operators.joining import sized_join
from cytoquilt.operators.metadata import keep_first
from cytoquilt.session import materialize
from cytoquilt.sources.files import exists, plain_path


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, number, line) of list files (barcodes or features), numbered from 1 in each file.

    All files are one plain text scan, whose lines are written once. Lines of a split have
    consecutive places, and the sizes of a file's splits give each its offset, so no line is shuffled.
    """
    lines = materialize(text_lines(spark, paths))
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    upto = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shifts = splits.select("file", "block", plain_path(F.col("file")).alias("_path"), (upto - F.col("_n") - F.col("_first") + 1).alias("_shift"))
    numbered = sized_join(lines.where("value <> ''"), shifts, ["file", "block"], computed=True)
    return numbered.select(F.col("_path").alias("file"), (F.col("at") + F.col("_shift")).cast("long").alias("number"), F.col("value").alias("line"))


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, block, at, value): lines in one scan, with their order inside each file, which is spelled as the scan does."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def read_features(spark: SparkSession, paths: str | Sequence[str], only_expression: bool = True) -> DataFrame:
    """file, number, gene_id, gene, feature_type, gene_pos, with repeated names of a file made unique."""
    return features_of(numbered_lines(spark, paths), only_expression)


def features_of(lines: DataFrame, only_expression: bool = True) -> DataFrame:
    parts = F.split("line", "\t")
    feats = lines.select(
        "file",
        "number",
        F.get(parts, F.lit(0)).alias("gene_id"),
        F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).alias("name"),
        F.get(parts, F.lit(2)).alias("feature_type"),
    )
    if only_expression:
        feats = feats.where(F.col("feature_type").isNull() | (F.col("feature_type") == "Gene Expression"))
    # one row per gene of one library and name
    nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("number"))
    return feats.withColumn("_n", nth).select(
        "file",
        "number",
        "gene_id",
        F.when(F.col("_n") > 1, F.concat_ws("-", "name", F.col("_n") - 1)).otherwise(F.col("name")).alias("gene"),
        "feature_type",
        (F.col("number") - 1).cast("int").alias("gene_pos"),
    )


def matrix_entries(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((file, row, col, count), (file, n_rows, n_cols)) of coordinate files.

    The size line is a file's first line that is not a comment. Entries have no
    order, so a plain text scan with as many tasks as splits is enough. It is the only one:
    the parsed numbers are written with their places, by which the size line is told from the entries.
    """
    lines = text_lines(spark, paths).where(~F.startswith("value", F.lit("%")) & (F.btrim("value") != ""))
    # single blanks need no pattern, which would be compiled for every line
    odd = F.lit(False)
    for gap in ("  ", "\t", "\x0b", "\f"):
        odd = odd | F.contains("value", F.lit(gap))
    parts = F.split(F.btrim(F.when(odd, F.regexp_replace("value", r"\s+", " ")).otherwise(F.col("value"))), " ")
    lines = materialize(lines.select(
        "file", "block", "at", parts[0].cast("long").alias("row"), parts[1].cast("long").alias("col"), parts[2].cast("double").alias("count")
    ))
    firsts = lines.groupBy("file", "block").agg(F.min("at").alias("at"))
    firsts = firsts.groupBy("file").agg(F.min_by("at", "block").alias("at"), F.min("block").alias("block"))
    sizes = lines.join(F.broadcast(firsts), ["file", "block", "at"])
    sizes = materialize(sizes.select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("at").alias("_at"),
        plain_path(F.col("file")).alias("file"), F.col("row").alias("n_rows"), F.col("col").alias("n_cols"),
    ))
    heads = sizes.select(F.col("_file"), "_block", "_at", F.col("file").alias("_path"))
    body = lines.join(heads, lines["file"] == heads["_file"]).where("block <> _block or at <> _at")
    return body.select(F.col("_path").alias("file"), "row", "col", "count"), sizes.select("file", "n_rows", "n_cols")


def read_libraries(
    spark: SparkSession, manifest: DataFrame, only_expression: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, cells, genes) of all libraries of a manifest, each row tagged by ``sample``.

    Manifest columns: ``sample``, ``matrix``, ``barcodes``, ``features``, one row
    per library. Matrices, barcodes and features are one scan each, and the
    number of jobs does not grow with the manifest. Each library's orientation
    comes from its dimensions; fails where they fit neither way.
    """
    rows = [tuple(r) for r in manifest.select("sample", "matrix", "barcodes", "features").collect()]
    named = spark.createDataFrame(rows, "sample string, matrix string, barcodes string, features string")
    named = named.select("sample", *[plain_path(F.col(c)).alias(c) for c in ("matrix", "barcodes", "features")])

    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.join(named.select("sample", F.col(kind).alias("file")), "file").drop("file")

    entries, sizes = matrix_entries(spark, sorted({r[1] for r in rows}))
    barcodes = tagged(numbered_lines(spark, sorted({r[2] for r in rows})), "barcodes")
    features = numbered_lines(spark, sorted({r[3] for r in rows}))
    n = lambda df, name: df.groupBy("sample").agg(F.count(F.lit(1)).alias(name))
    shape = tagged(sizes, "matrix").join(n(barcodes, "n_cells"), "sample", "left").join(n(tagged(features, "features"), "n_features"), "sample", "left")
    gene_rows = (F.col("n_rows") == F.col("n_features")) & (F.col("n_cols") == F.col("n_cells"))
    gene_cols = (F.col("n_rows") == F.col("n_cells")) & (F.col("n_cols") == F.col("n_features"))
    shape = materialize(shape.withColumn("axis", F.when(gene_rows, "row").when(gene_cols, "col")))
    bad = shape.where("axis is null").limit(5).collect()
    if bad:
        raise ValueError("matrices that fit neither way: " + "; ".join(
            f"{r['sample']} is {r['n_rows']} x {r['n_cols']} with {r['n_features']} features and {r['n_cells']} barcodes" for r in bad
        ))
    # names are numbered by library, whose name is shorter than its path
    genes = features_of(tagged(features, "features").withColumnRenamed("sample", "file"), only_expression).withColumnRenamed("file", "sample")
    cells = barcodes.select("sample", "number", F.get(F.split("line", "\t"), F.lit(0)).alias("barcode"))
    placed = tagged(entries, "matrix").where("count <> 0").join(shape.select("sample", "axis"), "sample")
    by_row = F.col("axis") == "row"
    placed = placed.select(
        "sample", "count", F.when(by_row, F.col("row")).otherwise(F.col("col")).alias("_g"),
        F.when(by_row, F.col("col")).otherwise(F.col("row")).alias("_c"),
    )
    counts = placed.join(genes.select("sample", F.col("number").alias("_g"), "gene"), ["_g", "sample"])
    counts = counts.join(cells.select("sample", F.col("number").alias("_c"), F.col("barcode").alias("cell_id")), ["_c", "sample"])
    return (
        counts.select("sample", "cell_id", "gene", "count"),
        cells.select("sample", F.col("barcode").alias("cell_id"), "barcode"),
        genes.drop("number"),
    )


def read_triplet(
    spark: SparkSession, matrix: str, barcodes: str, features: str, only_expression: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, cells, genes) of one library; orientation comes from the dimensions."""
    one = spark.createDataFrame([("", matrix, barcodes, features)], "sample string, matrix string, barcodes string, features string")
    counts, cells, genes = read_libraries(spark, one, only_expression)
    return counts.drop("sample"), cells.drop("sample"), genes.drop("sample")


def read_exported(spark: SparkSession, prefix: str, suffix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exported ``_counts.mtx``, ``_genes.tsv``, ``_barcodes.tsv`` set, and its cell metadata."""
    counts, cells, genes = read_triplet(
        spark, f"{prefix}_counts.mtx", f"{prefix}_barcodes.tsv{suffix}", f"{prefix}_genes.tsv{suffix}", False
    )
    meta = f"{prefix}_metadata.csv{suffix}"
    if exists(spark, meta):
        table = spark.read.option("header", True).csv(meta)
        first = table.columns[0]
        cells = cells.join(table.withColumnRenamed(first, "cell_id"), "cell_id", "left")
    return counts, cells, genes


def resolve_inputs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Existing path of every manifest row.

    The stated path where it exists; else a file of the same name: the only one,
    or the only one in a folder named *filtered*, or the first by path. Both
    tables have a ``path`` column; the result adds ``resolved``.
    """
    name = F.substring_index("path", "/", -1)
    parent = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    listed = files.select(F.col("path").alias("found"), name.alias("_name"), parent.alias("_parent")).distinct()
    ranked = listed.groupBy("_name").agg(
        F.min("found").alias("_first"),
        F.count_if(F.contains(F.lower("_parent"), F.lit("filtered"))).alias("_nf"),
        F.min(F.when(F.contains(F.lower("_parent"), F.lit("filtered")), F.col("found"))).alias("_filtered"),
    )
    exact = listed.select(F.col("found").alias("path"), F.lit(True).alias("_here"))
    out = manifest.join(exact, "path", "left").withColumn("_name", name).join(ranked, "_name", "left")
    fallback = F.when(F.col("_nf") == 1, F.col("_filtered")).otherwise(F.col("_first"))
    return out.withColumn("resolved", F.when(F.col("_here"), F.col("path")).otherwise(fallback)).drop(
        "_here", "_name", "_first", "_nf", "_filtered"
    )


def rebuild_inputs(
    spark: SparkSession, manifest: DataFrame, gse_id: str, failed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stacks every manifest library that did not fail: (counts, cells) tagged by sample.

    Manifest columns: ``sample``, ``matrix``, ``barcodes``, ``features``.
    """
    wanted = manifest if failed is None else manifest.join(failed.select("sample"), "sample", "left_anti")
    if wanted.isEmpty():
        raise ValueError("no input is left to rebuild from")
    counts, cells, _ = read_libraries(spark, wanted)
    tag = {"gse_id": F.lit(gse_id), "cell_id": F.concat_ws("-", "cell_id", "sample")}
    return counts.withColumns(tag), cells.withColumns(tag)


def keep_listed_cells(counts: DataFrame, metadata: DataFrame, cell: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Counts and first metadata row of the cells both tables know."""
    order = "row_ord" if "row_ord" in metadata.columns else cell
    first = keep_first(metadata.where(F.coalesce(F.col(quote(cell)), F.lit("")) != ""), [cell], [F.col(order)])
    return counts.join(first.select(cell), cell, "left_semi"), first


def read_delimited(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Contig or wide receptor tables as text; gzip is read as it is."""
    return spark.read.option("header", True).option("sep", sep).csv(paths if isinstance(paths, str) else list(paths))
