"""Sample headers of GEO series-matrix files: one row per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoquilt.functions.text import clean, clean_intake, slug, strip
from cytoquilt.sources.files import glob_paths, plain_path


def discover(spark: SparkSession, root: str, gse_ids: Sequence[str]) -> dict[str, list[str]]:
    """Series-matrix files of each dataset in the four usual layouts."""
    found = {}
    for gse in sorted({g.strip() for g in gse_ids if g and g.strip()}):
        base = f"{root}/{gse}"
        paths = glob_paths(
            spark,
            [
                f"{base}/*series_matrix.txt.gz",
                f"{base}/matrix/*series_matrix.txt.gz",
                f"{base}/metadata/*series_matrix.txt",
                f"{base}/metadata/*series_matrix.txt.gz",
            ],
        )
        if paths:
            found[gse] = paths
    return found


def sample_cells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line, key, sample, value): one row per header field and sample."""
    lines = spark.read.text(list(paths)).where(F.startswith("value", F.lit("!Sample_")))
    ordered = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i")).alias("line"),
        F.split("value", "\t").alias("parts"),
    )
    fields = ordered.select(
        "file",
        "line",
        F.expr("substr(parts[0], 9)").alias("key"),
        F.posexplode(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("sample", "raw"),
    )
    return fields.select("file", "line", "key", "sample", F.btrim(strip("raw"), F.lit(chr(34))).alias("value"))


def series_bundles(spark: SparkSession, paths_by_gse: dict[str, Sequence[str]]) -> DataFrame:
    """gse_id, gsm, title, bundle, pos: title, source and characteristics ``|``-joined.

    ``pos`` grows with the file order of a dataset and then with the sample, so
    that a later file replaces an earlier one downstream.
    """
    order = [(path, gse, i) for gse, paths in paths_by_gse.items() for i, path in enumerate(paths)]
    if not order:
        raise FileNotFoundError("no series-matrix file found")
    # all files are one scan; a file is found again by its path
    places = spark.createDataFrame(order, "path string, gse_id string, place int")
    places = places.select(plain_path(F.col("path")).alias("file"), "gse_id", "place")
    cells = sample_cells(spark, [path for path, _, _ in order]).withColumn("file", plain_path(F.col("file"))).join(places, "file")
    text = clean("value")
    last = lambda k: F.coalesce(F.max_by(F.when(F.col("key") == k, text), F.when(F.col("key") == k, F.col("line"))), F.lit(""))
    traits = F.array_sort(
        F.collect_list(F.when((F.col("key") == "characteristics_ch1") & (text != ""), F.struct("line", text.alias("t"))))
    )
    rows = cells.groupBy("gse_id", "place", "sample").agg(
        last("geo_accession").alias("gsm"),
        last("title").alias("title"),
        last("source_name_ch1").alias("_source"),
        traits.alias("_traits"),
    )
    parts = F.filter(F.concat(F.array("title", "_source"), F.col("_traits.t")), lambda t: t != "")
    return rows.select(
        "gse_id", "gsm", "title", F.concat_ws(" | ", parts).alias("bundle"), F.struct("place", "sample").alias("pos")
    )


def sample_table(spark: SparkSession, path: str, gse_id: str) -> DataFrame:
    """gse_id, sample, fields (map): every header field by lower-case key.

    A key that is repeated gets ``_1``, ``_2`` ... in file order. ``key: value``
    characteristics also appear under their own slugged key, where the first
    non-blank value wins and no other field is overwritten.
    """
    cells = sample_cells(spark, [path]).withColumn("key", F.lower("key"))
    lines = cells.select("key", "line").distinct()
    nth = F.row_number().over(Window.partitionBy("key").orderBy("line"))
    many = F.count(F.lit(1)).over(Window.partitionBy("key"))
    named = lines.select(
        "line", F.when(many > 1, F.concat_ws("_", "key", nth)).otherwise(F.col("key")).alias("field"), nth.alias("nth")
    )
    every = cells.join(named, "line")
    fields = every.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    trait = every.where(F.startswith("key", F.lit("characteristics_ch1")) & F.contains(clean_intake("value"), F.lit(":")))
    text = clean_intake("value")
    trait = trait.select(
        "sample",
        "line",
        slug(F.substring_index(text, ":", 1)).alias("trait"),
        strip(F.regexp_replace(text, "^[^:]*:", "")).alias("v"),
    ).where("trait <> ''")
    firsts = trait.groupBy("sample", "trait").agg(
        F.coalesce(F.min_by("v", F.when(clean_intake("v") != "", F.col("line"))), F.lit("")).alias("v")
    )
    traits = firsts.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("trait", "v"))).alias("traits"))
    empty = F.create_map().cast("map<string,string>")
    joined = fields.join(traits, "sample", "left").withColumn("traits", F.coalesce("traits", empty))
    fresh = F.map_filter(
        "traits", lambda k, v: F.coalesce(clean_intake(F.try_element_at(F.col("fields"), k)), F.lit("")) == ""
    )
    kept = F.map_filter("fields", lambda k, v: ~F.map_contains_key(fresh, k))
    return joined.select(F.lit(gse_id).alias("gse_id"), "sample", F.map_concat(kept, fresh).alias("fields"))

