"""Declared schemas of the tables the operators pass around."""

from __future__ import annotations

from pyspark.sql import types as T

REGISTRY = T.StructType(
    [
        T.StructField("h5ad_path", T.StringType()),
        T.StructField("gse_id", T.StringType()),
        T.StructField("source_root", T.StringType()),
    ]
)
COUNTS = T.StructType(
    [
        T.StructField("gse_id", T.StringType()),
        T.StructField("cell_id", T.StringType()),
        T.StructField("gene", T.StringType()),
        T.StructField("count", T.DoubleType()),
    ]
)
VAR = T.StructType(
    [
        T.StructField("gse_id", T.StringType()),
        T.StructField("gene_pos", T.IntegerType()),
        T.StructField("gene", T.StringType()),
        T.StructField("gene_id", T.StringType()),
        T.StructField("feature_type", T.StringType()),
    ]
)
EMBEDDINGS = T.StructType(
    [T.StructField("cell_id", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))]
)
SERIES = T.StructType(
    [
        T.StructField("gse_id", T.StringType()),
        T.StructField("gsm", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("bundle", T.StringType()),
        T.StructField("pos", T.LongType()),
    ]
)
