"""Linear latent space and clusters, with the numeric work done by Spark ML.

These stand where a GPU model and a graph method would be; their numbers differ
from those by design.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquilt.operators.joining import sized_join
from cytoquilt.session import materialize


def gene_vectors(values: DataFrame, genes: list[str], cell: str = "cell_id") -> DataFrame:
    """Dense feature array per cell over the chosen genes; a cell has at most that many rows."""
    index = {g: i for i, g in enumerate(genes)}
    spark = values.sparkSession
    lookup = spark.createDataFrame([(g, i) for g, i in index.items()], "gene string, _i int")
    rows = values.join(F.broadcast(lookup), "gene").groupBy(cell).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", "value"))).alias("_m")
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(len(genes) - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)),
    )
    return rows.select(cell, filled.alias("features"))


def batch_centered(df: DataFrame, vector: str, batch: str) -> DataFrame:
    """Vectors less the mean vector of their batch."""
    vec = df.withColumn("_v", array_to_vector(F.col(vector)))
    means = vec.groupBy(batch).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(batch, vector_to_array("_m").alias("_m"))
    joined = sized_join(vec.drop("_v"), means, [batch], "left", computed=True)
    return joined.withColumn(
        vector, F.zip_with(F.col(vector), F.col("_m"), lambda a, b: a.cast("double") - b)
    ).drop("_m")


def latent_space(df: DataFrame, vector: str, k: int, batch: str | None = None, out: str = "latent") -> DataFrame:
    """Principal components of (batch-centred) vectors.

    Spark ML builds the covariance with a tree aggregate; only a features by
    features matrix reaches the driver, so the feature count is checked.
    """
    work = batch_centered(df, vector, batch) if batch else df
    dims = work.select(F.size(vector)).first()[0]
    if dims > 8192:
        raise ValueError("select variable genes first: at most 8,192 features")
    work = work.withColumn("_x", array_to_vector(F.col(vector)))
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(work)
    return model.transform(work).withColumn(out, vector_to_array("_y")).drop("_x", "_y")


def embedding_clusters(df: DataFrame, vector: str, k: int, seed: int = 1, out: str = "leiden") -> DataFrame:
    """k-means clusters of the latent vectors."""
    work = materialize(df.withColumn("_x", array_to_vector(F.col(vector))))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="_c").fit(work)
    return model.transform(work).withColumn(out, F.col("_c").cast("string")).drop("_x", "_c")
