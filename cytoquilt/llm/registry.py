"""Queries of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquilt.llm import ann, bpe, centroids, exact_dedup, line_dedup, media, merkle, near_dedup, packing, pii, secrets, toxicity, wavelet
from cytoquilt.llm.common import read_table
from cytoquilt.llm.spans import written
from cytoquilt.session import ensure_checkpoint_dir


def digest(spans: Column, base: tuple[str, ...]) -> list[Column]:
    """Counts of the base kinds, hash of the base spans, and all spans, as text."""
    own = F.filter(spans, lambda s: s["kind"].isin(*base))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.size(spans).cast("long").alias("n_spans")
    return [*map(count, base), F.sha2(written(own), 256).alias("base_sha256"), written(spans).alias("spans"), every]


def op1_sharded_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return ann.nearest(vectors, "vec_id", "embedding", vectors.where(F.col("vec_id") % 100 == 0))


def op2_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(read_table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text", name="found")
    return found.select("doc_id", *digest(F.col("found"), secrets.BASE))


def op5_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text", spans="found")
    return found.select("doc_id", *digest(F.col("found"), pii.BASE))


def op3_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.packed(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op6_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def op7_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wavelet/{uuid.uuid4().hex}"
    wavelet.write_shards(read_table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    return wavelet.read_shards(spark, folder, "doc_id", ask=1).drop("part", "shard", "place")


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, "doc_id", "text", model)


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/media/{uuid.uuid4().hex}"
    stored = media.store_media(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    stored.write.parquet(folder)
    return media.read_media(spark.read.schema(stored.schema).parquet(folder), "doc_id").drop("feature_bits")


def op11_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def op12_walsh_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding")


def op13_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", list(merkle.DOCUMENT_FIELDS))
    return merkle.manifest(docs, "doc_id", "source", merkle.DOCUMENT_FIELDS, merkle.without_newlines())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharded_small_world, op2_site_line_dedup, op3_forced_boundary_bpe, op4_trigram_secrets, op5_disclosure_pii, op6_bagminhash_near_dedup, op7_minimum_slack_packing, op8_wavelet_tokens, op9_lexicon_toxicity, op10_png_media, op11_cuckoo_exact_dedup, op12_walsh_hadamard_clusters, op13_slot_pivot_manifest)
}
ORACLE: dict[str, str] = {
    "op2_site_line_dedup": line_dedup.oracle(),
    "op11_cuckoo_exact_dedup": exact_dedup.oracle(),
    "op12_walsh_hadamard_clusters": centroids.oracle(),
    "op13_slot_pivot_manifest": merkle.oracle(),
}
