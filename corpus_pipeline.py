"""A training corpus from ``documents`` in five stages, each writing what the next one reads.

Toxic documents go; boilerplate lines of each source go; one document of each
near-duplicate class stays; personal data and the terms that give it away are
taken out; what is left is packed into sequences of 1024 tokens.

Every stage takes null, empty and very long texts, null and repeated ids, null
sources, further columns of any name and an empty table. A null text stays null
up to the last stage, where it is its end token alone; repeated rows fare alike,
but for the near-duplicates, of which one row stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cytoquilt.llm import line_dedup, near_dedup, packing, pii, toxicity
from cytoquilt.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below 0.7, null and empty ones as texts without words.

    Labels are learned from the given documents, not from what is left of them.
    """
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, "text", model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that too many documents of their source have; blank lines stay, and a null source is the empty one."""
    return line_dedup.drop_boilerplate(docs, "doc_id", "source", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class; documents without words are no duplicates of each other."""
    return near_dedup.keep_one(docs, "doc_id", "text")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms taken out; null and empty texts stay as they are."""
    return pii.sanitise(docs, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their tokens, in sequences of 1024 tokens; a null or empty text is one piece of its end token."""
    return packing.pack(docs, "doc_id", "text", keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", sanitise),
    ("best-fit packing", pack),
]
#: SQL has no BPE and no signatures; each stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
