"""From raw documents to token ids: five stages, each one of the operators of factloom.llm.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``; the last gives each remaining document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, minhash_dedup, mixing, queries, sentencepiece_codec, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, labels)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with Jaccard 0.8 or more on five-word shingles stays."""
    return minhash_dedup.drop_near_copies(docs, threshold="0.8")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of all tokens, by the target weights of domains, languages and sources.

    A document is chosen once at most (one epoch); what a leaf lacks goes to its kin.
    Rows without identifier take part like others.
    """
    rows = queries.stored(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    chosen = mixing.mix_sources(rows, queries.mix_weights(rows), queries.mix_domain(), budget_share=(3, 4), max_epochs=1, seed=1, row_col="_row")
    return mixing.mixed_documents(rows, chosen, row_col="_row")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives the text back."""
    return sentencepiece_codec.encode_documents(docs, queries.tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Learned scores and near-duplicate search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = queries.stored(docs, f"pipeline-{name}")
    return docs
