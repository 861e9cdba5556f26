"""A training-data pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetlens.llm.common import crc_of_id, ship, store, table
from octetlens.llm.exact_dedup import exact_dedup
from octetlens.llm.mixing import mixed_documents
from octetlens.llm.near_dedup import near_dedup
from octetlens.llm.pieces import encode_pieces
from octetlens.llm.queries import tokenizer_file, toxic_labels
from octetlens.llm.toxicity import toxicity_scorer, train_toxicity

#: A document is rejected from this score on.
THRESHOLD = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, learnt from the labelled ones, calls toxic."""
    ship(spark)
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))
    model = train_toxicity(docs.select("doc_id", "text").where(~held_out).join(toxic_labels(spark, sf_dir), "doc_id"))
    return docs.where(toxicity_scorer(spark, model)(F.col("text")) < THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    ship(spark)
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    ship(spark)
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents until each source has its target share of words, but for half a document."""
    ship(spark)
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the text they decode to."""
    ship(spark)
    return encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("minhash_near_dedup", near), ("source_mixing", mixing), ("sentencepiece", pieces)]

#: A trained classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
