"""The queries of this subpackage; ``oracle.py`` has them in SQL where that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .embedding_dedup import embedding_links
from .exact_dedup import exact_groups
from .langid import identify_languages, train_language_model
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .ngram_lm import score_corpus
from .oracle import ORACLE_SQL  # noqa: F401
from .pieces import encode_pieces
from .secrets import secret_spans
from .token_planes import read_tokens, write_tokens
from .toxicity import score_toxicity, train_toxicity


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))
    model = train_language_model(docs, ~held_out)
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, tokenizer_file("word_bpe_49k.json"), end_id=1))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, weights=(5, 2, 1), share=1.5, most=2.0).drop("source")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"), least=0.98)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, toxic): of a document that is labelled several times, whether any label says so."""
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))
    model = train_toxicity(docs.where(~held_out).join(toxic_labels(spark, sf_dir), "doc_id"))
    return score_toxicity(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_corpus(docs, F.pmod(crc_of_id(), F.lit(7)) == 2)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), keep=False)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_token_planes, op3_minhash_near_dedup, op4_mix_sources, op5_embedding_near_dedup, op6_toxicity, op7_exact_dedup, op8_language_model, op9_pieces, op10_secret_scan)
}
