"""Trains single-byte models from texts as a Spark job, and turns tables of the same shape into models.

Units (a letter and its follower) are counted where the texts lie; only counts of pairs of a language's own letters, at most
the square of its alphabet, reach the driver.
"""

from __future__ import annotations

import codecs
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGES, catalogue
from .models import FREQUENT, LETTERS, SingleByteModel, ranked_model

#: At each letter: it and the letter behind it, or it alone at a word's end.
UNIT = r"(?=([\p{L}\p{M}ʼ][\p{L}\p{M}ʼ]?+))"
BIGRAM_SCHEMA = "language string, charset string, b1 int, b2 int, category int"
UNIGRAM_SCHEMA = "language string, charset string, byte int, char string, is_char boolean, is_freq boolean"


def letters_of(spark: SparkSession) -> DataFrame:
    """(iso_code, letter): lower-case letters of the catalogue, about 1,200 rows."""
    letters = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("alphabet"), F.lit("(?s)(.)"))))
    return catalogue(spark).select("iso_code", letters.alias("letter"))


def count_units(texts: DataFrame, code: str = "lang", text: str = "text") -> DataFrame:
    """(iso_code, unit, cnt) of lower-cased texts by the code of their language; other languages and letters are left out.

    Null texts and codes count nothing. The follower of a letter outside the alphabet is dropped, so that the letter itself counts.
    """
    units = texts.select(F.col(code).alias("iso_code"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(UNIT), F.lit(1))).alias("unit"))
    counted = units.groupBy("iso_code", "unit").agg(F.count("*").alias("cnt"))
    letters = F.broadcast(letters_of(texts.sparkSession))  # fixed by the catalogue
    known = counted.join(letters.withColumnRenamed("letter", "_a"), ["iso_code"]).where(F.substring("unit", 1, 1) == F.col("_a"))
    follower = letters.select("iso_code", F.col("letter").alias("_b"))
    both = known.withColumn("_f", F.substring("unit", 2, 1)).join(follower.withColumnRenamed("iso_code", "_i"), (F.col("iso_code") == F.col("_i")) & (F.col("_f") == F.col("_b")), "left")
    return both.groupBy("iso_code", F.concat("_a", F.coalesce("_b", F.lit(""))).alias("unit")).agg(F.sum("cnt").alias("cnt"))


def rank_pairs(units: DataFrame) -> DataFrame:
    """(iso_code, pair, cnt, place, category): pairs by count; 3 the most frequent, 2 the next as many, 1 the rest."""
    place = F.row_number().over(Window.partitionBy("iso_code").orderBy(F.desc("cnt"), "unit"))
    ranked = units.where(F.length("unit") == 2).withColumn("place", place)
    category = F.when(F.col("place") <= FREQUENT, 3).when(F.col("place") <= 2 * FREQUENT, 2).otherwise(1)
    return ranked.select("iso_code", F.col("unit").alias("pair"), "cnt", "place", category.alias("category"))


def train_models(texts: DataFrame, code: str = "lang", text: str = "text") -> list[SingleByteModel]:
    """A model for each charset of each language of the catalogue that the texts hold."""
    counts: dict[str, Counter] = {}
    for r in count_units(texts, code, text).collect():
        counts.setdefault(r["iso_code"], Counter())[r["unit"]] = r["cnt"]
    models = []
    for name, iso, use_ascii, charsets, letters, _ in LANGUAGES:
        if iso not in counts:
            continue
        first, pairs = Counter(), Counter()
        for unit, n in counts[iso].items():
            first[unit[0]] += n
            if len(unit) == 2:
                pairs[unit] += n
        keep = use_ascii or any(c.isascii() for c in letters)
        models += [ranked_model(charset, codecs.lookup(charset).name, name, keep, first, pairs) for charset in charsets]
    return models


def model_tables(spark: SparkSession, models: list[SingleByteModel]) -> tuple[DataFrame, DataFrame]:
    """(bytes, pairs of bytes) of models as tables; pairs of category 0 have no rows."""
    singles, pairs = [], []
    for m in models:
        for b in range(256):
            char = bytes([b]).decode(codecs.lookup(m.charset).name, "ignore")
            singles.append((m.language, m.charset, b, char or None, bool(m.is_char[b]), bool(m.is_freq[b])))
        pairs += [(m.language, m.charset, int(a), int(b), int(m.category[a, b])) for a, b in zip(*m.category.nonzero())]
    return spark.createDataFrame(singles, UNIGRAM_SCHEMA), spark.createDataFrame(pairs, BIGRAM_SCHEMA)


def char_ranks(orders: DataFrame) -> DataFrame:
    """(char, rank) from the byte maps (charset, byte, order) of one language's charsets.

    Orders beyond LETTERS and undefined bytes are left out. ValueError if a character's order depends on the charset.
    """
    charsets = [r[0] for r in orders.select("charset").distinct().collect()]
    decoded = [(c, b, bytes([b]).decode(codecs.lookup(c).name, "ignore")) for c in charsets for b in range(256)]
    table = orders.sparkSession.createDataFrame(decoded, "charset string, byte int, char string").where("char != ''")
    ranks = orders.where(F.col("order") <= LETTERS).join(table, ["charset", "byte"]).groupBy("char").agg(F.min("order").alias("rank"), F.max("order").alias("_most"))
    unstable = ranks.where("rank != _most").orderBy("char").limit(5).collect()
    if unstable:
        raise ValueError("unstable ranks of " + ", ".join(r["char"] for r in unstable))
    return ranks.select("char", "rank")


def convert_matrix(orders: DataFrame, matrix: DataFrame) -> DataFrame:
    """(first, second, category) from byte maps and the matrix (i, j, category) of orders; row and column 0 don't count."""
    ranks = char_ranks(orders)
    inner = matrix.where(F.col("i").between(1, LETTERS - 1) & F.col("j").between(1, LETTERS - 1))
    rows = inner.join(ranks.select(F.col("char").alias("first"), F.col("rank").alias("i")), "i")
    return rows.join(ranks.select(F.col("char").alias("second"), F.col("rank").alias("j")), "j").select("first", "second", "category")
