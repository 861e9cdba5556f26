"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its rows are reduced to (digest, smallest identifier, rows). In binomial rounds
``fan_in`` runs at a time are merged, keeping the smallest identifier of each digest, until one logical run is left.
The runs of a round are dealt by (run, digest), so that no task holds a run, and a digest never has more than
``fan_in`` rows in a group, however many copies the corpus holds. The answer then travels down the same tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Text forms that count as one white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A digest and what verifies it: two texts merge only if all of these agree.
KEY = ["digest", "chars", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """For every row: (id, keep_id, group_size, kept, text_sha256).

    Equal texts agree after each run of white space becomes one space; a null text counts as empty. ``keep_id`` is the
    smallest identifier of the group. Rows that repeat both identifier and text all carry ``kept``; rows without an
    identifier join their group's count and are kept only if nobody in the group has one. An empty table gives no rows.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"), F.spark_partition_id().alias("run"))
    rows = store(
        text.select("id", "run", F.unhex(F.sha2("t", 256)).alias("digest"), F.length("t").alias("chars"), F.xxhash64("t").alias("check")),
        "digests",
    )
    runs = rows.agg(F.max("run")).first()[0]
    if runs is None:
        runs = 0
    # Level 0: one sorted run for each partition; the partial aggregate keeps a row for a digest.
    level = store(_merge(rows.select("run", *KEY, F.col("id").alias("low"), F.lit(1).cast("long").alias("n"))), "run0")
    levels = [level]
    runs += 1
    while runs > 1:
        runs = -(-runs // fan_in)
        level = store(_merge(level.withColumn("run", (F.col("run") / fan_in).cast("int"))), f"run{len(levels)}")
        levels.append(level)
    # Down the tree: each merged run tells the runs it came from.
    told = levels[-1]
    for below in reversed(levels[:-1]):
        up = told.select(F.col("run").alias("up"), *KEY, F.col("low").alias("_low"), F.col("n").alias("_n"))
        told = below.withColumn("up", (F.col("run") / fan_in).cast("int")).join(up, ["up", *KEY]).select("run", *KEY, F.col("_low").alias("low"), F.col("_n").alias("n"))
    return rows.join(told, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        F.col("low").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("low")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _merge(runs: DataFrame) -> DataFrame:
    """Merges runs of the same number: rows of a digest meet as neighbours in sorted order, and the smallest identifier stays.

    The smallest identifier is that of a struct, which no hash table of the engine can hold: so the plan sorts and merges
    (Sort, SortAggregate) on either side of the exchange, spills as runs do, and its rows come out sorted.
    """
    low = F.min(F.when(F.col("low").isNotNull(), F.struct("low")))["low"]
    return runs.groupBy("run", *KEY).agg(low.alias("low"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in identifier and text one stays."""
    kept = store(exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).distinct(), "kept")
    # All columns travel as one, so that no name of theirs can clash.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    named = marked.where("id is not null").join(kept.where("id is not null"), ["id", "sha"], "left_semi")
    nameless = marked.where("id is null").join(kept.where("id is null").select("sha"), "sha", "left_semi")
    return named.dropDuplicates(["id", "sha"]).unionByName(nameless.dropDuplicates(["sha"])).select("row.*")
