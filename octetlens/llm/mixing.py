"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, an exact cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import store


def word_count(text: Column) -> Column:
    """Number of words, runs of characters other than space and \\t \\n \\v \\f \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of rows (source, source_size): each source's weight and target.

    Sources in order of code points, null last, weigh ``weights`` in turn. Together they get ``share`` times all sizes; a
    target stops at ``most`` times its source, and what it can't use is dealt again by weight. That is the level at which
    min(cap, level * weight) adds up; with sources sorted by cap / weight it follows from running sums. There is a row for
    each source here, never for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select("source", "source_size", F.element_at(turn, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    sums = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("at"),
        (F.sum("source_size").over(everything) * share).alias("whole"),
        F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    level = (F.col("whole") - most * F.col("below")) / F.col("rest")
    # The first source whose cap isn't reached fixes the level.
    fits = F.when(level * F.col("weight") <= most * F.col("source_size"), F.struct("at", level.alias("level")))
    chosen = sums.select("*", F.min(fits).over(everything)["level"].alias("level"))
    cap = most * F.col("source_size")
    return chosen.select("source", "source_size", "weight", F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """For every document: (id, source, size, source_size, target, taken).

    ``taken`` is how many of its words the mix takes, repeats counted. Whole epochs of a source take every document; what
    is left of the target, rounded down to words, is cut from the source's documents in the order of a keyed digest of
    the identifier, so reruns agree. Documents without words take none; ties of the digest go by identifier, then size,
    and repeated rows are documents of their own. A null source is a source.
    """
    placed = _placed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), weights, share, most, seed)
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).cast("long").alias("taken"))


def _placed(sized: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """Rows (id, source, size, and others as they are) with source_size, target, epochs, place behind the others, and the words of the cut."""
    keyed = sized.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")))
    # Hot sources spread over as many partitions as their rows ask for: the range is over (source, key).
    order = ["source", "key", "id", "size"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("source", "size", F.spark_partition_id().alias("part"), *[c for c in sized.columns if c not in ("source", "size")])
    # Only source and size go to Python; whole rows stay in the JVM.
    running = F.arrow_udf(_running, LongType()).asNondeterministic()
    local = store(ranged.select("*", running("source", "size").alias("before")), "mixed")
    parts = local.groupBy("source", "part").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("part")
    offsets = parts.select("source", "part", (F.sum("n").over(over) - F.col("n")).alias("start"))
    targets = source_targets(local.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = store(offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "t.source_size", "t.target"), "offsets")
    at = local.alias("d").join(plan.alias("p"), (F.col("d.part") == F.col("p.part")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    left = words - epochs * F.col("source_size") - (F.col("start") + F.col("before"))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return at.select(*[F.col(f"d.{c}").alias(c) for c in sized.columns], "source_size", "target", epochs.alias("epochs"), left.alias("left"), cut.alias("cut"))


def _running(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For sorted rows (source, size): the sizes before each in the same partition and source."""
    last, total = object(), 0
    for source, size in batches:
        n, size = len(source), size.to_numpy(zero_copy_only=False)
        out = np.empty(n, np.int64)
        if not n:
            continue
        codes = source.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
        for s, e in zip(starts, [*starts[1:], n]):
            name = source[int(s)].as_py()
            if name != last:
                last, total = name, 0
            sums = np.cumsum(size[s:e])
            out[s:e] = total + sums - size[s:e]
            total += int(sums[-1])
        yield pa.array(out)


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself, of whole documents with all their columns, each as often as its source's target asks for.

    The document at the cut is in if half of it or more lies before the cut, so that a source misses its target by half a
    document at most; one without words is in if it lies before the cut. Rows that repeat others, or have no identifier, are
    documents of their own.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = _placed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row), weights, share, most, seed)
    begun = (F.col("left") > 0) & (2 * F.col("cut") >= F.col("size"))
    times = (F.col("epochs") + F.when(begun, 1).otherwise(0)).cast("int")
    return placed.select("row", F.explode(F.array_repeat(F.lit(True), times)).alias("copy")).select("row.*")
