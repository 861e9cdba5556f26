"""Counts of bytes, pairs of bytes and characters over a table: added up within a batch before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import GRAMMAR
from ..operators.probers import legal_tokens
from ..shipping import ship


def _partial(width: int):
    def run(batches):
        for batch in batches:
            groups = batch.column(1) if batch.num_columns > 1 else pa.array([None] * batch.num_rows, pa.string())
            totals: dict = {}
            for content, group in zip(batch.column(0), groups.to_pylist(), strict=True):
                b = np.frombuffer(content.as_py() or b"", np.uint8).astype(np.int64)
                units = b if width == 1 else b[:-1] * 256 + b[1:]
                if group not in totals:
                    totals[group] = np.zeros(256**width, np.int64)
                totals[group] += np.bincount(units, minlength=256**width)
            for group, counts in totals.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(at), pa.string()), pa.array([f"{x:0{2 * width}X}" for x in at.tolist()], pa.string()), pa.array(counts[at])], names=["grp", "unit", "cnt"])

    return run


def count_bytes(df: DataFrame, width: int, group: str | None = None, content: str = "content") -> DataFrame:
    """(group, unit, cnt) of bytes, or of pairs of neighbours for ``width`` 2, as hexadecimal digits. Null counts nothing."""
    ship(df.sparkSession)
    picked = df.select(content, *([F.col(group).cast("string")] if group else []))
    counted = picked.mapInArrow(_partial(width), "grp string, unit string, cnt long").groupBy("grp", "unit").agg(F.sum("cnt").alias("cnt"))
    return counted.withColumnRenamed("grp", group) if group else counted.drop("grp")


def _tokens(batches):
    for batch in batches:
        contents = [x.as_py() for x in batch.column(0)]
        for charset in GRAMMAR:
            if charset == "utf-8":
                continue
            pairs = np.frombuffer(b"".join(t for x in contents if x for t in legal_tokens(charset, x)[1]), np.uint8).reshape(-1, 2).astype(np.int64)
            counts = np.bincount(pairs[:, 0] * 256 + pairs[:, 1], minlength=1)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([charset] * len(at), pa.string()), pa.array([f"{x:04X}" for x in at.tolist()], pa.string()), pa.array(counts[at])], names=["charset", "pair", "cnt"])


def count_tokens(df: DataFrame, content: str = "content") -> DataFrame:
    """(charset, token, cnt) of two-byte characters in the legal beginnings, by charset; a token is written as text in UTF-8 digits."""
    ship(df.sparkSession)
    counted = df.select(content).mapInArrow(_tokens, "charset string, pair string, cnt long").groupBy("charset", "pair").agg(F.sum("cnt").alias("cnt"))
    return counted.select("charset", F.hex(F.decode(F.unhex("pair"), "ISO-8859-1").cast("binary")).alias("token"), "cnt")
