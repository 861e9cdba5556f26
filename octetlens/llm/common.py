"""Shared pieces: tables, scratch storage, hashing of words, connected components.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``: executors and
driver all see it, a written table cuts the lineage, and a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import read_table, ship  # noqa: F401

_own_scratch: list[str] = []
_to_delete: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def scratch(spark: SparkSession) -> str:
    """The application's folder in the shared one; one of our own only where none is configured and all runs on one machine.

    It is deleted when the driver's JVM ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        folder = f"{named.rstrip('/')}/octetlens-{spark.sparkContext.applicationId}"
        if folder not in _to_delete:
            _to_delete.add(folder)
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="octetlens-"))
        atexit.register(shutil.rmtree, _own_scratch[0], True)
    return f"file://{_own_scratch[0]}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(c: str = "doc_id") -> Column:
    """crc32 of the identifier's decimal text; null for a null identifier."""
    return F.crc32(F.col(c).cast("string").cast("binary"))


# ------------------------------------------------------------------ words and hashes

#: Bytes of a text that separate words: space and \t \n \v \f \r.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_INSIDE = np.ones(256, bool)
_INSIDE[list(SPACES)] = False
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_ODD = int(_rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
_SEGMENT = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        more = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + more] = out[:more] * step
            step = step * step
        done += more
    return out


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, ``n`` at least."""
    if len(_tables.get("p", ())) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        _tables["p"], _tables["i"] = _powers(_ODD, size), _powers(pow(_ODD, -1, 2**64), size)
    return _tables["p"], _tables["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z lower-cased, in order.

    Words are runs of bytes other than SPACES. A text of any length is hashed in segments that end at white
    space, so memory follows the segment.
    """
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
    if len(raw) <= _SEGMENT:
        return _segment_hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = at + _SEGMENT
        while end < len(raw) and _INSIDE[raw[end]]:
            end += 1
        parts.append(_segment_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def _segment_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    power, inverse = powers(len(b) + 1)
    edge = np.flatnonzero(np.diff(_INSIDE[b], prepend=False, append=False))
    s, e = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
        return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; of the whole sequence if it is shorter, none if empty."""
    if not len(words):
        return words
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - k + 1] * np.uint64(_ODD)
        for j in range(1, k):
            out = mix(out) + words[j : len(words) - k + 1 + j] * np.uint64(2 * j + 1)
        return np.unique(mix(out + np.uint64(k)))


# ------------------------------------------------------------------ connected components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest identifier reachable from each linked identifier: rows (id, component).

    Alternates the large-star and small-star steps until every component is a star around its smallest member;
    the number of rounds grows with the logarithm of the longest chain. Each round is written to shared storage.
    Loops and nulls are ignored. Hubs are joined, not grouped, so adaptive execution can split them.
    """
    e = store(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    while not _is_stars(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = store(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = store(small.union(low.select("u", "m")).distinct(), "small")
    roots = e.select("v").distinct().select("v", "v")
    return e.union(roots).toDF("id", "component")


def _is_stars(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return per.where("leaf > 1 or (leaf = 1 and root = 1)").isEmpty()
