"""Near-duplicates of embeddings by spherical-cap filters of a structured random product code.

Vectors are first turned by a fixed random rotation, so that their energy spreads over all dimensions, wherever it was. The
dimensions are then split in blocks; a filter is a choice of one random direction for each block. A vector falls into all
filters whose direction it exceeds a threshold with; these are list-decoded block by block from sorted inner products,
without looking at every filter. Vectors that share a filter are verified by cosine in double precision.

The number of filters follows the number of vectors, so that a filter holds about FILL of them at any size; what piles up
beyond CELL (a group of near copies) is cut into cells of two blocks. Only identifiers meet by filter; each vector then goes
once to each of its cells. A cell answers with a degree and one edge of a spanning forest for each of its vectors, not with pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, store

#: Vectors in a block of a cell.
CELL = 1000
#: Vectors of a label that a filter holds on average, about.
FILL = 500
#: Filters that a vector falls into at least.
NEEDED = 24
#: Most cosine to a filter's direction that a vector has to exceed: a narrower cap would part near vectors of few dimensions.
NARROWEST = 0.75


def code_size(vectors: int, blocks: int = 2) -> int:
    """Directions of a block, so that filters of that many vectors hold FILL on average."""
    return max(16, math.ceil((NEEDED * vectors / FILL) ** (1 / blocks)))


def largest_code(dims: int, blocks: int = 2) -> int:
    """Directions of a block, so that caps aren't narrower than NARROWEST; with few dimensions filters hold more vectors instead."""
    share = 1 - NormalDist().cdf(NARROWEST * math.sqrt(dims))
    return max(16, math.floor((NEEDED / max(share, 1e-12)) ** (1 / blocks)))


class ProductCode:
    """Random directions for each block of dimensions; filters are their combinations.

    The threshold is that which a random vector exceeds with about NEEDED of all filters. A vector that exceeds fewer falls
    into its best NEEDED, so that none is left with few chances to be met. A block of one dimension has two directions.
    """

    def __init__(self, dims: int, blocks: int = 2, size: int = 128, needed: int = NEEDED, seed: int = 5):
        self.cuts = np.linspace(0, dims, blocks + 1).astype(int)
        rng = np.random.Generator(np.random.PCG64(seed))
        widths = np.diff(self.cuts)
        self.code = [(self._unit(rng.standard_normal((size, w))) if w > 1 else np.array([[1.0], [-1.0]])[:, :w][: 1 + w]) / np.sqrt(blocks) for w in widths]
        self.turn = self._rotation(dims, rng)
        self.sizes = [len(c) for c in self.code]
        every = math.prod(self.sizes)
        self.needed = min(needed, every)
        self.least = NormalDist().inv_cdf(1 - min(0.5, needed / every)) / np.sqrt(dims)
        self.step = 0.25 / np.sqrt(dims)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    @staticmethod
    def _rotation(dims: int, rng: np.random.Generator) -> np.ndarray:
        """A random orthogonal matrix; with the signs of R's diagonal none is preferred."""
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        return q * np.where(np.diag(r) < 0, -1.0, 1.0)

    def filters(self, vector: np.ndarray) -> np.ndarray:
        """All filters of a vector: those of its direction after the rotation."""
        unit = vector / np.abs(vector).max()
        turned = self.turn @ (unit / np.linalg.norm(unit))
        return self.decode(turned / np.linalg.norm(turned))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """All filters of one unit vector, ascending."""
        inner = [c @ unit[a:b] for c, a, b in zip(self.code, self.cuts, self.cuts[1:])]
        least = self.least
        number, height = self._above(inner, least)
        while len(number) < self.needed:
            least -= self.step
            number, height = self._above(inner, least)
        if least < self.least:
            number = number[height >= np.partition(height, -self.needed)[-self.needed]]
        return np.sort(number)

    def _above(self, inner: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Filters of that height: partial choices survive while the best of the blocks to come can still lift them."""
        best = np.append(np.cumsum([r.max() for r in inner][::-1])[::-1], 0.0)
        number, height = np.zeros(1, np.int64), np.zeros(1)
        for k, r in enumerate(inner):
            order = np.argsort(-r)
            take = np.searchsorted(-r[order], -(least - best[k + 1] - height), side="right")
            which = np.repeat(np.arange(len(number)), take)
            code = order[np.arange(len(which)) - np.repeat(np.cumsum(take) - take, take)]
            number, height = number[which] * self.sizes[k] + code, height[which] + r[code]
        return number, height


@lru_cache(8)
def _made(dims: int, blocks: int, size: int) -> ProductCode:
    """Once a process: the rotation of many dimensions takes a while to make."""
    return ProductCode(dims, blocks, min(size, largest_code(dims, blocks)))


def _pack(x: np.ndarray) -> bytes:
    """A vector as 32-bit floats where these hold it exactly, else as 64-bit ones; the first byte tells."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return b"\x04" + short.tobytes() if (short == x).all() else b"\x08" + x.astype("<f8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<f{data[0]}", offset=1).astype(float)


def _filters(blocks: int, size: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(lists.offsets.to_numpy()))
            vectors = np.split(flat, ends[:-1]) if len(ends) else []
            found = pa.array([_made(len(x), blocks, size).filters(x) for x in vectors], pa.list_(pa.int64()))
            columns = [batch.column(c) for c in ("uid", "rep", "label", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(_pack, vectors), pa.binary()), found], names=["uid", "rep", "label", "copies", "vector", "filters"])

    return run


def share_earlier(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two tables of non-negative numbers, padded with others, whether they have a number in common."""
    out = np.zeros(len(a), bool)
    step = max(1, 4_000_000 // max(1, a.shape[1] * b.shape[1]))
    for s in range(0, len(a), step):
        x = a[s : s + step, :, None]
        out[s : s + step] = ((x == b[s : s + step, None, :]) & (x >= 0)).any(axis=(1, 2))
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component in a symmetric table of links."""
    n = len(linked)
    low = np.arange(n)
    while True:
        met = np.minimum(low, np.where(linked, low, n).min(axis=1))
        # A component's member may have met a smaller one for all.
        new = low.copy()
        np.minimum.at(new, low, met)
        new = np.minimum(new, met)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _verify(least: float):
    """Of a cell, for each vector with a link here: (uid, degree, rep, root).

    ``degree`` adds up the copies of its partners, each pair only in the first filter that both share; ``root`` is the rep of
    a vector that links lead to.
    """

    def run(group: pa.Table) -> pa.Table:
        here = group.column("filter")[0].as_py()
        two = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        uid, rep, copies, block = (group.column(c).to_numpy() for c in ("uid", "rep", "copies", "block"))
        data, lists, by_length, out = group.column("vector").to_pylist(), group.column("filters"), {}, []
        vectors = [unpack(x) for x in data]
        for i, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(i)
        for at in map(np.array, by_length.values()):
            x = np.stack([vectors[i] for i in at])
            x /= np.abs(x).max(axis=1, keepdims=True)
            norm = np.linalg.norm(x, axis=1)
            linked = np.zeros((len(at), len(at)), bool)
            for s in range(0, len(at), 256):
                linked[s : s + 256] = (x[s : s + 256] @ x.T) / np.outer(norm[s : s + 256], norm) >= least
            linked |= linked.T
            np.fill_diagonal(linked, False)
            if two:
                linked &= block[at][:, None] != block[at][None, :]
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            at, linked = at[some], linked[np.ix_(some, some)]
            earlier = [np.array(lists[int(i)].as_py()) for i in at]
            earlier = [f[f < here] for f in earlier]
            table = np.full((len(at), max(map(len, earlier))), -1, np.int64)
            for i, f in enumerate(earlier):
                table[i, : len(f)] = f
            low = roots(linked)
            i, j = np.nonzero(np.triu(linked))
            new = ~share_earlier(table[i], table[j])
            degree = np.bincount(i[new], copies[at[j[new]]], len(at)) + np.bincount(j[new], copies[at[i[new]]], len(at))
            out.append((uid[at], degree.astype(np.int64), rep[at], rep[at[low]]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["uid", "degree", "rep", "root"])

    return run


def embedding_links(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: int = 2) -> DataFrame:
    """For every vector: (id, n_links, component_id, kept).

    Vectors of equal, non-null label and equal length are linked if their cosine is ``least`` or more. Null, empty and zero
    vectors, those with null or non-finite components, and those without label or identifier, link with nothing; each is a
    component of its own. Equal vectors collapse to one before filters are joined and count as links of each other.
    Rows that repeat an identifier are vectors of their own, but one node of a component.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(finite & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # The number of a vector is fixed by writing it.
    distinct = store(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    coded = store(distinct.mapInArrow(_filters(blocks, code_size(largest, blocks)), "uid long, rep long, label string, copies long, vector binary, filters array<long>"), "filters")
    hits = coded.select("uid", "label", F.explode("filters").alias("filter"))
    full = store(hits.groupBy("label", "filter").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / CELL)).drop("count"), "full")
    block = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    cells = hits.join(full, ["label", "filter"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("uid", "label", "filter", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    filled = cells.join(coded.drop("label"), "uid")
    met = store(filled.groupBy("label", "filter", "low", "high").applyInArrow(_verify(least), "uid long, degree long, rep long, root long"), "vector_links")
    degree = met.groupBy("uid").agg(F.sum("degree").alias("partners"))
    named = components(met, "rep", "root").toDF("rep", "component")
    per = store(distinct.join(degree, "uid", "left").join(named, "rep", "left"), "per_vector")
    of = per.select("label", "v", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
