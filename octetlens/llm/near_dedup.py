"""MinHash near-deduplication with odd sketches.

A document's shingles give MinHash samples. Bands of samples propose candidates; the samples folded into a parity bitmap
(an odd sketch) estimate a pair's similarity from the population count of the bitmaps' XOR and discard what is far
below the threshold; what is left is confirmed on the full sets.

Nodes are distinct sets, whatever rows and identifiers hold them. No bucket is expanded into pairs. First each member of a
bucket meets the bucket's smallest member, whose text goes once to each SHARE of those that it meets. Then only buckets
whose other members still lie in different components are looked at again, in cells of bounded size, and only pairs
across components are compared there, each in the first band the two share. So every pair that shares a band is either
compared or already connected, whatever the size of the bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, shingle_hashes, store, word_hashes

ROWS, BANDS = 4, 24
SAMPLES = ROWS * BANDS
SKETCH_BITS = 256
#: Documents in a block of a cell.
CELL = 512
#: Documents that one copy of a leader's text is compared with, about.
SHARE = 512
#: Most that a pair at the threshold may miss all bands with.
MISS = 1e-5
#: How far a pair's estimate may lie below the threshold before it is discarded: over six standard errors of the samples.
MARGIN = 0.3
_seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, SAMPLES), dtype=np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of SAMPLES hash functions over a set of shingle hashes."""
    low = np.full(SAMPLES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            x = (shingles[at : at + 512, None] ^ _seeds[0]) * (_seeds[1] * np.uint64(2) + np.uint64(1))
            np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of samples."""
    with np.errstate(over="ignore"):
        parts = low.reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
        return key


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each flips the bit it hashes to."""
    with np.errstate(over="ignore"):
        bit = mix(low + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(SKETCH_BITS - 1)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).view(np.int64)


def similarity_of_xor(ones: np.ndarray) -> np.ndarray:
    """Estimated similarity from the population count of two sketches' XOR."""
    p = np.minimum(np.asarray(ones, float) / SKETCH_BITS, 0.4999)
    differing = np.log1p(-2 * p) / np.log1p(-2 / SKETCH_BITS)
    return 1 - differing / (2 * SAMPLES)


#: Most ones in the XOR of two sketches, for each threshold, that keep a pair.
def most_ones(threshold: float) -> int:
    estimates = similarity_of_xor(np.arange(SKETCH_BITS // 2))
    return int(np.searchsorted(-estimates, -(threshold - MARGIN), side="right"))


#: A sketch as 64-bit words.
WORDS = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_SIGNED = "doc_id long, mark long, n long, fingerprint binary, bands binary, " + ", ".join(f"{w} long" for w in WORDS)


def _sign(k: int):
    def run(batches):
        for batch in batches:
            n, mark, band, sketch = [], [], [], np.zeros((batch.num_rows, len(WORDS)), np.int64)
            for i, text in enumerate(batch.column(2)):
                x = shingle_hashes(word_hashes(text.as_py()), k)
                n.append(len(x))
                if not len(x):
                    mark.append(None)
                    band.append(None)
                    continue
                low = samples(x)
                with np.errstate(over="ignore"):
                    mark.append(np.array([x.sum(), mix(x + np.uint64(99)).sum()], np.uint64).tobytes())
                band.append(bands(low).tobytes())
                sketch[i] = odd_sketch(low)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(band, pa.binary()), *[pa.array(c) for c in sketch.T.copy()]],
                names=["doc_id", "mark", "n", "fingerprint", "bands", *WORDS],
            )

    return run


def _band_rows(batches):
    for batch in batches:
        keys = batch.column(1)
        flat = np.frombuffer(b"".join(x.as_py() for x in keys), np.int64) if len(keys) else np.empty(0, np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids)], names=["key", "id"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    a, b = len(x), len(y)
    if 100 * min(a, b) < percent * max(a, b):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (a + b - both)


def _confirm(k: int, percent: int):
    """Of rows (leader, part, a, text), sorted so that a leader's own row, with a null, comes first: links of similar sets."""

    def run(batches):
        mine = None
        for batch in batches:
            leader, a, text = (batch.column(c) for c in ("leader", "a", "text"))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = shingle_hashes(word_hashes(text[i].as_py()), k)
                if a[i].as_py() is None:
                    mine = x
                else:
                    ok[i] = similar(x, mine, percent)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), leader.filter(pa.array(ok))], names=["a", "b"])

    return run


def _cell(k: int, percent: int, ones: int):
    """Links of a cell: pairs across components, each in the first band its members share."""

    def run(group: pa.Table) -> pa.Table:
        # Kind 0 compares members of the largest component with all others. Kind 1 compares the others with each other;
        # in a cell of two blocks, pairs within a block belong to that block's own cell.
        inner = group.column("kind")[0].as_py() == 0
        two = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        group = group.sort_by([("component", "ascending"), ("id", "ascending")])
        ids, comp, block, apart = (group.column(c).to_numpy() for c in ("id", "component", "block", "apart"))
        keys = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.uint64).reshape(-1, BANDS)
        band = int((keys[0].view(np.int64) == group.column("key")[0].as_py()).argmax())
        sketch = np.stack([group.column(w).to_numpy() for w in WORDS], axis=1)
        size, texts, sets = group.column("n").to_numpy(), group.column("text"), {}
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def full(i):
            if i not in sets:
                sets[i] = shingle_hashes(word_hashes(texts[i].as_py()), k)
            return sets[i]

        links = []
        for i in range(1, len(ids)):
            near = np.bitwise_count(sketch[:i] ^ sketch[i]).sum(axis=1) <= ones
            near &= (comp[:i] != comp[i]) & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i]))
            if inner:
                near &= apart[:i] != apart[i]
            elif two:
                near &= block[:i] != block[i]
            for j in np.flatnonzero(near).tolist():
                if find(comp[i]) == find(comp[j]) or int((keys[i] == keys[j]).argmax()) != band:
                    continue
                if similar(full(i), full(j), percent):
                    links.append((ids[i], ids[j]))
                    root[find(comp[i])] = find(comp[j])
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: (id, n_shingles, component_id, kept).

    A document's set holds the distinct runs of ``k`` words of its text, A-Z lower-cased; of a shorter text the whole
    sequence. Documents with 100 * intersection >= percent * union are linked; a component is named by its smallest
    identifier. Texts without words, and rows without an identifier, link with nothing and are kept; a nameless row has
    no component. Rows that repeat an identifier are linked with each other, and each of their texts links for itself.
    A ``percent`` so low that the bands would miss pairs is refused.
    """
    if (1 - (percent / 100) ** ROWS) ** BANDS > MISS:
        raise ValueError(f"{BANDS} bands of {ROWS} samples miss too many pairs at {percent} percent")
    ones = most_ones(percent / 100)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    signed = store(named.mapInArrow(_sign(k), _SIGNED), "signed")
    usable = signed.where("fingerprint is not null and doc_id is not null")
    # Equal sets collapse to one node, that of their smallest document, before anything is compared.
    first_of = usable.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "mark", "n", "bands", *WORDS)).alias("r"))
    reps = store(first_of.select("fingerprint", F.monotonically_increasing_id().alias("id"), *[f"r.{c}" for c in ("doc_id", "mark", "n", "bands", *WORDS)]), "reps")
    keyed = reps.select("id", "bands").mapInArrow(_band_rows, "key long, id long")
    leaders = store(keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1").select("key", "leader"), "leaders")
    shared = store(keyed.join(leaders, "key"), "shared")
    wanted = named.join(reps.select("id", "doc_id", "mark").join(shared.select("id").distinct(), "id"), ["doc_id", "mark"])
    texts = store(wanted.groupBy("id").agg(F.min("text").alias("text")), "texts")
    pairs = shared.where("id <> leader").select(F.col("id").alias("a"), "leader").distinct()
    light = reps.select("id", "n", *WORDS)
    close = pairs.join(light.toDF("a", "na", *[f"a{w}" for w in WORDS]), "a").join(light.toDF("leader", "nb", *[f"b{w}" for w in WORDS]), "leader")
    xor = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in WORDS), F.lit(0))
    close = store(close.where((xor <= ones) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "leader"), "close")
    # A leader's pairs are dealt to parts of bounded size, and its text goes to each part once.
    met = close.join(close.groupBy("leader").agg(F.ceil(F.count("*") / SHARE).alias("parts")), "leader").select("leader", F.pmod(F.xxhash64("a"), "parts").alias("part"), "a")
    own = met.select("leader", "part").distinct().join(texts.withColumnRenamed("id", "leader"), "leader").select("leader", "part", F.lit(None).cast("long").alias("a"), "text")
    both = met.join(texts.withColumnRenamed("id", "a"), "a").select("leader", "part", "a", "text").union(own)
    dealt = both.repartition("leader", "part").sortWithinPartitions("leader", "part", F.asc_nulls_first("a"))
    links = store(dealt.mapInArrow(_confirm(k, percent), "a long, b long"), "links")
    first = store(components(links), "first")
    # Buckets whose members, the leader apart, lie in several components. Members of the largest need no second look at
    # each other: each lies in one cell, and only the others, mostly few, go to all cells and meet among themselves.
    others = shared.where("id <> leader").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = others.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    parts = parts.agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("members")).where("most.n < members")
    open_ = store(parts.select("key", F.col("most.component").alias("largest"), F.ceil(F.col("most.n") / CELL).alias("inner"), F.ceil((F.col("members") - F.col("most.n")) / CELL).alias("outer")), "open")
    rows = others.join(open_, "key").withColumn("apart", F.col("component") != F.col("largest"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("apart"), F.col("outer")).otherwise(F.col("inner")))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    cell = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    within = F.transform(every(F.col("inner")), lambda b: cell(0, b, b))
    among = F.transform(every(F.col("outer")), lambda b: cell(1, F.least(F.col("block"), b), F.greatest(F.col("block"), b)))
    held = F.when(F.col("apart"), F.concat(within, among)).otherwise(F.array(cell(0, F.col("block"), F.col("block"))))
    cells = rows.withColumn("block", block).withColumn("cell", F.explode(held)).select("key", "id", "component", "apart", "block", "cell.*")
    filled = cells.join(reps.select("id", "n", "bands", *WORDS), "id").join(texts, "id")
    more = store(filled.groupBy("key", "kind", "low", "high").applyInArrow(_cell(k, percent, ones), "a long, b long"), "more")
    # Several sets of one identifier belong together.
    several = usable.groupBy("doc_id").agg(F.min("fingerprint").alias("least"), F.max("fingerprint").alias("most")).where("least <> most").select("doc_id")
    held = usable.join(several, "doc_id").select("doc_id", "fingerprint").distinct().join(reps.select("fingerprint", "id"), "fingerprint")
    same = held.join(held.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b")
    final = store(components(links.union(more).union(same)), "final")
    placed = reps.select("fingerprint", "id", "doc_id").join(final, "id", "left").select("fingerprint", "doc_id", F.coalesce("component", "id").alias("place"))
    named_by = placed.groupBy("place").agg(F.min("doc_id").alias("component"))
    per_set = store(placed.join(named_by, "place").select("fingerprint", "component"), "per_set")
    out = signed.select("doc_id", "n", "fingerprint").join(per_set, "fingerprint", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
    own = out.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    out = out.where("doc_id is not null").union(own)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with all their columns; all rows of its identifier."""
    kept = near_duplicates(docs, k, percent, id_col, text_col).where("kept").select(id_col).distinct()
    named = docs.join(kept.where(F.col(id_col).isNotNull()), id_col, "left_semi")
    return named.select(*docs.columns).union(docs.where(F.col(id_col).isNull()).select(*docs.columns))
