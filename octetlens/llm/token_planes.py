"""Token ids in bit planes: fixed-size blocks of ids, transposed into bit or byte planes, each compressed with zstandard.

A segment is a run of whole documents in ascending order of identifiers, one file:

    magic "OLP1", then little-endian: u32 bits in a plane's unit (1 or 8), u32 ids in a block, u64 documents, u64 ids, u32 blocks
    the chunk index: for each block u64 offset from the end of the index, u32 ids, u32 planes
    i64 identifier and u64 ids of each document (u8 before them: identifier present)
    blocks: for each plane u32 length and the compressed bytes

Workers write segments into the shared folder under a name of their own and rename them when they are whole, so that a lost
or repeated task leaves no half of one; a table lists them. A reader seeks blocks by the index and holds one at a time.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, store

MAGIC = b"OLP1"
_HEAD = struct.Struct("<4sIIQQI")
_CHUNK = np.dtype([("offset", "<u8"), ("ids", "<u4"), ("planes", "<u4")])


def pack_block(ids: np.ndarray, unit: int) -> tuple[int, bytes]:
    """The planes of one block, lowest first, up to the highest that holds a one."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    planes = -(-top // unit)
    press, out = zstandard.ZstdCompressor(level=1), []
    if unit == 8:
        matrix = ids.view(np.uint8).reshape(-1, 4)
        rows = [matrix[:, k].tobytes() for k in range(planes)]
    else:
        rows = [np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(planes)]
    for row in rows:
        pressed = press.compress(row)
        out += [struct.pack("<I", len(pressed)), pressed]
    return planes, b"".join(out)


def unpack_block(data: memoryview, n: int, planes: int, unit: int) -> np.ndarray:
    press, at, out = zstandard.ZstdDecompressor(), 0, np.zeros(n, "<u4")
    for k in range(planes):
        (size,) = struct.unpack_from("<I", data, at)
        row = np.frombuffer(press.decompress(data[at + 4 : at + 4 + size]), np.uint8)
        at += 4 + size
        out |= (row if unit == 8 else np.unpackbits(row, count=n)).astype("<u4") << np.uint32(k * unit)
    return out


def write_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, unit: int = 8, block: int = 16384) -> bytes:
    parts = [pack_block(ids[s : s + block], unit) for s in range(0, len(ids), block)]
    index = np.zeros(len(parts), _CHUNK)
    index["planes"] = [p for p, _ in parts]
    index["ids"] = [len(ids[s : s + block]) for s in range(0, len(ids), block)]
    sizes = np.array([len(x) for _, x in parts], np.uint64)
    index["offset"] = np.cumsum(sizes) - sizes
    head = _HEAD.pack(MAGIC, unit, block, len(doc_ids), len(ids), len(parts))
    there = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([head, index.tobytes(), there.tobytes(), names.tobytes(), np.asarray(lengths, "<u8").tobytes(), *[x for _, x in parts]])


class Segment:
    """A segment behind ``read(offset, size)``: head, index and documents at once, blocks when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.unit, self.block, docs, self.n, blocks = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a segment of token planes")
        at = _HEAD.size
        self.index = np.frombuffer(read(at, blocks * _CHUNK.itemsize), _CHUNK)
        at += self.index.nbytes
        listed = read(at, 17 * docs)
        there, names = np.frombuffer(listed, np.uint8, docs), np.frombuffer(listed, "<i8", docs, docs)
        self.names = [int(x) if ok else None for x, ok in zip(names, there)]
        self.lengths = np.frombuffer(listed, "<u8", docs, 9 * docs).astype(np.int64)
        self.start = at + 17 * docs

    def blocks(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """The ids from ``first`` to before ``last`` block by block; only blocks that hold some are read."""
        last = self.n if last is None else last
        for k in range(first // self.block, -(-last // self.block) if last > first else 0):
            offset = int(self.index["offset"][k])
            size = int(self.index["offset"][k + 1]) - offset if k + 1 < len(self.index) else -1
            ids = unpack_block(memoryview(self.read(self.start + offset, size)), int(self.index["ids"][k]), int(self.index["planes"][k]), self.unit)
            yield ids[max(0, first - k * self.block) : last - k * self.block]

    def checksums(self) -> list[int]:
        """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
        out, parts, at = [0] * len(self.lengths), self.blocks(), 0
        ids = np.empty(0, "<u4")
        for k, left in enumerate(self.lengths.tolist()):
            while left:
                if at == len(ids):
                    ids, at = next(parts), 0
                some = ids[at : at + left]
                out[k] = zlib.crc32(np.ascontiguousarray(some, "<u4"), out[k])
                at, left = at + len(some), left - len(some)
        return out


def of_bytes(data: bytes) -> Segment:
    return Segment(lambda at, size: data[at : at + size] if size >= 0 else data[at:])


def place_of(path: str):
    """File system and path within it, for workers."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(path) if rest and scheme != "file" else (fs.LocalFileSystem(), "/" + (rest or path).lstrip("/"))


def write_file(path: str, data: bytes) -> None:
    """All of it or nothing: written under a name of its own, then renamed."""
    system, at = place_of(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, at)


# ------------------------------------------------------------------ encoding


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts word by word, each distinct word once, exactly as the library encodes whole texts.

    For BPE files that drop white space, fold case and split words by PIECES before a byte-level alphabet; others are
    refused. Texts that hold a special token are encoded whole, words outside Latin-1 by the library's whole pipeline.
    The memory of words is emptied once ``most`` are in it.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.library, self.most, self.known, self.units = _tokenizer(path), most, {}, {}
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        for probe in ("A\tb  c'll x9 42;-) \xe9\xc9\xb2\xaa", "It's 3/4 na\xefve --"):
            if self.encode([probe])[0] != self._whole(probe):
                raise ValueError(f"{path} doesn't split texts at white space and by letters, digits and signs")

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words) -> None:
        units, known, whole = self.units, self.known, self._whole
        if len(units) > self.most:
            units.clear()
        for word in words:
            if not word.isascii() and not _LATIN.fullmatch(word) or _CONTROL.search(word):
                known[word] = whole(word)
                continue
            low = word.lower()
            if low.isalpha():
                known[word] = units.get(low) or self._unit(low)
            elif low[:-1].isalpha() and low[-1] in _SIGNS:
                known[word] = (units.get(low[:-1]) or self._unit(low[:-1])) + (units.get(low[-1]) or self._unit(low[-1]))
            else:
                known[word] = b"".join([units.get(u) or self._unit(u) for u in PIECES.findall(low)])

    def _unit(self, unit: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        shown = unit if unit.isascii() else unit.encode().decode("latin-1").translate(BYTES)
        out = self.units[unit] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.most:
            self.known.clear()
        split = [None if any(s in t for s in self.special) else words_of(folded(t)) for t in texts]
        self.learn(set().union(*(w for w in split if w)) - self.known.keys())
        return [self._whole(t) if w is None else b"".join(map(self.known.__getitem__, w)) for t, w in zip(texts, split, strict=True)]


#: What the pre-tokenizer takes as one piece.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN, _CONTROL, _SIGNS = re.compile("[\x00-\xff]+"), re.compile("[\x00-\x1f\x7f-\xa0]"), ".,;:!?"
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


def folded(text: str) -> str:
    """Lower case where Python's and the library's agree, so that fewer distinct words are met."""
    if text.isascii():
        return text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


#: White space to str.split that is none to a tokenizer's pattern, or differs between versions of Unicode.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and \\t \\n \\v \\f \\r."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_SEGMENTS = "shard int, segment int, n_docs long, n_ids long, path string"


def _encode(path: str, folder: str, end_id: int, unit: int, block: int, most: int):
    def run(batches):
        encoder, segment = _encoder(path), 0
        names, lengths, parts, held = [], [], [], 0
        tail = np.array([end_id], "<u4").tobytes()
        shard = -1

        def flush():
            nonlocal segment, names, lengths, parts, held
            data = write_segment(names, np.array(lengths), np.frombuffer(b"".join(parts), "<u4"), unit, block)
            at = f"{folder}/{shard:08}-{segment:06}.olp"
            write_file(at, data)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (segment, pa.int32()), (len(names), pa.int64()), (held, pa.int64()), (at, pa.string()))], names=["shard", "segment", "n_docs", "n_ids", "path"])
            segment, names, lengths, parts, held = segment + 1, [], [], [], 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                shard = some.column(2)[0].as_py()
                coded = encoder.encode([x or "" for x in some.column(1).to_pylist()])
                for name, ids in zip(some.column(0).to_pylist(), coded, strict=True):
                    names.append(name)
                    parts += [ids, tail]
                    lengths.append(len(ids) // 4 + 1)
                    held += lengths[-1]
                    if held >= most:
                        yield flush()
        if names:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 1, unit: int = 8, block: int = 16384, segment_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes segments in ascending order of identifiers: the list of files.

    A null text is empty. Nulls come first; rows that repeat an identifier follow in the order of a hash of their texts, equal
    rows in any. Shards are ranges of these, so that no identifier or text is too much for one; a segment holds
    ``segment_ids`` ids or a little more. Files go to ``folder``, of the application's shared one by default.
    """
    folder = folder or f"{scratch(docs.sparkSession)}/planes-{uuid.uuid4().hex[:12]}"
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = picked.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    sorted_ = keyed.repartitionByRange("id", "hash", "row").sortWithinPartitions("id", "hash").select("id", "text", F.spark_partition_id().alias("shard"))
    return store(sorted_.mapInArrow(_encode(tokenizer, folder, end_id, unit, block, segment_ids), _SEGMENTS), "tokens")


def segment_starts(segments: DataFrame) -> DataFrame:
    """(shard, segment, start): the ids before each segment, from sums over shards and then within each."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    own = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    return segments.select("shard", "segment", "n_ids").withColumn("own", own).join(before, "shard").select("shard", "segment", (F.col("own") + F.col("base")).alias("start"))


def _documents(batches):
    for batch in batches:
        for start, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, at = place_of(path)
            with system.open_input_file(at) as f:
                size = f.size()
                segment = Segment(lambda offset, n, f=f, size=size: f.read_at(size - offset if n < 0 else n, offset))
                crc = segment.checksums()
            ends = np.cumsum(segment.lengths)
            yield pa.RecordBatch.from_arrays([pa.array(segment.names, pa.int64()), pa.array(start + ends - segment.lengths), pa.array(segment.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: (id, start, n_tokens, ids_crc32) of each document."""
    starts = store(segment_starts(segments), "starts")
    at = segments.select("shard", "segment", "path").join(starts, ["shard", "segment"]).select("start", "path")
    # The list is short, what it names is not: each file to a task of its own, while there are tasks.
    files = max(1, min(segments.count(), 8 * segments.sparkSession.sparkContext.defaultParallelism))
    return at.repartition(files).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc_id", id_col)
