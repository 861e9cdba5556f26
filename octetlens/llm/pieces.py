"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's units (words with their leading marks) are encoded by an agenda of adjacent symbol pairs ordered by score: the
best pair, the leftmost of equals, is merged until none is in the vocabulary. The agendas of all new units of an Arrow
batch advance together as one matrix; long units use a heap. Each unit's ids are checked against the library.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_NONE = np.iinfo(np.int32).max
#: Units longer than this have their own heap.
LONG = 48


class Merges:
    """Vocabulary of a merge-type model as a table of symbol pairs."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(m.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        self.unknown, self.begin, self.end = m.unk_id(), m.bos_id(), m.eos_id()
        pieces = {m.id_to_piece(i): i for i in ids}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces if len(p) > 1):
            raise ValueError("a piece crosses words; units can't be encoded alone")
        # Symbols: the pieces by id, then characters that only occur inside pieces.
        self.symbols = dict(pieces)
        for p in pieces:
            for c in p:
                self.symbols.setdefault(c, m.get_piece_size() + len(self.symbols))
        self.count = max(self.symbols.values()) + 2
        order = {s: k for k, s in enumerate(sorted({m.get_score(i) for i in ids}, reverse=True))}
        pairs = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.count + b] = (order[m.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [_NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.chars = np.full(0x110000, self.count - 1, np.int32)  # the last symbol: in no piece
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.is_piece = np.zeros(self.count, bool)
        self.is_piece[list(pieces.values())] = True

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.count + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def merge_units(self, units: list[str]) -> tuple[dict[str, bytes], dict[str, np.ndarray]]:
        """What each unit's agenda leaves: ids, or symbols where some are in no piece."""
        ids: dict[str, bytes] = {}
        odd: dict[str, np.ndarray] = {}
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u) if len(u) <= LONG else 0, []).append(u)
        for size, which in by_length.items():
            step = max(1, (1 << 20) // size) if size else 1
            for at in range(0, len(which), step):
                some = which[at : at + step]
                symbols, lengths = self._matrix(some, size) if size else self._heap(some[0])
                good = np.logical_and.reduceat(self.is_piece[symbols], np.cumsum(lengths) - lengths)
                raw, end = symbols.astype("<u4").tobytes(), 0
                for unit, n, ok in zip(some, lengths.tolist(), good.tolist(), strict=True):
                    if ok:
                        ids[unit] = raw[4 * end : 4 * (end + n)]
                    else:
                        odd[unit] = symbols[end : end + n]
                    end += n
        return ids, odd

    def _matrix(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
        symbol, left = self.chars[codes], np.full(len(units), size, np.int32)
        if size > 1:
            entry = self._look(symbol[:, :-1], symbol[:, 1:])
            rank = np.concatenate([self.ranks[entry], np.full((len(units), 1), _NONE, np.int32)], axis=1)
            live, columns = np.arange(len(units)), np.arange(size)
            s, r = symbol, rank
            while len(live):
                best = r.argmin(axis=1)
                rows = np.arange(len(live))
                go = r[rows, best] < _NONE
                if not go.all():
                    symbol[live] = s
                    live, s, r, best = live[go], s[go], r[go], best[go]
                    rows = np.arange(len(live))
                    if not len(live):
                        break
                new = self.merged[self._look(s[rows, best], s[rows, best + 1])]
                # The symbols behind the merged pair move up by one.
                take = np.minimum(columns + (columns > best[:, None]), size - 1)
                s, r = np.take_along_axis(s, take, 1), np.take_along_axis(r, take, 1)
                s[rows, best] = new
                left[live] -= 1
                r[rows, best] = _NONE
                has = best < left[live] - 1
                r[rows[has], best[has]] = self.ranks[self._look(s[rows[has], best[has]], s[rows[has], best[has] + 1])]
                has = best > 0
                r[rows[has], best[has] - 1] = self.ranks[self._look(s[rows[has], best[has] - 1], s[rows[has], best[has]])]
                r[:, -1] = _NONE
                r[np.arange(len(live)), left[live] - 1] = _NONE
        return symbol[np.arange(size) < left[:, None]], left

    def _heap(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        symbol = self.chars[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        after, before = list(range(1, len(symbol))) + [-1], list(range(-1, len(symbol) - 1))
        agenda: list = []

        def push(i):
            if i >= 0 and after[i] >= 0 and (found := self.pairs.get(symbol[i] * self.count + symbol[after[i]])):
                heapq.heappush(agenda, (found[0], i, symbol[i], symbol[after[i]], found[1]))

        for i in range(len(symbol)):
            push(i)
        while agenda:
            _, i, a, b, new = heapq.heappop(agenda)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        left = np.array([x for x in symbol if x >= 0], np.int32)
        return left, np.array([len(left)], np.int32)


class PieceEncoder:
    """Texts to ids exactly as the library's, each distinct unit once.

    Units are kept in two generations of about ``most``: those that nobody asked for while one filled up are forgotten, so
    that a worker's memory is bounded whatever the texts hold, and frequent units stay.
    """

    def __init__(self, path: str, most: int = 100_000):
        self.merges, self.most, self.known, self.earlier = Merges(path), most, {}, {}
        self.library = self.merges.library
        names = {i: self.library.id_to_piece(i) for i in range(self.library.get_piece_size())}
        self.length = {i: len(p) for i, p in names.items()}
        # One unit: marks with what follows them up to the next mark, a line's end, or a sign that no piece has behind a letter.
        joined = {b for p in names.values() for a, b in zip(p, p[1:]) if a.isalpha()}
        signs = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in joined)
        sign = f"(?:(?<![^\\W\\d_])[{signs}][^{MARK}\n{signs}]*)*" if signs else ""
        self.unit = re.compile(f"{MARK}*[^{MARK}\n][^{MARK}\n{signs}]*{sign}|{MARK}+|\n")
        # Only models that leave texts as they are, but for a mark in front, are encoded by units.
        self.plain = all(self.library.encode(x, num_threads=1) == self._units_alone(x) for x in ("a", " a  b ", "\n x\téﬁÅ", "Á b　c"))

    def _units_alone(self, text: str) -> list[int]:
        units = self.split(text)
        return array("I", b"".join(map(self._ids(units).__getitem__, units))).tolist()

    def split(self, text: str) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def _ids(self, units) -> dict[str, bytes]:
        m = self.merges
        out, odd = m.merge_units(list(dict.fromkeys(units)))
        for unit, left in odd.items():
            ids, at = array("I"), 0
            for s in left.tolist():
                if m.is_piece[s]:
                    ids.append(s)
                    at += self.length[s]
                    continue
                raw = unit[at].encode("utf-8", "surrogatepass")
                at += 1
                ids.extend([m.bytes[b] for b in raw] if m.bytes else [m.unknown])
            out[unit] = ids.tobytes()
        return out

    def learn(self, units: list[str]) -> None:
        """Encodes new units and checks each against the library, whose answer holds where they differ."""
        own = self._ids(units)
        lead = len(self.library.encode("\n", num_threads=1))
        asked = [u[1:].replace(MARK, " ") if u[0] == MARK and len(u) > 1 else "\n" + u.replace(MARK, " ") for u in units]
        for unit, text, ids in zip(units, asked, self.library.encode(asked, num_threads=1), strict=True):
            checked = array("I", ids[lead:] if text[0] == "\n" and unit[0] != MARK or unit == MARK else ids).tobytes()
            if own[unit] != checked:
                own[unit] = checked
        self.known.update(own)

    def forget(self) -> None:
        """Lets go of all units: an idle worker shouldn't hold what its last task met."""
        self.known, self.earlier = {}, {}
        gc.collect()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.most:
            self.earlier, self.known = self.known, {}
        split = [self.split(t) if self.plain and MARK not in t and "\0" not in t else None for t in texts]
        asked = set().union(*(u for u in split if u)) - self.known.keys()
        again = asked & self.earlier.keys()
        self.known.update((u, self.earlier[u]) for u in again)
        self.learn(list(asked - again))
        whole = lambda t: array("I", self.library.encode(t, num_threads=1)).tobytes()
        return [whole(t) if u is None else b"".join(map(self.known.__getitem__, u)) for t, u in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


#: Rows and bytes of text that are encoded at once; a longer text is alone.
_ROWS, _BYTES = 500, 1 << 20


def slices(batch: pa.RecordBatch, rows: int = _ROWS, size: int = _BYTES):
    """The batch in parts of bounded size by its second column, in order."""
    length = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(length):
        if i > at and (i - at == rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(length):
        yield batch.slice(at)


def _code(path: str, keep: bool):
    def run(batches):
        encoder = piece_encoder(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (encoder.merges.begin, encoder.merges.end))
        try:
            for batch in batches:
                for some in slices(batch):
                    coded = [begin + x + end for x in encoder.encode([x or "" for x in some.column(1).to_pylist()])]
                    arrays = [np.frombuffer(x, "<u4") for x in coded]
                    decoded = [encoder.library.decode(x.tolist()) for x in arrays]
                    columns = [some.column(0), pa.array([len(x) for x in arrays], pa.int64())]
                    names = ["doc_id", "n_tokens"]
                    if keep:
                        columns += [pa.array(arrays, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                        names += ["ids", "decoded"]
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids_sha256", "decoded_sha256"])
        finally:
            encoder.forget()

    return run


def encode_pieces(docs: DataFrame, model: str, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: (id, n_tokens, ids, decoded, ids_sha256, decoded_sha256); ids and decoded text if ``keep``.

    Ids carry the begin and end ids. A null text is empty. Every row gives one row, repeated identifiers too.
    """
    kept = "ids array<int>, decoded string, " if keep else ""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_code(model, keep), f"doc_id long, n_tokens long, {kept}ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc_id", id_col)
