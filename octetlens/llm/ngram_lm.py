"""Language-model scoring with a weighted backoff automaton.

States are contexts of up to ``order`` - 1 words that training texts hold. An n-gram of training is an arc from the state of
its first words; for any other word the failure arc of a state leads, at a cost, to the state of one word less, down to the
empty state, where every word has an arc. With Dirichlet smoothing

    P(w | a h) = (c(a h w) + mu P(w | h)) / (c(a h) + mu),    P(w) = (c(w) - d) / N,    P(unknown) = d V / N,

arcs and failure arcs follow from counts alone. One traversal from left to right carries the state and adds the weights.

The model isn't broadcast: it grows with the corpus. Texts are cut into blocks; a block asks for the training counts of
just its distinct n-grams, as packed sorted runs of hashes, and so gets the part of the automaton that its texts can reach.
Runs meet in a tree: each block sends the parts of its runs to the nodes of ``fan`` ranges of hashes at most. Where these
are enough for the corpus, a node holds all counts of its range. Else ``fan`` blocks share a node, which merges what it got
and sends on in the same way, each level dividing the ranges further; answers travel down the same tree. A block or node sends
``fan`` messages at most on each level, and a level holds no more entries than the blocks do, so messages grow with the corpus
(times its logarithm to the base ``fan``). A frequent n-gram is one entry of each block, so nothing is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, store, word_hashes

#: Hash that stands for the end of a document, also the context of its first word.
END = np.uint64(0x5D1F0C3B9A7E2468)
#: Entries of a range, about.
RANGE = 3_000_000
#: Tokens of a block, about.
BLOCK = 1_000_000
#: Messages that a block or node sends on a level at most.
FAN = 4096
#: Bits of a hash that tell n-grams of two and more words apart; those of words have 64.
_PAIR_BITS = np.uint64(2**64 - 2**8)


def _press(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpress(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)


def press_sorted(x: np.ndarray) -> bytes:
    return _press(np.diff(x, prepend=np.uint64(0)))


def unpress_sorted(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unpress(data, "<u8"), dtype=np.uint64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b) & _PAIR_BITS


# ------------------------------------------------------------------ blocks

_BLOCKS = "block long, tokens long, trained long, words long, ids array<long>, held binary, lengths binary, vocabulary binary, local binary"
_BLOCK_TYPE = pa.schema([*((c, pa.int64()) for c in ("block", "tokens", "trained", "words")), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("held", "lengths", "vocabulary", "local"))])


def _cut(limit: int):
    """Blocks of documents: each distinct word's hash once, and the tokens as numbers of these."""

    def run(batches):
        ids, held, words, total, part, at = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, held, words, total, at
            vocabulary, local = np.unique(np.concatenate(words), return_inverse=True)
            lengths, out = np.array([len(w) for w in words], "<u4"), np.array(held, np.uint8)
            row = ((part << 32) + at, total, int(lengths[out == 0].sum()), len(vocabulary), ids, out.tobytes(), lengths.tobytes(), press_sorted(vocabulary), _press(local.astype("<u4")))
            ids, held, words, total, at = [], [], [], 0, at + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _BLOCK_TYPE)], schema=_BLOCK_TYPE)

        for batch in batches:
            for i, h, text, p in zip(*(batch.column(k) for k in range(4)), strict=True):
                part = p.as_py()
                ids.append(i.as_py())
                held.append(h.as_py())
                words.append(np.append(word_hashes(text.as_py()), END))
                total += len(words[-1])
                if total >= limit:
                    yield flush()
        if ids:
            yield flush()

    return run


class Block:
    """The n-grams of a block's documents: of each order, sorted distinct hashes and every token's number among them.

    The n-gram of a token ends there. A document has one mark before its first word, so that a token has none of more
    words than there are up to it and that mark; its number is then one past the last.
    """

    def __init__(self, row: dict, order: int):
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.ends = np.cumsum(self.lengths)
        vocabulary, local = unpress_sorted(row["vocabulary"]), _unpress(row["local"], "<u4").astype(np.int64)
        self.first = np.zeros(len(local), bool)
        self.first[self.ends - self.lengths] = True
        self.end = int(np.searchsorted(vocabulary, END))
        self.keys, self.number = [vocabulary], [local]
        token = vocabulary[local]
        last, there = token, np.ones(len(token), bool)
        for k in range(2, order + 1):
            before = np.append(END, last[:-1])
            if k == 2:
                before[self.first] = END
            else:
                there = np.append(False, there[:-1]) & ~self.first
            last = pair_hash(before, token)
            keys, number = np.unique(last[there], return_inverse=True)
            every = np.full(len(token), len(keys))
            every[there] = number
            self.keys.append(keys)
            self.number.append(every)

    def trained(self, k: int) -> np.ndarray:
        """How often each n-gram of ``k`` + 1 words occurs in the block's training documents."""
        taught = np.repeat(~self.held, self.lengths)
        return np.bincount(self.number[k][taught], minlength=len(self.keys[k]) + 1)[: len(self.keys[k])].astype("<u4")


# ------------------------------------------------------------------ exchange of counts

_MESSAGE = "team long, range long, kind int, child long, keys binary, counts binary"
_MESSAGE_TYPE = pa.schema([("team", pa.int64()), ("range", pa.int64()), ("kind", pa.int32()), ("child", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = "child long, range long, kind int, counts binary, known long, once long, twice long"
_ANSWER_TYPE = pa.schema([("child", pa.int64()), ("range", pa.int64()), ("kind", pa.int32()), ("counts", pa.binary()), ("known", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])


def _pieces(team: int, child: int, kind: int, keys: np.ndarray, counts: np.ndarray, within: int, fan: int, ranges: int) -> list[tuple]:
    """Messages with the parts of sorted hashes that lie in each of the ``fan`` ranges of range ``within``, of ``ranges`` in all."""
    cuts = np.array([(((within * fan + j) << 64) // ranges) for j in range(1, fan)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
    return [(team, within * fan + j, kind, child, press_sorted(keys[a:b]), _press(counts[a:b])) for j, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def _send(order: int, fan: int, team: int):
    """A block's messages to the nodes of its team, ``team`` blocks at a time."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, out = Block(row, order), []
                for k in range(order):
                    out += _pieces(row["home"] // team, row["block"], k + 1, block.keys[k], block.trained(k), 0, fan, fan)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _MESSAGE_TYPE)], schema=_MESSAGE_TYPE)

    return run


def _merged(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a node's messages: their hashes, all distinct ones, each message's places among them, and summed counts."""
    keys = [unpress_sorted(x.as_py()) for x in group.column("keys")]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpress(x.as_py(), "<u4") for x in group.column("counts")])
    return keys, every, where, np.bincount(where, counts, len(every)).astype("<u4")


def _send_on(fan: int, team_of: int, ranges: int):
    """A node's messages to the next level."""

    def run(group: pa.Table) -> pa.Table:
        team, within, kind = (group.column(c)[0].as_py() for c in ("team", "range", "kind"))
        _, every, _, total = _merged(group)
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*_pieces(team // team_of, team, kind, every, total, within, fan, ranges), strict=True), _MESSAGE_TYPE)], schema=_MESSAGE_TYPE)

    return run


def _reply(group: pa.Table, keys: list[np.ndarray], where: np.ndarray, total: np.ndarray, stats: tuple[int, int, int]) -> pa.Table:
    ends = np.cumsum([len(x) for x in keys])
    counts = pa.array([_press(total[where[e - len(k) : e]]) for k, e in zip(keys, ends)], pa.binary())
    rest = [0] * (len(keys) - 1)
    return pa.table([group.column("child"), group.column("range"), group.column("kind"), counts, *[pa.array([x, *rest], pa.int64()) for x in stats]], schema=_ANSWER_TYPE)


def _add_up(group: pa.Table) -> pa.Table:
    """Of a node at the top: corpus counts, told to each child in the order of its hashes; how many occur, occur once, twice."""
    keys, _, where, total = _merged(group)
    return _reply(group, keys, where, total, (int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))


def _pass_down(messages: pa.Table, answers: pa.Table) -> pa.Table:
    """Of a node below: the counts it was told, told to each child."""
    if not messages.num_rows:
        return _ANSWER_TYPE.empty_table()
    keys, _, where, _ = _merged(messages)
    told = answers.sort_by("range").column("counts")
    return _reply(messages, keys, where, np.concatenate([_unpress(x.as_py(), "<u4") for x in told]), (0, 0, 0))


def corpus_counts(blocks: DataFrame, n_blocks: int, order: int, fan: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Answers (child, range, kind, counts, ...), for each block the training counts of its n-grams in pieces by range, and those of the top."""
    fans = []
    while ranges > fan:
        fans.append(fan)
        ranges = -(-ranges // fan)
    fans.append(ranges)
    # Which blocks form a team is dealt by a hash; teams of teams follow.
    dealt = blocks.withColumn("home", F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks))))
    sent = [dealt.mapInArrow(_send(order, fans[0], fan), _MESSAGE)]
    node, divided = ["team", "range", "kind"], fans[0]
    for more in fans[1:]:
        divided *= more
        sent[-1] = store(sent[-1], "messages")
        sent.append(sent[-1].groupBy(*node).applyInArrow(_send_on(more, fan, divided), _MESSAGE))
    # The last level is one team, whatever fell where by the hash.
    answers = store(sent.pop().withColumn("team", F.lit(0).cast("long")).groupBy(*node).applyInArrow(_add_up, _ANSWER), "answers")
    stats = answers
    while sent:
        up = answers.select(F.col("child").alias("team"), F.floor(F.col("range") / fans.pop()).alias("within"), "kind", "range", "counts")
        answers = store(sent.pop().groupBy(*node).cogroup(up.groupBy("team", "within", "kind")).applyInArrow(_pass_down, _ANSWER), "answers")
    return answers, stats


# ------------------------------------------------------------------ the automaton


class Automaton:
    """The part of the automaton that a block's texts can reach.

    A token may be met in states of 0 to ``order`` - 1 words, and has one arc from each at most: ``arcs[k][i]`` is the weight
    of token i's arc from the state of the k words before it, NaN where there is none. ``failures[k][i]`` is the weight of
    the failure arc of that state, k at least 1, which leads to the state of k - 1 words. Weights are log10. An unknown
    word leaves the empty state behind.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, words: int, discount: float, strengths: Sequence[float]):
        seen = counts[0].astype(float)[block.number[0]]
        p = word_arc(seen, total, words, discount)
        self.ends, self.known = block.ends, seen > 0
        self.arcs, self.failures, self.count = [np.log10(p)], [np.empty(0)], seen
        marks = float(counts[0][block.end]) if len(counts[0]) else 0.0
        for k in range(1, len(counts)):
            context = np.append(0.0, seen[:-1])
            context[block.first] = marks if k == 1 else 0.0
            seen = np.append(counts[k], 0).astype(float)[block.number[k]]
            mu = strengths[k - 1]
            p = (seen + mu * p) / (context + mu)
            self.arcs.append(np.where(seen > 0, np.log10(p), np.nan))
            self.failures.append(np.log10(mu / (context + mu)))

    def traverse(self, step: int = 1 << 16) -> list[float]:
        """Each document's weight: one pass over its tokens that carries the state, here its number of words."""
        most, out, total, document = len(self.arcs) - 1, [], 0.0, 0
        start = state = min(1, most)
        for a in range(0, len(self.known), step):
            known = self.known[a : a + step].tolist()
            arcs, failures = ([x[a : a + step].tolist() for x in xs] for xs in (self.arcs, self.failures))
            i = 0
            while i < len(known):
                stop = min(int(self.ends[document]) - a, len(known))
                for i in range(i, stop):
                    weight = arcs[state][i]
                    while weight != weight:
                        total += failures[state][i]
                        state -= 1
                        weight = arcs[state][i]
                    total += weight
                    if not known[i]:
                        state = 0
                    elif state < most:
                        state += 1
                i = stop
                if a + stop == self.ends[document]:
                    out.append(total)
                    total, state, document = 0.0, start, document + 1
        return out


def word_arc(count: np.ndarray, total: int, words: int, discount: float) -> np.ndarray:
    """Probability at the empty state; all unknown words together are one symbol."""
    unknown = discount * words / total if total else 1.0
    return np.where(count > 0, (count - discount) / max(total, 1), unknown)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED_TYPE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(total: int, words: int, discount: float, strengths: Sequence[float]):
    order = len(strengths) + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.sort_by([("kind", "ascending"), ("range", "ascending")])
        kinds, pressed, out = answers.column("kind").to_pylist(), answers.column("counts"), []
        counts = [np.concatenate([_unpress(pressed[i].as_py(), "<u4") for i, x in enumerate(kinds) if x == k + 1] or [np.empty(0, "<u4")]) for k in range(order)]
        for row in left.to_pylist():
            block = Block(row, order)
            model = Automaton(block, counts, total, words, discount, strengths)
            starts = block.ends - block.lengths
            base = np.log10((model.count + 1) / (total + words + 1.0))
            out.append([
                pa.array(row["ids"], pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(np.add.reduceat(model.known.astype(np.int64), starts)),
                pa.array(np.full(len(starts), total)), pa.array(np.add.reduceat(base, starts)), pa.array(model.traverse(), pa.float64()),
            ])
        return pa.concat_tables([pa.table(x, schema=_SCORED_TYPE) for x in out]) if out else _SCORED_TYPE.empty_table()

    return run


def score_corpus(
    docs: DataFrame, held_out: Column, strengths: Sequence[float] = (1000.0, 100.0), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, fan: int = FAN
) -> DataFrame:
    """Learns from documents where ``held_out`` is false and scores all of them.

    Per document: (id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10 probabilities of the words and
    one end; ``base_score`` is that of words alone with one added to each count. ``strengths`` are mu for n-grams of two,
    three, ... words, so their number sets the order. A null text is empty: an end alone. A null ``held_out`` counts as
    false. Rows that repeat an identifier, or have none, are documents of their own. Without any training document every
    word is unknown. The discount d is n1 / (n1 + 2 n2) of the words that occur once and twice, between 0.01 and 0.99. A
    document is never cut, so a block's memory is that of ``block`` tokens and its longest document.
    """
    spark, order = docs.sparkSession, len(strengths) + 1
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).cast("int").alias("held"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    blocks = store(picked.mapInArrow(_cut(block), _BLOCKS), "blocks")
    n, entries, train = (x or 0 for x in blocks.agg(F.count("*"), F.sum(F.col("tokens") + F.col("words")), F.sum("trained")).first())
    ranges = max(1, -(-entries // RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    answers, stats = corpus_counts(blocks, n, order, fan, ranges)
    words, once, twice = (x or 0 for x in stats.where("kind = 1").agg(F.sum("known"), F.sum("once"), F.sum("twice")).first())
    discount = once / (once + 2 * twice) if once else 0.5
    told = answers.select(F.col("child").alias("block"), "range", "kind", "counts")
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(train, words, min(max(discount, 0.01), 0.99), strengths), _SCORED)
    return scored.withColumnRenamed("doc_id", id_col)
