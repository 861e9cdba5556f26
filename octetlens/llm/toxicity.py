"""Toxicity: a classifier regularised by counterfactuals.

Identity terms of labelled texts are swapped for others of their group; a text and its counterfactual should score
alike, so the squared difference of their logits joins the loss. Labelled texts are short of such terms, or hold them in
toxic ones only, so a share of the texts without any is given one: chosen by a digest of the text, whatever the label, and
with a counterfactual that has another term of the group, or none. Mentioning a group then adds nothing to the score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import mix, powers

BITS = 20
#: Lengths of word beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
#: Groups of terms that may stand for each other. Fixed values; a parameter of training.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return _LETTER


_SEGMENT = 1 << 20


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed distinct words of a text, and their beginnings; words are runs of letters, lower-cased."""
    low = text.lower()
    if len(low) <= _SEGMENT:
        return np.unique(_hashed(low, bits))
    parts, at = [], 0
    while at < len(low):
        end = at + _SEGMENT
        while end < len(low) and low[end].isalpha():
            end += 1
        parts.append(np.unique(_hashed(low[at:end], bits)))
        at = end
    return np.unique(np.concatenate(parts))


def _hashed(low: str, bits: int) -> np.ndarray:
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(_letters()[c], prepend=False, append=False))
    s, e = edge[::2], edge[1::2]
    power, inverse = powers(len(c) + 1)
    total = np.zeros(len(c) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * power[: len(c)], out=total[1:])
        out = [mix((total[e] - total[s]) * inverse[s])]
        for k in STEMS:
            b = s[e - s >= k]
            out.append(mix((total[b + k] - total[b]) * inverse[b] + np.uint64(k)))
    return np.concatenate(out) >> np.uint64(64 - bits)


def counterfactual(text: str, groups=IDENTITY_GROUPS) -> str | None:
    """The text with each identity term swapped for the next of its group; None without such terms."""
    after = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    pattern = regex.compile(r"\b(?:" + "|".join(map(regex.escape, after)) + r")\b", regex.IGNORECASE)
    swapped = pattern.sub(lambda m: after[m[0].lower()], text)
    return swapped if swapped != text else None


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, text: str | None, bits: int = BITS) -> float:
        z = self.bias + (float(self.weights[features(text, bits)].sum()) if text else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))


def fit(rows: list, size: int, alpha: float, beta: float, l1: float, l2: float, fairness: float, epochs: int) -> ToxicityModel:
    """Follow-the-regularised-leader on (label, features, counterfactual features or None)."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.Generator(np.random.PCG64(11))

    def weight(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    def step(at, g):
        w, n2 = weight(at), n[at] + g * g
        z[at] += g - (np.sqrt(n2) - np.sqrt(n[at])) / alpha * w
        n[at] = n2

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, other = rows[i]
            at = np.append(at, size)
            p = 1 / (1 + np.exp(-np.clip(weight(at).sum(), -30, 30)))
            step(at, np.full(len(at), p - label))
            if other is not None and fairness:
                mine, theirs = np.setdiff1d(at[:-1], other), np.setdiff1d(other, at[:-1])
                apart = weight(mine).sum() - weight(theirs).sum()
                step(mine, np.full(len(mine), 2 * fairness * apart))
                step(theirs, np.full(len(theirs), -2 * fairness * apart))
    every = weight(np.arange(size + 1))
    return ToxicityModel(every[:-1].astype(np.float32), float(every[-1]))


def calibrate(model: ToxicityModel, rows: list, rounds: int = 200) -> None:
    """Slope and shift of the logit that fit rows the weights weren't fitted to, by damped Newton steps."""
    if not rows or len({y for y, _, _ in rows}) < 2:
        return
    y = np.array([label for label, _, _ in rows], float)
    raw = np.clip([model.bias + model.weights[at].sum() for _, at, _ in rows], -20, 20)
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    t = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (p - y) + 0.01 * (t - [1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        move = np.linalg.solve(h, g)
        t = t - np.clip(move, -0.5, 0.5)
        if np.abs(move).max() < 1e-6:
            break
    if t[0] > 0:
        model.slope, model.shift = float(t[0]), float(t[1])


def example(text: str, mentions: float, bits: int = BITS, groups=IDENTITY_GROUPS) -> tuple[np.ndarray, np.ndarray | None]:
    """Features of a text, and of its counterfactual; a share ``mentions`` of the texts without identity terms gets one."""
    here = features(text, bits)
    if (swapped := counterfactual(text, groups) if text else None) is not None:
        return here, features(swapped, bits)
    draw = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    if not groups or draw % 1000 >= 1000 * mentions:
        return here, None
    draw //= 1000
    group = groups[draw % len(groups)]
    draw //= len(groups)
    term, other = group[draw % len(group)], group[(draw + 1) % len(group)]
    there = here if draw // len(group) % 2 else np.union1d(here, features(other, bits))
    return np.union1d(here, features(term, bits)), there


def _examples(mentions: float, bits: int, groups):
    def run(batches):
        for batch in batches:
            made = [example(t or "", mentions, bits, groups) for t in batch.column(0).to_pylist()]
            here, there = ([None if x is None else x.astype("<u4").tobytes() for x in xs] for xs in zip(*made)) if made else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(here, pa.binary()), pa.array(there, pa.binary())], names=["label", "fold", "at", "other"])

    return run


def train_toxicity(
    labelled: DataFrame, sample_rows: int = 12000, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
    alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, fairness: float = 1.0, mentions: float = 0.25, epochs: int = 4, bits: int = BITS, groups=IDENTITY_GROUPS,
) -> ToxicityModel:
    """Fits on about ``sample_rows`` labelled rows chosen by a hash of the identifier; a fifth is kept to calibrate.

    Repeated rows count as often as they occur. A null text is empty. Rows without label are left out. ``mentions`` is the
    share of texts without identity terms that get one. Ties of identifiers go by text and label, so the order of rows doesn't
    matter. Without labelled rows every text scores one half.
    """
    known = labelled.where(F.col(label_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(label_col) > 0).cast("int").alias("label"), F.col(id_col).alias("id"))
    total = known.select("id", "label").count()
    if not total:
        return ToxicityModel(np.zeros(1 << bits, np.float32), 0.0)
    part = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000))
    chosen = known.where(part < int(1_000_000 * min(1.0, sample_rows / total)) + 1)
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(5)).cast("int").alias("fold")
    coded = chosen.select("text", "label", fold, "id").orderBy("id", "text", "label").drop("id").mapInArrow(_examples(mentions, bits, groups), "label int, fold int, at binary, other binary")
    made, folds = [], []
    for r in coded.toLocalIterator():
        made.append((r.label, np.frombuffer(r.at, "<u4").astype(np.int32), None if r.other is None else np.frombuffer(r.other, "<u4").astype(np.int32)))
        folds.append(r.fold)
    kept = [m for m, f in zip(made, folds) if f] or made
    model = fit(kept, 1 << bits, alpha, beta, l1, l2, fairness, epochs)
    calibrate(model, [m for m, f in zip(made, folds) if not f])
    return model


def toxicity_scorer(spark: SparkSession, model: ToxicityModel, bits: int = BITS):
    """A function of a text column that gives its score; only the text goes to Python, a row's other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** bits weights

    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py(), bits) for t in texts], pa.float64())

    # Called nondeterministic so that a filter on the score isn't moved below it, which would score texts twice.
    return F.arrow_udf(score, DoubleType()).asNondeterministic()


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, keep: bool = False) -> DataFrame:
    """For every document: (id, score, predicted), or with ``keep`` all its columns and these, in place of any of that name.

    Empty and null texts get the score of a text without words. Rows that repeat others stay rows of their own, and equal
    texts score alike.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")] if keep else [F.col(id_col).cast("long").alias(id_col)]
    scored = docs.select(*kept, toxicity_scorer(docs.sparkSession, model, bits)(F.col(text_col)).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
