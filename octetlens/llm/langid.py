"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training documents. The classifier is fitted on a bounded sample of them by
follow-the-regularised-leader with elastic-net penalties, then a temperature is fitted on a part kept aside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

ORDERS = (1, 2, 3)
BITS = 15
#: Characters that are looked at at once.
_SEGMENT = 1 << 20
#: Label of texts without letters.
UNDETERMINED = "und"


def ngram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased text, and how often each occurs."""
    every = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(1 << bits, np.int64)
    with np.errstate(over="ignore"):
        # Segments overlap by what the longest n-gram reaches over their end.
        for at in range(0, len(every), _SEGMENT):
            c = every[at : at + _SEGMENT + ORDERS[-1] - 1].astype(np.uint64)
            for n in ORDERS:
                size = min(_SEGMENT, len(c) - n + 1)
                if size < 1:
                    break
                h = np.full(size, n, np.uint64)
                for k in range(n):
                    h = (h ^ c[k : size + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                counts += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _frequencies(bits: int):
    def run(batches):
        seen, docs = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen[ngram_counts(text.as_py() or "", bits)[0]] += 1
                docs += 1
        if docs:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(docs, seen[at]))], names=["feature", "n"])

    return run


def _examples(bits: int):
    def run(batches):
        for batch in batches:
            pairs = [ngram_counts(t or "", bits) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([a.astype("<u4").tobytes() for a, _ in pairs], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in pairs], pa.binary())],
                names=["label", "fold", "at", "n"],
            )

    return run


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x labels, sparse in content
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.features(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None, bits: int = BITS) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.labels:
            return UNDETERMINED, 0.0
        z = self.logits(*ngram_counts(text, bits)) / self.temperature
        p = np.exp(z - z.max())
        return self.labels[int(z.argmax())], float(p.max() / p.sum())


def fit_ftrl(rows: list, labels: list[str], idf: np.ndarray, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> LanguageModel:
    """Follow-the-regularised-leader; a weight is zero while its sum of gradients stays within ``l1``."""
    size, k = len(idf), len(labels)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    model = LanguageModel(labels, idf, np.zeros((size, k)), np.zeros(k))
    rng = np.random.Generator(np.random.PCG64(3))

    def weight(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, count = rows[i]
            at, x = np.append(at, size), np.append(model.features(at, count), 1.0)
            w = weight(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            n2 = n[at] + g * g
            z[at] += g - (np.sqrt(n2) - np.sqrt(n[at])) / alpha * w
            n[at] = n2
    every = weight(np.arange(size + 1))
    model.weights, model.bias = every[:-1], every[-1]
    return model


def calibrate(model: LanguageModel, rows: list) -> None:
    """Temperature of least log loss on rows the weights weren't fitted to."""
    if not rows:
        return
    z, y = np.array([model.logits(at, n) for _, at, n in rows]), np.array([label for label, _, _ in rows])

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))


def train_language_model(
    docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4, epochs: int = 3, bits: int = BITS,
) -> LanguageModel:
    """Fits on rows where ``train`` holds and the language is known.

    Document frequencies come from all of them; the weights from about ``sample_rows`` distinct texts, shared out evenly among
    the languages and chosen by a hash of text and language, so that a rare language is learnt from all its rows. A fifth
    is kept for the temperature, but for languages that have no other row. Rows that are equal in text and language count
    once in the fit; a text of several languages is an example of each. The order of rows doesn't matter. A null text is
    empty. A text of any length is counted in segments. Without such rows the model knows no label.
    """
    known = docs.where(train & F.col(lang_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # a row for each language
    total = sum(sizes.values())
    if not total:
        return LanguageModel([], np.zeros(1 << bits), np.zeros((1 << bits, 0)), np.zeros(0))
    counted = known.select("text").mapInArrow(_frequencies(bits), "feature long, n long").groupBy("feature").agg(F.sum("n")).collect()
    df = np.zeros(1 << bits)
    for feature, n in counted:  # a row for each of 2 ** bits features at most
        if feature >= 0:
            df[feature] = n
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0.0)
    draw = F.xxhash64("text", "label")
    share = F.create_map(*[F.lit(y) for x, n in sorted(sizes.items()) for y in (x, int(1_000_000 * min(1.0, sample_rows / len(sizes) / n)) + 1)])
    chosen = known.where(F.pmod(draw, F.lit(1_000_000)) < share[F.col("label")]).dropDuplicates(["text", "label"])
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(5)).cast("int").alias("fold")
    rows = chosen.select("text", "label", fold, draw.alias("draw")).orderBy("draw", "text", "label").drop("draw").mapInArrow(_examples(bits), "label string, fold int, at binary, n binary").collect()
    labels = sorted({r.label for r in rows})
    number = {x: i for i, x in enumerate(labels)}
    made = [(number[r.label], np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r.n, "<u4").astype(float)) for r in rows]
    fitted = {m[0] for m, r in zip(made, rows) if r.fold}
    fit, aside = [m for m, r in zip(made, rows) if r.fold or m[0] not in fitted], [m for m, r in zip(made, rows) if not r.fold and m[0] in fitted]
    model = fit_ftrl(fit, labels, idf, alpha, beta, l1, l2, epochs)
    calibrate(model, aside)
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """For every document: (id, lang_pred, score). A null text, or one without letters, is ``und`` with score 0.

    Equal texts get equal answers; of languages that tie the first by name. Rows that repeat others stay rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits features for each label

    def run(batches):
        for batch in batches:
            out = [shared.value.predict(t.as_py(), bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)
