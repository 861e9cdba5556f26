"""Detection of documents that arrive in chunks: a stateful operator of Structured Streaming.

State is one detector for each document. Chunks of a batch are fed in the order of ``seq``; the row that is marked last, or
a time-out if one is set, closes the document and emits its answer. Chunk boundaries matter: see Detector.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.detector import ALL, Detector
from ..operators.models import Pack, builtin_pack
from ..shipping import ship

ANSWER = "doc_id long, encoding string, confidence double, language string, n_chunks long"


def _step(pack: Pack, lang_filter: int, rename_legacy: bool, timeout_ms: int | None):
    def step(key, frames, state: GroupState):
        detector, n = (pickle.loads(state.get[0]), state.get[1]) if state.exists else (Detector(lang_filter, rename_legacy), 0)
        last = state.hasTimedOut
        if not last:
            for pdf in [pd.concat(list(frames))]:
                pdf = pdf.sort_values("seq")
                for chunk, end in zip(pdf["chunk"], pdf["is_last"]):
                    detector.feed(bytes(chunk) if chunk is not None else b"", pack)
                    n += 1
                    last |= bool(end)
        if last:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], *detector.close(pack), n)], columns=["doc_id", "encoding", "confidence", "language", "n_chunks"])
            return
        state.update((pickle.dumps(detector), n))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([], columns=["doc_id", "encoding", "confidence", "language", "n_chunks"])

    return step


def detect_stream(chunks: DataFrame, lang_filter: int = ALL, rename_legacy: bool = False, pack: Pack | None = None, timeout_ms: int | None = None) -> DataFrame:
    """Of a stream (doc_id, seq, chunk, is_last): one row for each closed document.

    With ``timeout_ms`` a document that gets no chunk for so long is closed too; the query then never runs out of work.
    """
    ship(chunks.sparkSession)
    pack = pack or builtin_pack()
    picked = chunks.select(F.col("doc_id").cast("long"), "seq", "chunk", "is_last")
    return picked.groupBy("doc_id").applyInPandasWithState(_step(pack, lang_filter, rename_legacy, timeout_ms), ANSWER, "detector binary, n long", "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def detect_chunks(chunks: DataFrame, lang_filter: int = ALL, rename_legacy: bool = False, pack: Pack | None = None) -> DataFrame:
    """The same of a finished table (doc_id, seq, chunk): a document is bounded by its own size."""
    ship(chunks.sparkSession)
    pack = pack or builtin_pack()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, n = Detector(lang_filter, rename_legacy), 0
        for chunk in pdf.sort_values("seq")["chunk"]:
            n += 1
            if d.feed(bytes(chunk) if chunk is not None else b"", pack):
                break
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *d.close(pack), n)], columns=["doc_id", "encoding", "confidence", "language", "n_chunks"])

    return chunks.select(F.col("doc_id").cast("long"), "seq", "chunk").groupBy("doc_id").applyInPandas(run, ANSWER)
