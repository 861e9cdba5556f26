"""Detection as a plan: what patterns decide stays in the JVM; only undecided rows reach the statistical probers.

Marks, plain ASCII and well-formed UTF-8 are columns of one projection over the scan, without a shuffle. Other rows go to
the probers in Arrow batches of the same stage; decided rows cross as nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytesx as B
from ..functions import grammar as G
from ..operators.detector import ALL, Detector
from ..operators.models import Pack, builtin_pack
from ..shipping import ship

RESULT = B.RESULT
#: Behind a mark the encoding is certain; from this many longer characters on, UTF-8 is.
UTF8_ENOUGH = 5


def utf8_chars(l: Column) -> Column:  # noqa: E741
    """Characters of two bytes or more in the legal beginning."""
    return F.regexp_count(G.legal_prefix(l, "utf-8"), F.lit(G.GRAMMAR["utf-8"][1]))


def utf8_confidence(n: Column) -> Column:
    return F.when(n < 6, F.lit(1.0) - F.lit(0.99) * F.pow(F.lit(0.5), n.cast("double"))).otherwise(F.lit(0.99))


def decided(content: Column) -> Column:
    """The answer where patterns alone give it, else null: no bytes, a mark, ASCII, or sure UTF-8."""
    l = B.latin(content)  # noqa: E741
    bom = B.bom_encoding(content)
    # Zero bytes may mean UTF-16 or UTF-32, which is looked at before anything but marks.
    wide = l.contains("\x00")
    return (
        F.when(content.isNull() | (F.length(content) == 0), B.result(None, 0.0, None))
        .when(bom.isNotNull(), B.result(bom, 1.0))
        .when(wide, F.lit(None).cast(RESULT))
        .when(~B.has_high_byte(l) & ~B.has_escape(l), B.result("ascii", 1.0))
        .when(B.has_high_byte(l) & ~G.illegal(l, "utf-8") & (utf8_chars(l) >= UTF8_ENOUGH), B.result("utf-8", 0.99))
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


#: Documents whose rows are returned at once.
_DOCUMENTS = 200
_RESULT = pa.struct([("encoding", pa.string()), ("confidence", pa.float64()), ("language", pa.string())])


def _answers(answer, kind: pa.DataType):
    """A column function of byte strings: one at a time is taken out of its Arrow batch, and only answers are kept."""

    def run(batches):
        for contents in batches:
            yield pa.array((answer(x.as_py()) for x in contents), kind, size=len(contents))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT if kind == _RESULT else f"array<{RESULT}>")


def _struct(found: tuple) -> dict:
    return dict(zip(("encoding", "confidence", "language"), found, strict=True))


def _probe(pack: Pack, lang_filter: int, rename_legacy: bool):
    def answer(content):
        d = Detector(lang_filter, rename_legacy)
        if content is not None:
            d.feed(content, pack)
        return _struct(d.close(pack))

    return _answers(answer, _RESULT)


def detect(df: DataFrame, content: str = "content", lang_filter: int = ALL, rename_legacy: bool = False, pack: Pack | None = None, into: str = "detected") -> DataFrame:
    """Adds the struct (encoding, confidence, language) of each byte string. A null byte string gives a null struct."""
    B.require_binary(df, content)
    ship(df.sparkSession)
    pack = pack or builtin_pack()
    early, late = unused(df, "early", "late")
    known = df.withColumn(early, decided(F.col(content)))
    probe = _probe(pack, lang_filter, rename_legacy)
    probed = known.withColumn(late, probe(F.when(F.col(early).isNull(), F.col(content))))
    answer = F.when(F.col(content).isNull(), F.lit(None).cast(RESULT)).otherwise(F.coalesce(early, late))
    return probed.withColumn(into, answer).drop(early, late)


def detect_all(df: DataFrame, content: str = "content", ignore_threshold: bool = False, rename_legacy: bool = False, pack: Pack | None = None, into: str = "candidates") -> DataFrame:
    """Adds the array of all candidates above the threshold, best first; the one answer where there are none.

    Null only for a null byte string. Take them apart with ``explode_outer``: for ``explode`` the optimiser adds a filter
    that has the probers run again.
    """
    B.require_binary(df, content)
    ship(df.sparkSession)
    pack = pack or builtin_pack()

    def answer(content):
        if content is None:
            return None
        d = Detector(ALL, rename_legacy)
        d.feed(content, pack)
        d.close(pack)
        return [_struct(x) for x in d.candidates(pack, ignore_threshold)]

    early, every = unused(df, "early", "every")
    known = df.withColumn(early, decided(F.col(content)))
    # Sure UTF-8 is an answer, but its other candidates have to be counted.
    needs = F.col(early).isNull() | (F.col(early)["encoding"] == "utf-8")
    found = known.withColumn(every, _answers(answer, pa.list_(_RESULT))(F.when(needs, F.col(content))))
    return found.withColumn(into, F.when(F.col(content).isNotNull(), F.coalesce(every, F.array(early)))).drop(early, every)


def detect_lines(df: DataFrame, content: str = "content", rename_legacy: bool = False, pack: Pack | None = None, into: str = "detected") -> DataFrame:
    """Adds the struct as ``detect`` does, but of contents read line by line and no further than needed.

    Each line, with its line feed, is a chunk of its own, so that the answer can differ from that of one feed. A null byte
    string gives a null struct. A row is a document, whatever other columns repeat, and nothing is shuffled.
    """
    B.require_binary(df, content)
    ship(df.sparkSession)
    pack = pack or builtin_pack()

    probe = _answers(lambda x: _struct(by_lines(x or b"", pack, rename_legacy)), _RESULT)
    return df.withColumn(into, F.when(F.col(content).isNotNull(), probe(F.col(content))))


def by_lines(content: bytes, pack: Pack, rename_legacy: bool = False) -> tuple:
    """Answer of a detector that is fed line after line until it is sure."""
    d, at = Detector(ALL, rename_legacy), 0
    while at < len(content):
        end = content.find(b"\n", at) + 1 or len(content)
        if d.feed(content[at:end], pack):
            break
        at = end
    return d.close(pack)


def _explain(pack: Pack):
    names = ["id", "grp", "rank", "charset", "language", "state", "confidence"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCUMENTS):
                rows = []
                for i, content_ in zip(*batch.slice(at, _DOCUMENTS).columns):
                    if not content_.is_valid:
                        continue
                    d, i = Detector(), i.as_py()
                    d.feed(content_.as_py(), pack)
                    rows += [(i, r.group, r.rank, r.charset, r.language, r.state, r.confidence) for r in (d.high.rows(pack) if d.high else [])]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return run


def explain_probers(df: DataFrame, id_col: str, content: str = "content", pack: Pack | None = None) -> DataFrame:
    """A row for each document with high bytes and prober: group, rank, charset, language, state, confidence."""
    B.require_binary(df, content)
    ship(df.sparkSession)
    pack = pack or builtin_pack()
    # Rows without high bytes cross as nulls: a filter would have the contents made twice, below it and above.
    high = df.select(F.col(id_col).cast("long").alias("id"), F.when(B.has_high_byte(B.latin(F.col(content))), F.col(content)).alias("content"))

    return high.mapInArrow(_explain(pack), "id long, grp string, rank int, charset string, language string, state string, confidence double").withColumnRenamed("id", id_col)
