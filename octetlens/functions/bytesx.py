"""Column functions over byte strings, seen as characters U+0000..U+00FF so that regular expressions work on bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Byte order marks in the order they are looked for: longer before what they begin with. Fixed values.
BOMS = [
    ("EFBBBF", "UTF-8-SIG"),
    ("FFFE0000", "UTF-32"),
    ("0000FEFF", "UTF-32"),
    ("FEFF0000", "X-ISO-10646-UCS-4-3412"),
    ("0000FFFE", "X-ISO-10646-UCS-4-2143"),
    ("FFFE", "UTF-16"),
    ("FEFF", "UTF-16"),
]
PURE_ASCII, ESC_ASCII, HIGH_BYTE = "PURE_ASCII", "ESC_ASCII", "HIGH_BYTE"
RESULT = "struct<encoding:string,confidence:double,language:string>"


def require_binary(df: DataFrame, column: str) -> None:
    """Raises when a plan is built over a column that isn't BINARY; text has no encoding to detect."""
    if not isinstance(df.schema[column].dataType, BinaryType):
        raise TypeError(f"Expected a BINARY column, but {column} is {df.schema[column].dataType.simpleString()}; cast it first")


def latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def result(encoding: Column | str | None, confidence: float | Column, language: str | None = "") -> Column:
    name = F.lit(encoding) if encoding is None or isinstance(encoding, str) else encoding
    value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(name.cast("string").alias("encoding"), value.cast("double").alias("confidence"), F.lit(language).cast("string").alias("language"))


def bom_encoding(content: Column) -> Column:
    """Encoding named by a byte order mark; null without one."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for mark, name in BOMS:
        out = out.when(F.substring(content, 1, len(mark) // 2) == F.lit(bytes.fromhex(mark)), F.lit(name))
    return out


def has_high_byte(l: Column) -> Column:  # noqa: E741
    return l.rlike(r"[\x80-\xff]")


def has_escape(l: Column) -> Column:  # noqa: E741
    return l.rlike(r"\x1b|~\{")


def has_win_bytes(l: Column) -> Column:  # noqa: E741
    return l.rlike(r"[\x80-\x9f]")


def input_state(l: Column) -> Column:  # noqa: E741
    return F.when(has_high_byte(l), HIGH_BYTE).when(has_escape(l), ESC_ASCII).otherwise(PURE_ASCII)


def high_byte_only(l: Column) -> Column:  # noqa: E741
    """Each run of ASCII becomes one space."""
    return F.regexp_replace(l, r"[\x00-\x7f]+", " ")


WORD = r"[a-zA-Z]*[\x80-\xff]+[a-zA-Z]*[^a-zA-Z\x80-\xff]?"


def international_words(l: Column) -> Column:  # noqa: E741
    """Words with a high byte, each with what ends it as a space."""
    words = F.regexp_extract_all(l, F.lit(WORD), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"[^a-zA-Z\x80-\xff]\z", " ")), "")


def strip_tags(l: Column) -> Column:  # noqa: E741
    """What stands outside of <...>, each stretch before a tag with a space; text before a stray > and after an open < goes."""
    kept = F.regexp_extract_all(l, F.lit(r"(?:(?<=>)|\A)([^<>]+)(?=<)"), F.lit(1))
    return F.concat(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit(" "))), ""), F.regexp_extract(l, r"(?:(?<=>)|\A)([^<>]*)\z", 1))
