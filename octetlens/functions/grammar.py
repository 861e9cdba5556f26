"""One legal character of each multi-byte charset, as patterns over bytes seen as characters. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_A = r"[\x00-\x0d\x10-\x1a\x1c-\x7f]"
_C = r"[\x80-\xbf]"

#: charset -> (characters of one byte, longer characters)
GRAMMAR = {
    "utf-8": (
        _A,
        rf"[\xc2-\xdf]{_C}|\xe0[\xa0-\xbf]{_C}|[\xe1-\xec\xee\xef]{_C}{{2}}|\xed[\x80-\x9f]{_C}|\xf0[\xa0-\xbf]{_C}{{2}}|[\xf1-\xf7]{_C}{{3}}"
        rf"|\xf8[\x88-\xbf]{_C}{{3}}|[\xf9-\xfb]{_C}{{4}}|\xfc[\x84-\xbf]{_C}{{4}}|\xfd{_C}{{5}}",
    ),
    "SHIFT_JIS": (r"[\x00-\x0d\x10-\x1a\x1c-\x7f\x85\x86\xa0-\xdf]", r"[\x80-\x84\x87-\x9f\xe0-\xec\xf0-\xfc][\x40-\x7e\x80-\xfc]"),
    "EUC-JP": (_A, r"[\xa1-\xfe]{2}|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}"),
    "GB2312": (r"[\x00-\x0d\x10-\x1a\x1c-\x80]", r"[\x81-\xfe][\x40-\x7e\x80-\xfe]"),
    "EUC-KR": (_A, r"[\xa1-\xac\xb0-\xc8\xca-\xfe][\xa1-\xfe]"),
    "CP949": (
        _A,
        r"[\x81-\xac\xb0-\xc5][\x41-\x5a\x61-\x7a\x81-\xfe]|[\xad-\xaf][\x41-\x5a\x61-\x7a\x81-\xa0]|\xc6[\x41-\x52\xa1-\xfe]|[\xc7\xc8\xca-\xfd][\xa1-\xfe]",
    ),
    "Big5": (_A, r"[\xa1-\xfe][\x40-\x7e\x80-\xfe]"),
    "EUC-TW": (_A, r"[\xa1-\xa9\xc2\xc4-\xfe][\xa1-\xfe]|\x8e[\xa2-\xa7][\xa1-\xfe]"),
    "Johab": (_A, r"[\x84-\xd3][\x41-\xfe]|[\xd9-\xde\xe0-\xf9][\x31-\x7e\x91-\xfe]"),
}
#: Behind a legal prefix of GB2312: the four-byte form that settles it.
GB_FOUR = r"[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39]"


def legal_prefix(l: Column, charset: str) -> Column:  # noqa: E741
    """The longest legal beginning; possessive, so that it needs no stack whatever the length."""
    one, more = GRAMMAR[charset]
    return F.regexp_extract(l, rf"\A(?:{one}++|{more})*+", 0)


def two_byte_tokens(prefix: Column, charset: str) -> Column:
    """Longer characters of a legal prefix that have two bytes."""
    found = F.regexp_extract_all(prefix, F.lit(GRAMMAR[charset][1]), F.lit(0))
    return F.filter(found, lambda t: F.length(t) == 2)


def illegal(l: Column, charset: str) -> Column:  # noqa: E741
    """Whether a byte breaks the grammar; a cut last character doesn't."""
    rest = F.substring(l, F.length(legal_prefix(l, charset)) + 1, 1 << 30)
    return (rest != "") & ~rest.rlike(rf"\A(?:{cut_pattern(charset)})\z")


def cut_pattern(charset: str) -> str:
    """Proper beginnings of longer characters, from their alternatives."""
    out = []
    for units in alternatives(charset):
        out += ["".join(units[:k]) for k in range(1, len(units))]
    return "|".join(dict.fromkeys(out))


def alternatives(charset: str) -> list[list[str]]:
    """Longer characters as lists of patterns, one for each byte."""
    import re

    out = []
    for alternative in GRAMMAR[charset][1].split("|"):
        units = []
        for unit, times in re.findall(r"(\[[^\]]*\]|\\x[0-9a-f]{2})(?:\{(\d)\})?", alternative):
            units += [unit] * int(times or 1)
        out.append(units)
    return out
