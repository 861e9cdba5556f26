"""Names that replace others. Fixed values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_TO_WINDOWS = {
    "iso-8859-1": "Windows-1252",
    "iso-8859-2": "Windows-1250",
    "iso-8859-5": "Windows-1251",
    "iso-8859-6": "Windows-1256",
    "iso-8859-7": "Windows-1253",
    "iso-8859-8": "Windows-1255",
    "iso-8859-9": "Windows-1254",
    "iso-8859-13": "Windows-1257",
}
LEGACY = {
    "ascii": "Windows-1252",
    "iso-8859-1": "Windows-1252",
    "tis-620": "ISO-8859-11",
    "iso-8859-9": "Windows-1254",
    "gb2312": "GB18030",
    "euc-kr": "CP949",
    "utf-16le": "UTF-16",
}


def _mapped(name: Column, table: dict) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*table.items())])[F.lower(name)], name)


def renamed(name: Column, has_win_bytes: Column, legacy: bool = False) -> Column:
    """A candidate's name: a Windows name where bytes 80-9F were seen, then a superset's if asked."""
    out = F.when(has_win_bytes & F.lower(name).startswith("iso-8859"), _mapped(name, ISO_TO_WINDOWS)).otherwise(name)
    return _mapped(out, LEGACY) if legacy else out


def renamed_value(name: str | None, has_win_bytes: bool, legacy: bool = False) -> str | None:
    if name and has_win_bytes and name.lower().startswith("iso-8859"):
        name = ISO_TO_WINDOWS.get(name.lower(), name)
    return LEGACY.get(name.lower(), name) if name and legacy else name
