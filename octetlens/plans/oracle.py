"""Detection in DuckDB's SQL: what the registered queries over statistical probers are held against.

The statement follows the rules of one-shot detection from the characters U+0000..U+00FF that stand for bytes, with the pack's
tables as values; it shares patterns and tables with the engine, but neither its prober code nor its plans. Two things that
the test tables don't hold are left out: zero bytes, so UTF-16 and UTF-32 without mark, and five pairs of kana in a row.
"""

from __future__ import annotations

import numpy as np

from ..functions import grammar as G
from ..functions.bytesx import BOMS
from ..functions.renames import ISO_TO_WINDOWS
from ..operators.models import MULTI_BYTE, Pack, builtin_pack
from ..operators.probers import LANGUAGES, johab_counted
from .western import western_sql

#: A text's UTF-8 bytes as characters.
UTF8_VIEW = "array_to_string(list_transform(regexp_extract_all(hex(encode(coalesce({0}, ''))), '..'), lambda x: chr(('0x' || x)::INT)), '')"
#: A text's ISO-8859-1 bytes as characters.
LATIN_VIEW = r"regexp_replace(coalesce({0}, ''), '[^\x00-\xff]', '?', 'g')"
#: Which two-byte characters count, by lead a and trail b. Fixed values.
_COUNTED = {
    "SHIFT_JIS": "(a BETWEEN 129 AND 159 OR a BETWEEN 224 AND 239) AND b <= 127",
    "EUC-JP": "a >= 161",
    "GB2312": "a >= 176 AND b >= 161",
    "EUC-KR": "a >= 176",
    "CP949": "a >= 176 AND 94 * (a - 176) + b - 161 >= 0",
    "Big5": "a >= 164",
    "EUC-TW": "a >= 196",
    "Johab": "a * 256 + b IN (SELECT pair FROM johab)",
}
_FINAL, _OTHER = r"[\xea\xed\xef\xf3\xf5]", r"[\xeb\xee\xf0\xf4]"
_BAD = r"\x00\x1b\x80-\xff"
_ESCAPES = [
    ("HZ-GB-2312", "Chinese", rf"^(?:[^~{_BAD}]|~~)*~\{{(?:~[^\}}{_BAD}]|[^~{_BAD}][^{_BAD}])*~\}}"),
    ("ISO-2022-JP", "Japanese", rf"^[^\x0e\x0f{_BAD}]*\x1b(?:\$[@B]|\$\(D|\([BIJ])"),
    ("ISO-2022-KR", "Korean", rf"^[^{_BAD}]*\x1b\$\)C"),
]


def _number(x: float) -> str:
    return repr(float(x)) + ("" if "e" in repr(float(x)) else "e0")


def _multi_byte(pack: Pack) -> str:
    """CTEs up to ``mb``: (id, k, charset, language, state, confidence) of each multi-byte prober, as if every one were fed."""
    parts = []
    for k, (charset, (one, more)) in enumerate(G.GRAMMAR.items()):
        cut = G.cut_pattern(charset)
        hit = "false"
        if charset == "GB2312":
            units = [r"[\x81-\xfe]", r"[\x30-\x39]", r"[\x81-\xfe]"]
            cut += "|" + "|".join("".join(units[:n]) for n in (1, 2, 3))
            hit = f"regexp_matches(rest, '^(?:{G.GB_FOUR})')"
        parts.append(
            f"SELECT id, {k} AS k, '{charset}' AS cs, regexp_extract_all(p, '{more}') AS toks, rest <> '' AND NOT regexp_full_match(rest, '{cut}') AS dead, {hit} AS hit "
            f"FROM (SELECT id, p, substr(b, length(p) + 1) AS rest FROM (SELECT id, b, regexp_extract(b, '^(?:{one}|{more})*') AS p FROM hi))"
        )
    often = ", ".join(f"('{c}', {a * 256 + b})" for c in MULTI_BYTE for a, b in sorted(pack.frequent[c])) or "('', -1)"
    johab = ", ".join(f"({x})" for x in sorted(np.flatnonzero(johab_counted()).tolist()))
    ratios = " ".join(f"WHEN '{c}' THEN {_number(pack.ratio[c])}" for c in MULTI_BYTE)
    languages = " ".join(f"WHEN '{c}' THEN '{x}'" for c, x in LANGUAGES.items())
    counted = " ".join(f"WHEN '{c}' THEN {rule}" for c, rule in _COUNTED.items())
    return f"""
johab(pair) AS (VALUES {johab}),
often(cs, pair) AS (VALUES {often}),
pre AS ({" UNION ALL ".join(parts)}),
tok AS (SELECT id, k, cs, ascii(t[1]) AS a, ascii(t[2]) AS b, count(*) AS n FROM (SELECT id, k, cs, unnest(toks) AS t FROM pre WHERE k > 0) WHERE length(t) = 2 GROUP BY ALL),
cnt AS (SELECT id, k, sum(n) FILTER (ok) AS total, sum(n) FILTER (ok AND pair IS NOT NULL) AS freq, bool_or(a = 135 OR a BETWEEN 250 AND 252) AS win
  FROM (SELECT tok.*, often.pair, CASE tok.cs {counted} END AS ok FROM tok LEFT JOIN often ON often.cs = tok.cs AND often.pair = a * 256 + b) GROUP BY id, k),
own AS (SELECT pre.id, pre.k, pre.cs, dead, hit, win, coalesce(total, 0) AS total, coalesce(freq, 0) AS freq, len(toks) AS n, CASE pre.cs {ratios} END AS ratio FROM pre LEFT JOIN cnt USING (id, k)),
conf AS (SELECT *, CASE WHEN k = 0 THEN CASE WHEN n < 6 THEN 1e0 - 0.99e0 * pow(0.5e0, n) ELSE 0.99e0 END
  WHEN total <= 0 OR freq <= 3 THEN 0.01e0 WHEN total = freq THEN 0.99e0 ELSE least(freq / ((total - freq) * ratio), 0.99e0) END AS c FROM own),
mb AS (SELECT id, k, CASE WHEN k = 0 THEN 'utf-8' WHEN cs = 'SHIFT_JIS' AND win THEN 'CP932' ELSE cs END AS charset, CASE WHEN k = 0 THEN '' ELSE CASE cs {languages} END END AS language,
  CASE WHEN hit THEN 'FOUND_IT' WHEN dead THEN 'NOT_ME' WHEN c > 0.95e0 AND (k = 0 OR cs NOT IN ('SHIFT_JIS', 'EUC-JP') AND total > 1024) THEN 'FOUND_IT' ELSE 'DETECTING' END AS state, c AS confidence FROM conf)"""


def _single_byte(pack: Pack) -> str:
    """CTEs up to ``sb``: the same of single-byte probers; k counts on behind the multi-byte ones, 21 names Hebrew."""
    rows = []
    for k, m in enumerate(pack.single):
        often = np.flatnonzero(m.is_freq)
        place = np.full(256, 999)
        place[often] = np.arange(len(often))
        cells = "".join(map(str, m.category[np.ix_(often, often)].ravel().tolist()))
        fixed = f"'{m.charset}', '{m.language}', {_number(m.ratio)}, {str(m.keep_ascii).lower()}, '{''.join('01'[int(x)] for x in m.is_char)}', '{''.join(f'{x:03}' for x in place)}', {len(often)}, '{cells}'"
        rows.append(f"({9 + k if k < 12 else 22}, false, {fixed})")
        if k == 12:
            rows.append(f"(23, true, {fixed})")
    word = r"[a-zA-Z]*[\x80-\xff]+[a-zA-Z]*[^a-zA-Z\x80-\xff]?"
    return rf"""
models(k, back, cs, language, ratio, tags, letters, places, size, cells) AS (VALUES {", ".join(rows)}),
streams AS (SELECT id, false AS tags, string_split(array_to_string(list_transform(regexp_extract_all(b, '{word}'),
    lambda x: regexp_replace(x, '[^a-zA-Z\x80-\xff]$', ' ')), ''), '') AS ch FROM hi
  UNION ALL SELECT id, true, string_split(t, '') FROM stripped),
units AS (SELECT id, tags, ascii(c) AS a, count(*) AS n FROM (SELECT id, tags, unnest(ch) AS c FROM streams) WHERE c <> '' GROUP BY ALL),
pairs AS (SELECT id, tags, ascii(p[1]) AS a, ascii(p[2]) AS b, count(*) AS n FROM (SELECT id, tags, unnest(list_zip(ch[1:len(ch) - 1], ch[2:])) AS p FROM streams WHERE len(ch) > 1) GROUP BY ALL),
spelt AS (SELECT id, k, sum(n) FILTER (substr(letters, a + 1, 1) = '1') AS chars, sum(n) FILTER (substr(places, 3 * a + 1, 3) <> '999') AS freq FROM units JOIN models USING (tags) GROUP BY id, k),
placed AS (SELECT id, k, n, size, cells, substr(places, 3 * a + 1, 3)::INT AS x, substr(places, 3 * b + 1, 3)::INT AS y, back FROM pairs JOIN models USING (tags)),
kinds AS (SELECT id, k, n, substr(cells, CASE WHEN back THEN y * size + x ELSE x * size + y END + 1, 1) AS kind FROM placed WHERE x < 999 AND y < 999),
seqs AS (SELECT id, k, sum(n) AS total, sum(n) FILTER (kind = '3') AS often, sum(n) FILTER (kind = '2') AS likely FROM kinds GROUP BY id, k),
rate AS (SELECT hi.id, models.k, models.cs, models.language, coalesce(total, 0) AS total, coalesce(chars, 0) AS chars, coalesce(freq, 0) AS freq,
  (coalesce(often, 0) + 0.25e0 * coalesce(likely, 0)) / total / ratio AS r FROM hi CROSS JOIN models LEFT JOIN seqs USING (id, k) LEFT JOIN spelt USING (id, k)),
sure AS (SELECT id, k, cs, language, total, CASE WHEN total = 0 THEN 0.01e0 ELSE least(CASE WHEN chars = 0 THEN 0e0 ELSE r * freq / chars END, 0.99e0) END AS c FROM rate),
sb AS (SELECT id, k, cs AS charset, language, CASE WHEN total > 1024 AND c > 0.95e0 THEN 'FOUND_IT' WHEN total > 1024 AND c < 0.05e0 THEN 'NOT_ME' ELSE 'DETECTING' END AS state, c AS confidence FROM sure
  UNION ALL SELECT id, 21, '', 'Hebrew', 'DETECTING', 0e0 FROM hi),
runs AS (SELECT id, regexp_replace(b, '[\x00-\x7f]+', ' ', 'g') AS h FROM hi),
hebrew AS (SELECT id, len(list_filter(ws[1:len(ws) - 1], lambda x: length(x) >= 2 AND regexp_matches(x, '{_FINAL}$')))
  - len(list_filter(ws[1:len(ws) - 1], lambda x: length(x) >= 2 AND regexp_matches(x, '{_OTHER}$'))) - len(list_filter(ws, lambda x: length(x) >= 2 AND regexp_matches(x, '^{_FINAL}'))) AS score
  FROM (SELECT id, string_split(h, ' ') AS ws FROM runs))"""


def _groups() -> str:
    """CTEs up to ``probers``, with what lies behind the first that found it unfed, and ``best``."""
    iso = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ISO_TO_WINDOWS.items())
    return rf"""
fed AS (SELECT * FROM mb UNION ALL SELECT * FROM sb UNION ALL SELECT * FROM west),
stop AS (SELECT id, min(k) FILTER (state = 'FOUND_IT') AS halt FROM fed GROUP BY id),
probed AS (SELECT id, k, CASE WHEN k < 9 THEN 'mb' WHEN k < 24 THEN 'sb' ELSE charset END AS grp, CASE WHEN k = 1 AND k > halt THEN 'SHIFT_JIS' ELSE charset END AS charset, language,
  CASE WHEN k > halt THEN 'DETECTING' ELSE state END AS state, CASE WHEN k > halt THEN CASE WHEN k = 21 OR k > 23 THEN 0e0 ELSE 0.01e0 END ELSE confidence END AS confidence, halt FROM fed JOIN stop USING (id)),
named AS (SELECT id, CASE WHEN abs(s) >= 5 THEN s > 0 WHEN abs(apart) > 0.01e0 THEN apart > 0 ELSE s >= 0 END AS logical FROM (
  SELECT id, CASE WHEN 21 > any_value(halt) THEN 0 ELSE any_value(score) END AS s, max(confidence) FILTER (k = 22) - max(confidence) FILTER (k = 23) AS apart FROM probed JOIN hebrew USING (id) GROUP BY id)),
probers AS (SELECT id, k AS rank, grp, CASE WHEN k BETWEEN 21 AND 23 THEN CASE WHEN logical THEN 'windows-1255' ELSE 'ISO-8859-8' END ELSE charset END AS charset, language, state, confidence, halt FROM probed JOIN named USING (id)),
members AS (SELECT *, count(*) OVER (PARTITION BY id, grp) AS size, count(*) FILTER (state <> 'NOT_ME') OVER (PARTITION BY id, grp) AS alive FROM probers),
offers AS (SELECT id, grp, charset, language, rank, CASE WHEN state = 'FOUND_IT' AND size > 1 THEN 0.99e0 WHEN alive = 0 AND size > 1 THEN 0.01e0 ELSE confidence END AS c, state = 'FOUND_IT' AS found
  FROM members WHERE rank = halt OR halt IS NULL AND (size = 1 OR state <> 'NOT_ME' AND confidence > 0 OR alive = 0 AND rank IN (8, 23)) ),
winner AS (SELECT DISTINCT ON (id) * FROM offers ORDER BY id, c DESC, rank),
wins AS (SELECT id, regexp_matches(b, '[\x80-\x9f]') AS win FROM hi),
best AS (SELECT id, CASE WHEN win AND NOT found AND starts_with(lower(charset), 'iso-8859') THEN CASE lower(charset) {iso} ELSE charset END ELSE charset END AS encoding, c AS confidence, language
  FROM winner JOIN wins USING (id) WHERE found OR c > 0.2e0)"""


def detection_sql(source: str, select: str, pack: Pack | None = None) -> str:
    """``select`` over the CTEs of detection; ``source`` gives (id, b), identifiers and bytes as characters.

    CTEs to select from: ``src`` as given, ``probers``, ``answers`` (id, encoding, confidence, language), ``candidates`` (with place).
    """
    pack = pack or builtin_pack()
    marks = " ".join(f"WHEN starts_with(b, '{''.join(map(chr, bytes.fromhex(m)))}') THEN '{name}'" for m, name in BOMS if "00" not in m)
    race = ", ".join(f"CASE WHEN regexp_matches(b, '{p}') THEN {{'e': length(regexp_extract(b, '{p}')), 'k': {k}}} END" for k, (_, _, p) in enumerate(_ESCAPES))
    iso = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ISO_TO_WINDOWS.items())
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _, _) in enumerate(_ESCAPES))
    spoken = " ".join(f"WHEN {k} THEN '{x}'" for k, (_, x, _) in enumerate(_ESCAPES))
    return rf"""WITH src AS ({source}),
state AS (SELECT id, b, CASE WHEN b = '' THEN 'NONE' WHEN (CASE {marks} END) IS NOT NULL THEN 'MARK' WHEN regexp_matches(b, '[\x80-\xff]') THEN 'HIGH' WHEN regexp_matches(b, '\x1b|~\{{') THEN 'ESC' ELSE 'ASCII' END AS s FROM src),
hi AS MATERIALIZED (SELECT id, b FROM state WHERE s = 'HIGH'),
{western_sql("hi")},
west AS (SELECT id, 24 AS k, 'ISO-8859-1' AS charset, '' AS language, CASE WHEN bad THEN 'NOT_ME' ELSE 'DETECTING' END AS state, c AS confidence FROM latin1
  UNION ALL SELECT id, 25, 'MacRoman', '', 'DETECTING', c FROM macroman),{_multi_byte(pack)},{_single_byte(pack)},{_groups()},
escapes AS (SELECT id, list_min(list_filter([{race}], lambda x: x IS NOT NULL)).k AS k FROM state WHERE s = 'ESC'),
answers AS (SELECT state.id, CASE s WHEN 'MARK' THEN CASE {marks} END WHEN 'ASCII' THEN 'ascii' WHEN 'ESC' THEN CASE k {names} END WHEN 'HIGH' THEN encoding END AS encoding,
  CASE s WHEN 'MARK' THEN 1e0 WHEN 'ASCII' THEN 1e0 WHEN 'ESC' THEN CASE WHEN k IS NULL THEN 0e0 ELSE 0.99e0 END WHEN 'HIGH' THEN coalesce(confidence, 0e0) ELSE 0e0 END AS confidence,
  CASE s WHEN 'MARK' THEN '' WHEN 'ASCII' THEN '' WHEN 'ESC' THEN CASE k {spoken} END WHEN 'HIGH' THEN language END AS language
  FROM state LEFT JOIN best ON best.id = state.id LEFT JOIN escapes ON escapes.id = state.id),
listed AS (SELECT id, rank, CASE WHEN win AND starts_with(lower(charset), 'iso-8859') THEN CASE lower(charset) {iso} ELSE charset END ELSE charset END AS encoding, confidence, language
  FROM probers JOIN wins USING (id) WHERE confidence > 0.2e0),
candidates AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY confidence DESC, rank) - 1)::INT AS place, encoding, confidence, language FROM listed
  UNION ALL SELECT id, 0, encoding, confidence, language FROM answers WHERE id NOT IN (SELECT id FROM listed))
{select}"""
