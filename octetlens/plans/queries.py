"""Registered queries of the detector and the same in DuckDB's SQL.

DuckDB sees the texts; its hex digits stand for UTF-8 bytes. Where a query works on ISO-8859-1 bytes, the texts' characters
up to U+00FF are these bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytesx as B
from ..functions import grammar as G
from ..functions.languages import LANGUAGES, catalogue
from ..functions.renames import ISO_TO_WINDOWS, LEGACY, renamed
from ..operators.classes import class_model, latin1_classes, macroman_classes
from ..operators.training import count_units, rank_pairs
from ..shipping import read_table
from ..sources.files import detect_files, report
from ..streaming.incremental import detect_chunks
from .counts import count_bytes, count_tokens
from .detect import detect, detect_all, explain_probers, utf8_chars, utf8_confidence
from .oracle import LATIN_VIEW, UTF8_VIEW, detection_sql
from .western import western_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _utf8(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *more, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("content"))


def _latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO-8859-1 bytes of texts that have them; other characters become question marks."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\xff]", "?")
    return _docs(spark, sf_dir).select("doc_id", F.encode(text, "ISO-8859-1").alias("content"))


def L():  # noqa: N802
    return B.latin(F.col("content"))


_TEXT = LATIN_VIEW.format("text")
#: What a text's UTF-8 bytes hold before the first that the grammar refuses.
_LEGAL = r"regexp_extract(coalesce(text, ''), '^[^\x0e\x0f\x1b\x{10000}-\x{1FFFF}]*')"
_MB = rf"length(regexp_replace({_LEGAL}, '[\x00-\x7f]', '', 'g'))"
_CONF = f"CASE WHEN {_MB} < 6 THEN 1e0 - 0.99e0 * pow(0.5e0, {_MB}) ELSE 0.99e0 END"


def _answers(source: str, name: str = "doc_id") -> str:
    return detection_sql(source, f"SELECT id AS {name}, encoding, confidence, language FROM answers")


_UTF8_DOCS = f"SELECT doc_id AS id, {UTF8_VIEW.format('text')} AS b FROM documents"
_LATIN_DOCS = f"SELECT doc_id AS id, {_TEXT} AS b FROM documents"


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents")
def q_bytes_len(spark, sf_dir):
    chars = F.length(F.coalesce(F.col("text"), F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), chars.cast("long").alias("n_chars"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^\x00-\x7f]') THEN 'HIGH_BYTE'
WHEN regexp_matches(coalesce(text, ''), '\x1b|~\{') THEN 'ESC_ASCII' ELSE 'PURE_ASCII' END AS input_state FROM documents""")
def q_input_state(spark, sf_dir):
    return _utf8(spark, sf_dir).select("doc_id", B.input_state(L()).alias("input_state"))


@query("SELECT doc_id, regexp_matches(hex(encode(coalesce(text, ''))), '^(?:[0-9A-F]{2})*[89][0-9A-F]') AS has_win FROM documents")
def q_has_win_bytes(spark, sf_dir):
    return _utf8(spark, sf_dir).select("doc_id", B.has_win_bytes(L()).alias("has_win"))


_MARKED = ["EFBBBF", "FFFE0000", "0000FEFF", "FEFF0000", "0000FFFE", "FFFE", "FEFF"]


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'UTF-8-SIG' WHEN 1 THEN 'UTF-32' WHEN 2 THEN 'UTF-32' WHEN 3 THEN 'X-ISO-10646-UCS-4-3412'
WHEN 4 THEN 'X-ISO-10646-UCS-4-2143' ELSE 'UTF-16' END AS encoding, 1e0 AS confidence, '' AS language FROM documents""")
def q_bom(spark, sf_dir):
    marks = F.array(*[F.lit(bytes.fromhex(m)) for m in _MARKED])
    marked = _utf8(spark, sf_dir).withColumn("content", F.concat(F.get(marks, F.pmod("doc_id", F.lit(7)).cast("int")), "content"))
    return detect(marked).select("doc_id", "detected.*")


@query(f"SELECT doc_id, {_MB}::BIGINT AS n_mb, {_CONF} AS utf8_conf FROM documents")
def q_utf8_mb_chars(spark, sf_dir):
    """Longer characters of the legal beginning."""
    docs = _utf8(spark, sf_dir).select("doc_id", utf8_chars(L()).cast("long").alias("n_mb"))
    return docs.withColumn("utf8_conf", utf8_confidence(F.col("n_mb")))


@query(detection_sql(f"SELECT doc_id AS id, {UTF8_VIEW.format('text')} AS b FROM documents", "SELECT id AS doc_id, lang, a.encoding, a.confidence, a.language FROM answers a JOIN documents ON doc_id = id"))
def q_utf8_detect(spark, sf_dir):
    return detect(_utf8(spark, sf_dir, "lang")).select("doc_id", "lang", "detected.*")


@query(detection_sql(_UTF8_DOCS, "SELECT lang, encoding, count(*)::BIGINT AS n, min(confidence) AS least, max(confidence) AS most FROM answers JOIN documents ON doc_id = id GROUP BY lang, encoding"))
def q_detect_by_lang(spark, sf_dir):
    found = detect(_utf8(spark, sf_dir, "lang")).select("lang", "detected.*")
    return found.groupBy("lang", "encoding").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


_HEX = "WITH h AS (SELECT doc_id, lang, hex(encode(coalesce(text, ''))) AS h FROM documents)"


@query(_HEX + " SELECT byte, count(*)::BIGINT AS cnt FROM (SELECT unnest(regexp_extract_all(h, '..')) AS byte FROM h) GROUP BY byte")
def q_byte_hist(spark, sf_dir):
    return count_bytes(_utf8(spark, sf_dir), 1).select(F.col("unit").alias("byte"), "cnt")


@query(_HEX + """, b AS (SELECT lang, unnest(list_zip(regexp_extract_all(h, '..'), regexp_extract_all(substr(h, 3), '..'))) AS p FROM h),
c AS (SELECT lang, p[1] || p[2] AS pair, count(*)::BIGINT AS cnt FROM b WHERE p[2] IS NOT NULL GROUP BY 1, 2)
SELECT lang, pair, cnt FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, pair) AS rn FROM c) WHERE rn <= 20""")
def q_bigram_top(spark, sf_dir):
    counted = count_bytes(_utf8(spark, sf_dir, "lang"), 2, "lang").select("lang", F.col("unit").alias("pair"), "cnt")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cnt"), "pair"))
    return counted.withColumn("rn", rank).where("rn <= 20").drop("rn")


@query(rf"SELECT doc_id, length(regexp_replace({UTF8_VIEW.format('text')}, '[\x00-\x7f]+', ' ', 'g'))::BIGINT AS n FROM documents")
def q_high_only(spark, sf_dir):
    return _utf8(spark, sf_dir).select("doc_id", F.length(B.high_byte_only(L())).cast("long").alias("n"))


_WORDS_SQL = rf"regexp_extract_all({_TEXT}, '[a-zA-Z]*[\x80-\xff]+[a-zA-Z]*[^a-zA-Z\x80-\xff]?')"


@query(f"SELECT doc_id, len({_WORDS_SQL})::BIGINT AS n_words, coalesce(list_sum(list_transform({_WORDS_SQL}, lambda x: length(x))), 0)::BIGINT AS n_chars FROM documents")
def q_intl_words(spark, sf_dir):
    words = F.regexp_extract_all(L(), F.lit(B.WORD), F.lit(0))
    return _latin(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_words"), F.length(B.international_words(L())).cast("long").alias("n_chars"))


@query("""WITH p AS (SELECT page_id, string_split(coalesce(html, ''), '<') AS parts FROM pages),
s AS (SELECT page_id, list_transform(parts, lambda x: CASE WHEN contains(x, '>') THEN substr(x, length(x) - position('>' IN reverse(x)) + 2) END) AS inner_, parts FROM p)
SELECT page_id, (CASE WHEN len(parts) = 1 THEN length(coalesce(inner_[1], parts[1])) ELSE
  (CASE WHEN length(coalesce(inner_[1], parts[1])) > 0 THEN length(coalesce(inner_[1], parts[1])) + 1 ELSE 0 END)
  + coalesce(list_sum(list_transform(inner_[2:len(parts) - 1], lambda x: CASE WHEN length(x) > 0 THEN length(x) + 1 ELSE 0 END)), 0)
  + coalesce(length(inner_[len(parts)]), 0) END)::BIGINT AS n FROM s""")
def q_strip_tags(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.length(B.strip_tags(F.coalesce("html", F.lit("")))).cast("long").alias("n"))


def _western(spark, sf_dir, classes, prior: int):
    """Confidences from the pairs of classes of a text outside of tags, each class as a character.

    One ``translate`` writes the classes; a pair of low value is what two look-aheads find, and all others have the value 3.
    """
    model = class_model()
    text = F.translate(B.strip_tags(L()), "".join(map(chr, range(256))), "".join(chr(0x30 + int(c)) for c in classes))
    docs = _latin(spark, sf_dir).select("doc_id", F.concat(F.lit("1"), text).alias("c"))

    def pairs(value: int):
        rows = {a: "".join(str(b) for b in range(9) if model[a][b] == value) for a in range(9)}
        return F.regexp_count("c", F.lit("|".join(f"{a}(?=[{then}])" for a, then in rows.items() if then))).cast("double")

    f1, f2 = pairs(1), pairs(2) + F.lit(float(prior))
    total = F.length("c") - 1 + F.lit(float(prior))
    counts = docs.select("doc_id", F.col("c").contains("0").alias("undefined"), f1.alias("f1"), f2.alias("f2"), total.alias("total"))
    c = F.when(F.col("total") >= 1, (F.col("total") - F.col("f1") - F.col("f2") - F.col("f1") * 20.0) / F.col("total")).otherwise(0.0)
    return counts.select("doc_id", F.when(F.col("undefined"), 0.01).otherwise(F.greatest(c, F.lit(0.0)) * 0.73).alias("confidence"))


def _western_sql(name: str) -> str:
    return f"WITH src AS ({_LATIN_DOCS}), {western_sql('src')} SELECT id AS doc_id, c AS confidence FROM {name}"


@query(_western_sql("latin1"))
def q_latin1_conf(spark, sf_dir):
    return _western(spark, sf_dir, latin1_classes(), 0)


@query(_western_sql("macroman"))
def q_macroman_conf(spark, sf_dir):
    return _western(spark, sf_dir, macroman_classes(), 10)


@query(f"WITH src AS ({_LATIN_DOCS}), {western_sql('src')} SELECT id AS doc_id, latin1_before AS before, latin1_class AS class, count(*)::BIGINT AS cnt FROM classes GROUP BY ALL")
def q_latin1_classes(spark, sf_dir):
    """How often each class follows another in a text outside of tags."""
    text = F.translate(B.strip_tags(L()), "".join(map(chr, range(256))), "".join(chr(0x30 + int(c)) for c in latin1_classes()))
    docs = _latin(spark, sf_dir).select("doc_id", F.concat(F.lit("1"), text).alias("c"))
    found = [F.struct(F.lit(a).alias("before"), F.lit(b).alias("class"), F.regexp_count("c", F.lit(f"{a}(?={b})")).cast("long").alias("cnt")) for a in range(8) for b in range(8)]
    return docs.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x["cnt"] > 0)).alias("x")).select("doc_id", "x.*")


def _wide_sql(name: str) -> str:
    """Texts of 20 characters up to U+00FF, none of them U+0000, are sure; of others that hold no zero byte otherwise, as here, detection in general tells."""
    plain = "NOT regexp_matches(coalesce(text, ''), '[^\\x01-\\xff]') AND length(coalesce(text, '')) >= 20"
    return f"SELECT doc_id, encoding, confidence, language FROM ({_answers(_shown_wide(name))}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE {plain}) UNION ALL SELECT doc_id, '{name}', 0.85e0, '' FROM documents WHERE {plain}"


def _shown_wide(name: str) -> str:
    """Bytes of the short texts, as characters: each of theirs with its zero bytes."""
    zeros = "repeat(chr(0), 3)" if "32" in name else "chr(0)"
    each = f"x || {zeros}" if name.endswith("le") else f"{zeros} || x"
    return f"SELECT doc_id AS id, CASE WHEN length(coalesce(text, '')) < 20 THEN array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda x: CASE WHEN x = '' THEN '' ELSE {each} END), '') ELSE '' END AS b FROM documents"


def _wide(charset: str):
    def f(spark, sf_dir):
        return detect(_docs(spark, sf_dir).select("doc_id", F.encode(F.coalesce("text", F.lit("")), charset).alias("content"))).select("doc_id", "detected.*")

    return f


for _name, _charset in (("utf-16le", "UTF-16LE"), ("utf-16be", "UTF-16BE")):
    query(_wide_sql(_name), f"q_utf16_detect_{_name[-2:]}")(_wide(_charset))
query(_wide_sql("utf-32be"), "q_utf32_detect")(_wide("UTF-32"))


_SEQUENCES = ["\x1b$B", "\x1b$)C", "~{VPND~}", "\x1b!"]
_MARKED_TEXT = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SEQUENCES)) + " END"


@query(_answers(f"SELECT doc_id AS id, {_MARKED_TEXT} || {UTF8_VIEW.format('text')} AS b FROM documents"))
def q_esc_detect(spark, sf_dir):
    """Texts behind escape sequences; the last of the four is none. With bytes beyond ASCII they don't matter."""
    marks = F.array(*[F.lit(m.encode()) for m in _SEQUENCES])
    docs = _utf8(spark, sf_dir).select("doc_id", F.concat(F.get(marks, F.pmod("doc_id", F.lit(4)).cast("int")), "content").alias("content"))
    return detect(docs).select("doc_id", "detected.*")


@query(_answers(f"SELECT doc_id AS id, {UTF8_VIEW.format('text')} || chr(27) AS b FROM documents"))
def q_esc_unresolved(spark, sf_dir):
    docs = _utf8(spark, sf_dir).select("doc_id", F.concat("content", F.lit(b"\x1b")).alias("content"))
    return detect(docs).select("doc_id", "detected.*")


def _prefix(charset: str):
    def f(spark, sf_dir):
        return _latin(spark, sf_dir).select("doc_id", F.length(G.legal_prefix(L(), charset)).cast("long").alias("n"))

    return f


for _charset in G.GRAMMAR:
    if _charset != "utf-8":
        _one, _more = G.GRAMMAR[_charset]
        _sql = f"SELECT doc_id, length(regexp_extract({_TEXT}, '^(?:{_one}|{_more})*'))::BIGINT AS n FROM documents"
        query(_sql, "q_legal_prefix_" + _charset.lower().replace("-", "").replace("_", ""))(_prefix(_charset))


def _tokens_sql() -> str:
    parts = []
    for c, (one, more) in G.GRAMMAR.items():
        if c == "utf-8":
            continue
        chars = f"regexp_extract_all(regexp_extract({_TEXT}, '^(?:{one}|{more})*'), '{one}|{more}')"
        parts.append(f"SELECT '{c}' AS charset, hex(encode(token)) AS token FROM (SELECT unnest({chars}) AS token FROM documents) WHERE length(token) = 2")
    return "SELECT charset, token, count(*)::BIGINT AS cnt FROM (" + " UNION ALL ".join(parts) + ") GROUP BY charset, token"


@query(_tokens_sql())
def q_mb_tokens(spark, sf_dir):
    return count_tokens(_latin(spark, sf_dir))


_FINAL, _OTHER = r"[\xea\xed\xef\xf3\xf5]", r"[\xeb\xee\xf0\xf4]"
_RUNS = rf"regexp_replace({_TEXT}, '[\x00-\x7f]+', ' ', 'g')"


@query(rf"""WITH h AS (SELECT doc_id, {_RUNS} AS h FROM documents), w AS (SELECT doc_id, h, string_split(h, ' ') AS ws FROM h)
SELECT doc_id, len(list_filter(ws[1:len(ws) - 1], lambda x: length(x) >= 2 AND regexp_matches(x, '{_FINAL}$')))::BIGINT AS logical,
(len(list_filter(ws[1:len(ws) - 1], lambda x: length(x) >= 2 AND regexp_matches(x, '{_OTHER}$')))
 + len(list_filter(ws, lambda x: length(x) >= 2 AND regexp_matches(x, '^{_FINAL}'))))::BIGINT AS visual FROM w""")
def q_hebrew_scores(spark, sf_dir):
    h = B.high_byte_only(L())
    logical = F.regexp_count(h, F.lit(f"[^ ]{_FINAL} "))
    visual = F.regexp_count(h, F.lit(f"[^ ]{_OTHER} ")) + F.regexp_count(h, F.lit(f"(?<![^ ]){_FINAL}(?=[^ ])"))
    return _latin(spark, sf_dir).select("doc_id", logical.cast("long").alias("logical"), visual.cast("long").alias("visual"))


@query(detection_sql(_UTF8_DOCS, "SELECT id AS doc_id, place, encoding, confidence, language FROM candidates"))
def q_detect_all_utf8(spark, sf_dir):
    each = detect_all(_utf8(spark, sf_dir)).select("doc_id", F.posexplode_outer("candidates").alias("place", "c"))
    return each.select("doc_id", "place", "c.*")


_NAMES = sorted({*ISO_TO_WINDOWS, *LEGACY, "utf-8", "KOI8-R", "Big5", "ISO-8859-15"})


def _case(table: dict, column: str) -> str:
    return "CASE lower(" + column + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


@query(
    "WITH c(name) AS (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + "), w(win) AS (VALUES (true), (false)), "
    f"r AS (SELECT name, win, CASE WHEN win AND starts_with(lower(name), 'iso-8859') THEN {_case(ISO_TO_WINDOWS, 'name')} ELSE name END AS plain FROM c, w) "
    f"SELECT name, win, plain, {_case(LEGACY, 'plain')} AS legacy FROM r"
)
def q_renames(spark, sf_dir):
    names = spark.createDataFrame([(n, w) for n in _NAMES for w in (True, False)], "name string, win boolean")
    return names.select("name", "win", renamed(F.col("name"), F.col("win")).alias("plain"), renamed(F.col("name"), F.col("win"), True).alias("legacy"))


@query(_answers(_UTF8_DOCS))
def q_detect(spark, sf_dir):
    """The flagship: every document's encoding, confidence and language."""
    return detect(_utf8(spark, sf_dir)).select("doc_id", "detected.*")


@query(_answers(_LATIN_DOCS))
def q_detect_latin1(spark, sf_dir):
    return detect(_latin(spark, sf_dir)).select("doc_id", "detected.*")


@query(detection_sql(_LATIN_DOCS, "SELECT id AS doc_id, place, encoding, confidence, language FROM candidates"))
def q_detect_all(spark, sf_dir):
    each = detect_all(_latin(spark, sf_dir)).select("doc_id", F.posexplode_outer("candidates").alias("place", "c"))
    return each.select("doc_id", "place", "c.*")


_SCORES = "SELECT id AS doc_id, grp, rank, charset, language, state, confidence FROM probers"


@query(detection_sql(_LATIN_DOCS, _SCORES))
def q_prober_scores(spark, sf_dir):
    return explain_probers(_latin(spark, sf_dir), "doc_id")


def _recoded(spark: SparkSession, sf_dir: str, charset: str) -> DataFrame:
    """Texts as the letters of another script, by their low bits, in one of its charsets: all bytes beyond ASCII are its letters."""
    letters = _ALPHABETS[charset]
    latin = "".join(chr(c) for c in range(0x41, 0x5B)) + "".join(chr(c) for c in range(0x61, 0x7B))
    to = "".join(letters[i % len(letters)] for i in range(len(latin)))
    return _docs(spark, sf_dir).select("doc_id", F.encode(F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", "?"), latin, to), "ISO-8859-1").alias("content"))


#: Bytes of letters as characters, for texts in other scripts.
_ALPHABETS = {
    "windows-1251": "".join(map(chr, [*range(0xE0, 0x100)])),
    "ISO-8859-7": "".join(map(chr, [*range(0xE1, 0xF2), *range(0xF3, 0xFA)])),
    "TIS-620": "".join(map(chr, range(0xA1, 0xCF))),
    "windows-1255": "".join(map(chr, range(0xE0, 0xFB))),
}
_RECODED = r"translate(regexp_replace(coalesce(text, ''), '[^\x00-\x7f]', '?', 'g'), '{0}', '{1}')"


def _recoded_sql(charset: str) -> str:
    latin = "".join(chr(c) for c in range(0x41, 0x5B)) + "".join(chr(c) for c in range(0x61, 0x7B))
    letters = _ALPHABETS[charset]
    return f"SELECT doc_id AS id, {_RECODED.format(latin, ''.join(letters[i % len(letters)] for i in range(len(latin))))} AS b FROM documents"


def _script(charset: str):
    def f(spark, sf_dir):
        return explain_probers(_recoded(spark, sf_dir, charset), "doc_id")

    return f


for _charset in _ALPHABETS:
    query(detection_sql(_recoded_sql(_charset), _SCORES), "q_scores_" + _charset.lower().replace("-", ""))(_script(_charset))


#: Letters as two-byte characters, for charsets that want a high second byte and for those that take a letter.
_DOUBLED = {"euc": ("".join(map(chr, range(0xA1, 0xA1 + 52))), 0xB0), "big5": ("".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B)]), 0xA4)}


def _double(name: str):
    letters, lead = _DOUBLED[name]
    latin = _DOUBLED["big5"][0]
    sql = f"SELECT doc_id AS id, regexp_replace({_RECODED.format(latin, letters)}, '([{letters}])', chr({lead}) || '\\1', 'g') AS b FROM documents"

    def f(spark, sf_dir):
        plain = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", "?"), latin, letters)
        return explain_probers(_docs(spark, sf_dir).select("doc_id", F.encode(F.regexp_replace(plain, f"([{letters}])", f"{chr(lead)}$1"), "ISO-8859-1").alias("content")), "doc_id")

    query(detection_sql(sql, _SCORES), f"q_scores_{name}")(f)


for _name in _DOUBLED:
    _double(_name)


_CHATS = "(SELECT conv_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("all"))
    return per.select("conv_id", F.array_join(F.transform("all", lambda x: F.concat(x["t"], F.lit("\n"))), "").cast("binary").alias("content"))


@query(_answers(f"SELECT conv_id AS id, {UTF8_VIEW.format('text')} AS b FROM {_CHATS}", "conv_id"))
def q_conversation_detect(spark, sf_dir):
    return detect(_conversations(spark, sf_dir)).select("conv_id", "detected.*")


@query(_answers(f"SELECT page_id AS id, {UTF8_VIEW.format('html')} AS b FROM pages", "page_id"))
def q_page_detect(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("content"))
    return detect(pages).select("page_id", "detected.*")


@query()
def q_stream_chunks(spark, sf_dir):
    """Turns of a conversation as the chunks of a document."""
    turns = read_table(spark, sf_dir, "conversations")
    return detect_chunks(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").cast("binary").alias("chunk")))


@query()
def q_cli_report(spark, sf_dir):
    """A line for each page, whatever its url, as of a file of that name."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return report(pages)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _languages_sql() -> str:
    rows = ", ".join(f"({_quoted(n)}, {_quoted(i)}, {a}, {_quoted(' '.join(c))}, {_quoted(x)})" for n, i, a, c, x, _ in LANGUAGES)
    return f"""(SELECT name, iso_code, use_ascii, charsets, array_to_string(list_sort(list_distinct(regexp_extract_all(
letters || CASE WHEN use_ascii THEN 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' ELSE '' END, '(?s).'))), '') AS alphabet
FROM (VALUES {rows}) v(name, iso_code, use_ascii, charsets, letters))"""


@query(f"SELECT *, length(alphabet)::BIGINT AS n_letters FROM {_languages_sql()}")
def q_languages(spark, sf_dir):
    languages = catalogue(spark).withColumn("charsets", F.array_join("charsets", " "))
    return languages.select("name", "iso_code", "use_ascii", "charsets", "alphabet", F.length("alphabet").cast("long").alias("n_letters"))


_UNITS = rf"""l AS (SELECT DISTINCT iso_code, unnest(regexp_extract_all(lower(alphabet), '(?s).')) AS letter FROM {_languages_sql()}),
w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}ʼ]+')) AS w FROM documents WHERE lang IS NOT NULL),
u AS (SELECT lang, substr(w, i, 1) AS a, substr(w, i + 1, 1) AS b FROM (SELECT lang, w, unnest(range(1, length(w) + 1)) AS i FROM w)),
c AS (SELECT lang, a || coalesce(y.letter, '') AS unit, count(*)::BIGINT AS cnt FROM u JOIN l x ON x.iso_code = lang AND x.letter = a
LEFT JOIN l y ON y.iso_code = lang AND y.letter = b GROUP BY ALL)"""


@query(f"WITH {_UNITS} SELECT lang AS iso_code, unit, cnt FROM c")
def q_letter_units(spark, sf_dir):
    """Letters and pairs of letters by language: what models are trained from."""
    return count_units(_docs(spark, sf_dir))


@query(f"""WITH {_UNITS}, r AS (SELECT lang AS iso_code, unit AS pair, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, unit)::INT AS place FROM c WHERE length(unit) = 2)
SELECT *, CASE WHEN place <= 512 THEN 3 WHEN place <= 1024 THEN 2 ELSE 1 END AS category FROM r""")
def q_pair_ranks(spark, sf_dir):
    return rank_pairs(count_units(_docs(spark, sf_dir)))


@query(detection_sql(_LATIN_DOCS, _SCORES + " WHERE grp = 'sb'"))
def q_sb_scores(spark, sf_dir):
    return explain_probers(_latin(spark, sf_dir), "doc_id").where("grp = 'sb'")


@query(detection_sql(_LATIN_DOCS, _SCORES + " WHERE grp = 'mb'"))
def q_mb_scores(spark, sf_dir):
    return explain_probers(_latin(spark, sf_dir), "doc_id").where("grp = 'mb'")


@query()
def q_detect_files(spark, sf_dir):
    """Every file of the folder as it lies: a Parquet file is no text, but bytes to look at."""
    return detect_files(spark, sf_dir, recursive=True)
