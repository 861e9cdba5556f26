"""Queries over every row: nothing that patterns leave undecided is left out."""

from collections import Counter

import pytest

from octetlens.operators.detector import Detector
from octetlens.operators.models import builtin_pack
from octetlens.plans.queries import QUERIES

TEXTS = [None, "", "plain", "é", "un été à la mer", "déjà vu, señor: ñandú, Köln", "a\x1bb", "\x1b$B8l", "x ~{VPND~} y", "~{ éàüöß", "\x0eé\x0f", "\U0001d518é", "naïve\x00text", "Größe", "ключ"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    langs = ["fr", "de", None]
    spark.createDataFrame([(i, t, langs[i % 3]) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    turns = [(i, k, "user", x) for i, t in enumerate(TEXTS) for k, x in enumerate((t, "and"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def answer(text, pack):
    d = Detector()
    d.feed((text or "").encode(), pack)
    return d.close(pack)


def test_every_page_document_and_conversation(spark, tables):
    pack = builtin_pack()
    want = {i: answer(t, pack) for i, t in enumerate(TEXTS)}
    assert {r[0]: tuple(r)[1:] for r in QUERIES["q_page_detect"](spark, tables).collect()} == want
    assert {r[0]: tuple(r)[1:] for r in QUERIES["q_detect"](spark, tables).collect()} == want
    chats = {i: answer((t or "") + "\nand\n", pack) for i, t in enumerate(TEXTS)}
    assert {r[0]: tuple(r)[1:] for r in QUERIES["q_conversation_detect"](spark, tables).collect()} == chats
    n = Counter((["fr", "de", None][i % 3], e) for i, (e, _, _) in want.items())
    got = QUERIES["q_detect_by_lang"](spark, tables).collect()
    assert {(r.lang, r.encoding): r.n for r in got} == n and len(got) == len(n)
    for r in got:
        c = [x for i, (e, x, _) in want.items() if (["fr", "de", None][i % 3], e) == (r.lang, r.encoding)]
        assert (r.least, r.most) == (min(c), max(c))


def test_report_of_pages_with_equal_or_null_urls(spark, tmp_path):
    pages = [(1, "u", "plain"), (2, "u", "é\n" * 9), (3, "u", ""), (4, None, "plain"), (5, None, "é\n" * 9), (6, "v", "plain")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["q_cli_report"](spark, str(tmp_path)).collect()
    ascii_, utf8 = "ascii with confidence 1.0", "utf-8 with confidence 0.99"
    want = [("u", f"u: {ascii_}"), ("u", f"u: {utf8}"), ("u", "u: no result"), (None, f"None: {ascii_}"), (None, f"None: {utf8}"), ("v", f"v: {ascii_}")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_every_file_of_the_folder(spark, tmp_path):
    files = {"region.parquet": b"plain", "lineitem.parquet": "é".encode() * 9, "documents.parquet/part-0000.parquet": b"PAR1", "documents.parquet/more/part-0001.parquet": b"\xef\xbb\xbfx", "documents.parquet/_SUCCESS": b"", ".hidden": b"\xff\xfex"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.split(f"{tmp_path}/")[1]: r.encoding for r in QUERIES["q_detect_files"](spark, str(tmp_path)).collect()}
    assert got == dict(zip(files, ["ascii", "utf-8", "ascii", "UTF-8-SIG", None, "UTF-16"]))
