"""What work and memory grow with, and that nothing of the answers changes with it."""

import cProfile
import pstats
import random
import tracemalloc

import pyarrow as pa
import pytest
import regex

from octetlens.functions.grammar import GRAMMAR
from octetlens.operators.detector import ALL, Detector
from octetlens.operators.models import builtin_pack
from octetlens.operators.probers import COUNTED, HighByte, MultiByte, layout

DOUBLED = {"euc": bytes(x for c in range(0xA1, 0xD5) for x in (0xB0, c)), "big5": bytes(x for c in b"abcdefghijklmnopqrstuvwxyz" for x in (0xA4, c)), "kana": "ひらがなとことば".encode("euc_jp"), "thai": bytes(range(0xA1, 0xCF)) + b" "}


@pytest.mark.parametrize("name", DOUBLED)
def test_calls_do_not_grow_with_the_text(name):
    """Not a step of Python's for each character, whatever the charset."""

    def calls(times):
        p = cProfile.Profile()
        p.runcall(HighByte().feed, DOUBLED[name] * times, pack)
        return pstats.Stats(p).total_calls

    pack = builtin_pack()
    calls(1000)
    assert calls(2000) < 1.2 * calls(500) < 3000


@pytest.mark.parametrize("charset", [c for c in GRAMMAR if c != "utf-8"])
def test_characters_are_those_of_the_grammar(charset):
    one, more = GRAMMAR[charset]
    char, random_ = regex.compile(f"(?:{one}|{more})".encode()), random.Random(charset)
    kinds = [range(256), range(0xA1, 0xFF), [0x8E, 0x8F, 0xA1, 0xA2, 0xA4, 0xA7, 0xC4, 0xDF], [*range(0x81, 0xFF), 0x41, 0x61], [0x80, 0x85, 0x87, 0xCA, 0xE0, 0x41]]
    for n in [1, 2, 3, 5, 9, 30, 257, 600] * 60:
        data = bytes(random_.choices(kinds[n % 5], k=n))
        at, want = 0, []
        while m := char.match(data, at):
            want.append((at, m.end() - at))
            at = m.end()
        _, end, starts, sizes = layout(charset).split(data)
        assert (end, list(zip(starts.tolist(), sizes.tolist()))) == (at, want)
        prober = MultiByte(charset)
        prober.feed(data, builtin_pack())
        assert prober.total == sum(bool(COUNTED[charset](*map(int, data[i : i + 2]))) for i, size in want if size == 2)


def test_rows_of_probers_come_in_bounded_batches():
    from octetlens.plans.detect import _explain

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([b"caf\xe9"] * 1999 + [None], pa.binary())], names=["id", "content"])
    out = list(_explain(builtin_pack())([batch]))
    assert sum(b.num_rows for b in out) == 1999 * 26 and max(b.num_rows for b in out) <= 200 * 26


def test_contents_are_taken_one_at_a_time(spark):
    """A worker holds its batch and one text, not a second batch of Python's objects."""
    from octetlens.plans.detect import _probe

    contents = pa.array([b"caf\xe9 \x1b" * 40000] * 50 + [None], pa.binary())
    probe = _probe(builtin_pack(), ALL, False).func
    list(probe([contents[:1]]))
    tracemalloc.start()
    try:
        found = pa.concat_arrays(probe([contents]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    d = Detector()
    d.feed(contents[0].as_py(), builtin_pack())
    assert peak < contents.nbytes / 2 and tuple(found[0].as_py().values()) == d.close(builtin_pack()) and found[50].as_py()["encoding"] is None


def _odd_contents():
    random_ = random.Random(7)
    kinds = [range(256), range(0xA1, 0xFF), [0x8F, 0xA4, 0xA1, 0xA7, 0xDF, 0x41], [*range(0xE0, 0xFB), *b" <>a."], [0xCA, 0xCA, 0x9F, 0xD0, 0x85, 0x41], [*b"~{}$B\x1b()CJa"], b"<>ab \xe9"]
    yield from (b"", b"a", b"\xef\xbb", b"\xef\xbb\xbf", b"\x1b$B", b"~{VPND~}", b"a" * 300 + b"\x1b$)C", b"<a>caf\xe9<", "текст ".encode("utf-16le") * 9, "ひらがな、".encode("euc_jp") * 90, b"x\xe9" + b"y" * 500)
    for k in range(28):
        yield bytes(random_.choices(kinds[k % 7], k=[3, 40, 300, 1200][k // 7]))
        yield ("".join(random_.choices("ひらがなのことば漢字、 \na", k=300))).encode(["shift_jis", "euc_jp", "utf-16be", "utf-8"][k % 4])


@pytest.mark.parametrize("size", [1, 7, 256])
def test_pieces_give_the_answer_of_one_feed(size):
    from octetlens.operators.whole import detect_whole, probe_whole

    pack = builtin_pack()
    for content in (x for x in _odd_contents() if len(x) <= 64 * size):
        pieces = [content[i : i + size] for i in range(0, len(content), size)]
        d = Detector()
        d.feed(content, pack)
        assert detect_whole(lambda: iter(pieces), pack) == d.close(pack)
        if d.high and not d.high.found:
            assert probe_whole(pieces, pack).rows(pack) == d.high.rows(pack)


def test_files_are_not_held(spark, tmp_path):
    from octetlens.sources.files import detect_files

    part = bytes(random.Random(3).choices(range(256), k=1 << 20))
    (tmp_path / "large").write_bytes(part * 24)
    (tmp_path / "_hidden").write_bytes(part * 2)
    limit = spark.conf.get("spark.sql.sources.binaryFile.maxLength", None)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1 << 20)  # no file may be one row
    try:
        found = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in detect_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit or str((1 << 31) - 1))
    want = {}
    for name, times in (("large", 24), ("_hidden", 2)):
        d = Detector()
        d.feed(part * times, builtin_pack())
        want[name] = d.close(builtin_pack())
    assert found == want


def test_files_behind_a_mount_table(spark, tmp_path):
    """A store that only Spark's readers know: the same answers as in place."""
    from octetlens.sources.files import detect_files

    for name, content in {"in/a": b"plain", "in/more/b": b"caf\xe9 " * 400000, "in/c": b"", "in/d": b"\xef\xbb\xbfx"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.mounted.link./in", f"file://{tmp_path}/in")
    found = [{r.path.split("/in/")[1]: tuple(r)[1:] for r in detect_files(spark, path, recursive=True).collect()} for path in ("viewfs://mounted/in", str(tmp_path / "in"))]
    assert found[0] == found[1] and found[0]["a"][0] == "ascii" and len(found[0]) == 4
