from collections import Counter

import pytest

from octetlens.functions.languages import LANGUAGES, catalogue
from octetlens.operators.training import char_ranks, convert_matrix, count_units, model_tables, rank_pairs, train_models

RUSSIAN = "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 3


def test_alphabets_are_sorted_and_distinct(spark):
    rows = catalogue(spark).collect()
    assert len(rows) == len(LANGUAGES) == 31
    for r in rows:
        assert r.alphabet == "".join(sorted(set(r.alphabet))), r.name
        assert not r.use_ascii or "a" in r.alphabet and "Z" in r.alphabet


def test_language_without_letters(spark):
    with pytest.raises(ValueError):
        catalogue(spark, [("None", "xx", False, [], "", [])])


def brute(text, letters):
    out = Counter()
    t = text.lower()
    for i, a in enumerate(t):
        if a in letters:
            b = t[i + 1] if i + 1 < len(t) else ""
            out[a + (b if b in letters else "")] += 1
    return out


def test_units_match_a_loop(spark):
    rows = [("ru", RUSSIAN), ("ru", None), ("ru", ""), (None, RUSSIAN), ("xx", RUSSIAN), ("de", "Größe ж Äpfel"), ("tr", "ışık")]
    got = {(r.iso_code, r.unit): r.cnt for r in count_units(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want = {}
    for code, text in rows:
        for r in catalogue(spark).where(f"iso_code = '{code}'").collect() if text else []:
            want |= {(code, u): n for u, n in brute(text, r.alphabet.lower()).items()}
    assert got == want


def test_no_texts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert count_units(empty).count() == 0 and train_models(empty) == []


def test_ranks_break_ties_by_pair(spark):
    units = spark.createDataFrame([("ru", "ба", 2), ("ru", "аб", 2), ("ru", "а", 9)], "iso_code string, unit string, cnt long")
    assert [(r.pair, r.place, r.category) for r in rank_pairs(units).orderBy("place").collect()] == [("аб", 1, 3), ("ба", 2, 3)]


def test_trained_models_know_their_language(spark):
    models = train_models(spark.createDataFrame([("ru", RUSSIAN)], "lang string, text string"))
    assert [m.charset for m in models] == LANGUAGES[[x[1] for x in LANGUAGES].index("ru")][3]
    for m in models:
        a, b = "бу".encode(m.charset)
        assert m.category[a, b] == 3 and m.is_freq[a] and not m.keep_ascii
    singles, pairs = model_tables(spark, models)
    assert singles.count() == 256 * len(models)
    assert pairs.where("charset = 'KOI8-R' and b1 = {} and b2 = {}".format(*"бу".encode("koi8-r"))).count() == 1


def test_conversion_ignores_row_and_column_zero(spark):
    orders = [("windows-1251", "ж".encode("cp1251")[0], 1), ("koi8-r", "ж".encode("koi8-r")[0], 1), ("koi8-r", "а".encode("koi8-r")[0], 0), ("koi8-r", 65, 253)]
    table = spark.createDataFrame(orders, "charset string, byte int, order int")
    matrix = spark.createDataFrame([(i, j, 3) for i in (0, 1) for j in (0, 1)], "i int, j int, category int")
    assert {tuple(r) for r in char_ranks(table).collect()} == {("ж", 1), ("а", 0)}
    assert [tuple(r) for r in convert_matrix(table, matrix).collect()] == [("ж", "ж", 3)]


def test_conversion_refuses_unstable_ranks(spark):
    table = spark.createDataFrame([("windows-1251", 0xE6, 1), ("koi8-r", 0xD6, 2)], "charset string, byte int, order int")
    with pytest.raises(ValueError, match="unstable"):
        char_ranks(table)
