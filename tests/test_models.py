from collections import Counter

import numpy as np
import pytest

from octetlens.operators.detector import Detector
from octetlens.operators.models import FREQUENT, blend, builtin_pack, categories, held_out_share, latin_pairs, load_pack, save_pack, train_from_names, train_pack, vocabulary_pieces

#: Sentences that no model is trained from: locale -> (text, charsets as reported by Python's codecs, language).
SENTENCES = {
    "ru": ("Учёные института сообщили, что новый метод позволяет быстрее находить ошибки в больших таблицах. По словам руководителя проекта, работа заняла три года.", {"windows-1251": "cp1251", "KOI8-R": "koi8_r", "ISO-8859-5": "iso8859_5", "IBM866": "cp866", "IBM855": "cp855"}, "Russian"),
    "bg": ("Според ръководителя на проекта работата е продължила три години и е изисквала участието на специалисти от различни държави.", {"windows-1251": "cp1251", "ISO-8859-5": "iso8859_5"}, "Bulgarian"),
    "el": ("το πρόγραμμα είναι διαθέσιμο σε όλους και η νέα μέθοδος βρίσκει γρηγορότερα λάθη σε μεγάλους πίνακες", {"ISO-8859-7": "iso8859_7"}, "Greek"),
    "th": ("นักวิทยาศาสตร์ของสถาบันรายงานว่าวิธีการใหม่ช่วยให้ค้นหาข้อผิดพลาดในตารางขนาดใหญ่ได้เร็วขึ้น", {"TIS-620": "tis_620"}, "Thai"),
    "tr": ("Proje yöneticisine göre çalışma üç yıl sürdü ve farklı ülkelerden uzmanların katılımını gerektirdi.", {"ISO-8859-9": "iso8859_9"}, "Turkish"),
    "he": ("לדברי מנהל הפרויקט, העבודה נמשכה שלוש שנים ודרשה השתתפות של מומחים ממדינות שונות.", {"windows-1255": "cp1255"}, "Hebrew"),
    "ja": ("責任者によると、この仕事には三年かかり、いろいろな国の専門家が参加したそうです。", {"EUC-JP": "euc_jp"}, "Japanese"),
    "zh": ("项目负责人表示，这项工作花了三年时间，有来自不同国家的专家参加。", {"GB2312": "gb2312"}, "Chinese"),
    "tw": ("專案負責人表示，這項工作花了三年時間，有來自不同國家的專家參加。", {"Big5": "big5"}, "Chinese"),
    "ko": ("책임자에 따르면 이 작업은 삼 년이 걸렸으며 여러 나라의 전문가들이 참여했습니다.", {"EUC-KR": "euc_kr", "Johab": "johab"}, "Korean"),
    "fr": ("D'après le responsable du projet, le travail a duré trois années et a exigé la participation d'experts étrangers.", {"ISO-8859-1": "latin_1"}, ""),
}


@pytest.mark.parametrize("locale", SENTENCES)
def test_sentences_in_their_charsets(locale):
    pack = builtin_pack()
    text, charsets, language = SENTENCES[locale]
    for charset, codec in charsets.items():
        d = Detector()
        d.feed(text.encode(codec), pack)
        name, confidence, spoken = d.close(pack)
        assert (name.lower(), spoken) == (charset.lower(), language) and confidence > 0.5


def test_categories():
    pairs = {f"{i:04}": 3000 - i for i in range(FREQUENT * 2 + 5)}
    kind = categories(pairs)
    assert Counter(kind.values()) == {3: FREQUENT, 2: FREQUENT, 1: 5} and kind["0000"] == 3
    assert categories({"ab": 9, "cd": 1}, cover=0.9) == {"ab": 3, "cd": 2}
    assert categories({"ab": 9, "cd": 1}, contrast={"ab": 0.1, "cd": 0.9}) == {"ab": 3, "cd": 2}
    assert categories({}) == {}


def test_held_out_share():
    assert held_out_share(Counter()) == 1.0
    assert held_out_share(Counter({"abab": 1, "baba": 1, "abba": 1, "abaab": 1})) > 0.8
    assert held_out_share(Counter({w: 1 for w in ("ab", "cd", "ef", "gh")})) == 1.0  # nothing recurs


def test_empty_and_unweighted_words():
    pack = train_pack({"ru": ["да", "нет"], "el": []})
    assert pack.single[0].category.any() and not pack.single[6].category.any()
    weighted = train_pack({"ru": {"да": 1, "нет": 1}})
    assert np.array_equal(weighted.single[0].category, pack.single[0].category)


def test_blend_takes_a_languages_own_pieces(tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(x.encode()) + b" %d" % i for i, x in enumerate(["the", " ışık", "für", "ёж", "мир"])) + b"\n" + base64.b64encode(b"\xd0") + b" 5\n")
    pieces = vocabulary_pieces(str(path))
    assert pieces[-1] == "" and len(pieces) == 6
    assert set(blend("tr", ["Saat Ver"], pieces)) == {"Saat", "Ver", "ışık", "Işık"}
    assert "ёж" not in blend("bg", [], pieces) and "мир" in blend("bg", [], pieces)
    assert set(latin_pairs(pieces)) == {"th", "he", "fü", "ür", "ık"} - {"ık"}
    assert latin_pairs([]) is None and blend("ru", [], []) == Counter()


def equal(a, b):
    assert a.ratio == b.ratio and a.frequent == b.frequent and np.array_equal(a.kana, b.kana) and len(a.single) == len(b.single)
    for x, y in zip(a.single, b.single):
        assert (x.charset, x.language, x.ratio, x.keep_ascii) == (y.charset, y.language, y.ratio, y.keep_ascii)
        assert all(np.array_equal(getattr(x, c), getattr(y, c)) for c in ("is_char", "is_freq", "category"))


def test_packs_are_saved_and_loaded(spark, tmp_path):
    path = str(tmp_path / "pack.npz")
    for pack in (builtin_pack(), train_pack({}), train_from_names(spark)):
        save_pack(pack, path)
        equal(load_pack(path), pack)
    own = train_from_names(spark)
    assert own.single[0].category.any() and own.frequent["EUC-KR"]
    import octetlens.operators.models as models

    models_form, models.FORM = models.FORM, 0
    try:
        with pytest.raises(ValueError):
            load_pack(path)
    finally:
        models.FORM = models_form


CODECS = {"Big5": "big5", "CP949": "cp949", "EUC-JP": "euc_jp", "EUC-KR": "euc_kr", "Johab": "johab", "GB2312": "gb2312", "SHIFT_JIS": "shift_jis"}


@pytest.mark.parametrize("charset", CODECS)
def test_every_character_of_a_charset_is_legal(charset):
    """All assigned characters that the codec writes, one after the other: the prober goes on, and its grammar takes all."""
    import unicodedata

    from octetlens.operators.probers import MultiByte, legal_tokens

    every = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cc", "Cf", "Cn", "Co", "Cs"))
    data = every.encode(CODECS[charset], "ignore")
    if charset == "GB2312":
        data = b"".join(c.encode("gb2312", "ignore") for c in every)
    assert legal_tokens(charset, data)[0] == len(data) > 5000
    prober = MultiByte(charset)
    assert prober.feed(data, train_pack({})) != "NOT_ME"
