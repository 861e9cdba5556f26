"""Language models of the statistical probers: a pack of plain arrays that can be replaced.

The built-in pack is a file beside this module, the same wherever it runs. It was trained by ``train_from_names`` from the
names that a Java runtime carries for its locales and from the vocabulary of a tokenizer for many languages, whose order
tells how frequent a piece is. Structure and formulas of the probers don't depend on the pack, numbers of their confidences do.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: (reported name, Python's codec, language, locale, keeps ASCII letters) in the order of the probers. Fixed values.
SINGLE_BYTE = [
    ("windows-1251", "cp1251", "Russian", "ru", False),
    ("KOI8-R", "koi8_r", "Russian", "ru", False),
    ("ISO-8859-5", "iso8859_5", "Russian", "ru", False),
    ("MacCyrillic", "mac_cyrillic", "Russian", "ru", False),
    ("IBM866", "cp866", "Russian", "ru", False),
    ("IBM855", "cp855", "Russian", "ru", False),
    ("ISO-8859-7", "iso8859_7", "Greek", "el", False),
    ("windows-1253", "cp1253", "Greek", "el", False),
    ("ISO-8859-5", "iso8859_5", "Bulgarian", "bg", False),
    ("windows-1251", "cp1251", "Bulgarian", "bg", False),
    ("TIS-620", "tis_620", "Thai", "th", False),
    ("ISO-8859-9", "iso8859_9", "Turkish", "tr", True),
    ("windows-1255", "cp1255", "Hebrew", "he", False),
]
#: charset -> (Python's codec, locale of its characters' frequencies, ratio of frequent to other characters).
MULTI_BYTE = {
    "SHIFT_JIS": ("cp932", "ja", 3.0),
    "EUC-JP": ("euc_jp", "ja", 3.0),
    "GB2312": ("gb2312", "zh-CN", 0.9),
    "EUC-KR": ("euc_kr", "ko", 6.0),
    "CP949": ("cp949", "ko", 6.0),
    "Big5": ("big5", "zh-TW", 0.75),
    "EUC-TW": (None, "zh-TW", 0.75),
    "Johab": ("johab", "ko", 6.0),
}
#: How many characters and pairs count as frequent; letters beyond LETTERS have no pairs.
FREQUENT, LETTERS = 512, 64
#: Share of a language's pairs that its frequent ones cover; how frequent one must be against the contrast of other languages.
COVER, ODDS = 0.97, 0.6
#: Weight of each word once more with a capital, as at the beginning of a sentence.
CAPITAL = 0.15
#: locale -> (its letters, the vocabulary's share beside names, letters one of which a piece must hold, letters it must not).
SCRIPTS = {
    "ru": ("А-яЁё", 0.8, "", ""),
    "bg": ("А-я", 0.3, "", "ЫЭЁыэё"),
    "el": ("Ά-ώ", 0.6, "", ""),
    "th": ("ก-๛", 0.6, "", ""),
    "tr": ("A-Za-zÇĞİÖŞÜçğıöşü", 0.3, "ĞİŞğış", ""),
    "he": ("א-תְ-ׇ", 0.6, "", ""),
    "ja": ("ぁ-んァ-ヶ一-龥ー、。・「」", 0.9, "", ""),
    "zh-CN": ("一-龥", 0.9, "", ""),
    "zh-TW": ("一-龥", 0.9, "", ""),
    "ko": ("가-힣", 0.8, "", ""),
}
#: Version of the built-in pack, and of the form packs are saved in.
VERSION, FORM = "1", 1
BUILT_IN = os.path.join(os.path.dirname(os.path.abspath(__file__)), f"pack-{VERSION}.npz")
Words = Mapping[str, float] | Iterable[str]


@dataclass
class SingleByteModel:
    charset: str
    language: str
    ratio: float
    keep_ascii: bool
    is_char: np.ndarray  # of each byte: a letter of any kind
    is_freq: np.ndarray  # of each byte: a letter with pairs
    category: np.ndarray  # of each pair of bytes: 0 to 3


@dataclass
class Pack:
    single: list[SingleByteModel]
    frequent: dict[str, set] = field(default_factory=dict)  # charset -> two-byte characters
    ratio: dict[str, float] = field(default_factory=dict)
    kana: np.ndarray = field(default_factory=lambda: np.zeros((83, 83), np.int8))

    def __getstate__(self):
        # Tables made from the rest aren't sent along.
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def often(self, charset: str) -> np.ndarray:
        """Of each pair of bytes, first times 256 plus second: whether it is a frequent character."""
        made = self.__dict__.setdefault("_often", {})
        if charset not in made:
            made[charset] = np.zeros(65536, bool)
            made[charset][[a * 256 + b for a, b in self.frequent.get(charset, ())]] = True
        return made[charset]


def held_out_share(words: Counter, contrast: Mapping[str, float] | None = None) -> float:
    """The share of frequent pairs, likely ones by a quarter, in words that the ranks weren't made from; 1 without pairs."""
    folds, hit = [Counter(), Counter(), Counter(), Counter()], 0.0
    for k, w in enumerate(sorted(words)):
        folds[k % 4][w] = words[w]
    for fold in folds:
        kind = categories(_pairs(words - fold), COVER, contrast)
        hit += sum(n * {3: 1.0, 2: 0.25}.get(kind.get(p, 0), 0.0) for p, n in _pairs(fold).items())
    return hit / sum(_pairs(words).values()) if hit else 1.0


def _letters(words: Counter) -> Counter:
    out = Counter()
    for w, n in words.items():
        for c in w:
            out[c] += n
    return out


def _pairs(words: Counter) -> Counter:
    out = Counter()
    for w, n in words.items():
        for i in range(len(w) - 1):
            out[w[i : i + 2]] += n
    return out


def categories(pairs: Mapping[str, float], cover: float = 1.0, contrast: Mapping[str, float] | None = None) -> dict[str, int]:
    """3 for the frequent pairs, up to FREQUENT or the share ``cover``, 2 for the next ones, 1 for the rest.

    A pair that is much rarer here than in the shares ``contrast`` isn't called frequent.
    """
    total, before, out = sum(pairs.values()), 0.0, {}
    for k, p in enumerate(sorted(pairs, key=lambda p: (-pairs[p], p))):
        own = contrast is None or pairs[p] >= ODDS * contrast.get(p, 0.0) * total
        often = k < FREQUENT and (cover >= 1 or before < cover * total)
        out[p] = 3 if often and own else 2 if k < 2 * FREQUENT else 1
        before += pairs[p]
    return out


def ranked_model(
    charset: str, codec: str, language: str, keep_ascii: bool, counts: Counter, followed: Counter,
    cased: bool = False, cover: float = 1.0, contrast: Mapping[str, float] | None = None,
) -> SingleByteModel:
    """Ranks letters and pairs of letters by their counts, and sees them through a charset's bytes.

    Unless ``cased``, counts are of lower-case letters, and capitals stand for these.
    """
    letters = {c: n for c, n in counts.items() if c.isalpha() and (keep_ascii or not c.isascii()) or _mark(c)}
    frequent = {c for c, _ in Counter(letters).most_common(LETTERS - 1)}
    pairs = {p: n for p, n in followed.items() if p[0] in frequent and p[1] in frequent}
    kind = categories(pairs, cover, contrast)
    covered = sum(pairs[p] for p in pairs if kind[p] == 3) / max(1, sum(pairs.values()))
    decoded = [bytes([b]).decode(codec, "replace") for b in range(256)]
    chars = [c[:1] if cased else c.lower()[:1] for c in decoded]
    is_char = np.array([c.isalpha() or _mark(c) for c in chars])
    is_freq = np.array([c in frequent for c in chars])
    category = np.array([[kind.get(a + b, 0) for b in chars] for a in chars], np.int8)
    return SingleByteModel(charset, language, covered or 1.0, keep_ascii, is_char, is_freq, category)


def _mark(c: str) -> bool:
    """Vowel signs of Thai and Hebrew are letters to their models."""
    return "ั" <= c <= "๎" or "ְ" <= c <= "ׇ"


def train_pack(corpora: Mapping[str, Words], contrast: Mapping[str, float] | None = None) -> Pack:
    """A pack from words, or weights of words, by locale; locales without words give models that recognise nothing.

    ``contrast`` holds shares of pairs of letters in other languages, for models that count ASCII letters.
    """
    corpora = {k: Counter(v) for k, v in corpora.items()}
    pack, ratios = Pack([]), {}
    for name, codec, language, locale, keep in SINGLE_BYTE:
        words, against = corpora.get(locale, Counter()), contrast if keep else None
        model = ranked_model(name, codec, language, keep, _letters(words), _pairs(words), True, COVER, against)
        if locale not in ratios:
            ratios[locale] = held_out_share(words, against)
        model.ratio = ratios[locale]
        pack.single.append(model)
    for charset, (codec, locale, ratio) in MULTI_BYTE.items():
        counts = _letters(corpora.get(locale, Counter()))
        coded = [encoded(c, codec) for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if not c.isascii()]
        pack.frequent[charset] = set([c for c in coded if c is not None and len(c) == 2][:FREQUENT])
        pack.ratio[charset] = ratio
    kana = {p: n for p, n in _pairs(corpora.get("ja", Counter())).items() if "ぁ" <= min(p) and max(p) <= "ん"}
    for k, (a, b) in enumerate(sorted(kana, key=lambda p: (-kana[p], p))):
        pack.kana[ord(a) - 0x3041, ord(b) - 0x3041] = max(1, 5 - k // 64)
    return pack


def encoded(c: str, codec: str | None) -> bytes | None:
    """A character's bytes; EUC-TW, which Python lacks, is Big5's order of characters laid out in rows of 94."""
    try:
        if codec:
            return c.encode(codec)
        high, low = c.encode("big5")
    except (UnicodeEncodeError, ValueError):
        return None
    order = 157 * (high - 0xA4) + (low - 0xA1 + 63 if low >= 0xA1 else low - 0x40)
    return bytes([0xC4 + order // 94, 0xA1 + order % 94]) if 0 <= order < 94 * 59 else None


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a vocabulary by rank; empty where bytes aren't whole characters."""
    with open(path, "rb") as lines:
        return [base64.b64decode(x.split()[0]).decode("utf-8", "ignore") for x in lines]


def zone_ids(spark) -> list[str]:
    """One time zone of each English name; others say nothing new in other languages either."""
    zone, english = spark._jvm.java.util.TimeZone, spark._jvm.java.util.Locale.ENGLISH
    return list({zone.getTimeZone(x).getDisplayName(False, 1, english): x for x in zone.getAvailableIDs() if "/" in x}.values())


def locale_names(spark, tag: str, zones: Iterable[str] = ()) -> set[str]:
    """Names of languages, countries, currencies, ``zones``, months and days that the Java runtime has for a locale."""
    jvm = spark._jvm
    locale = jvm.java.util.Locale
    shown = locale.forLanguageTag(tag)
    names = [locale.forLanguageTag(x).getDisplayLanguage(shown) for x in locale.getISOLanguages()]
    names += [locale("", x).getDisplayCountry(shown) for x in locale.getISOCountries()]
    names += [x.getDisplayName(shown) for x in jvm.java.util.Currency.getAvailableCurrencies().toArray()]
    names += [jvm.java.util.TimeZone.getTimeZone(x).getDisplayName(False, 1, shown) for x in zones]
    symbols = jvm.java.text.DateFormatSymbols.getInstance(shown)
    return {*names, *symbols.getMonths(), *symbols.getWeekdays()}


def blend(tag: str, names: Iterable[str], pieces: list[str]) -> Counter:
    """Weights of a locale's words: each word of a name once, pieces by the inverse of their rank, in the shares of SCRIPTS."""
    letters, share, needs, shuns = SCRIPTS[tag]
    run = re.compile(f"[{letters}]+")
    named, ranked = Counter(x for w in {w for n in names for w in n.split()} for x in run.findall(w)), Counter()
    for k, piece in enumerate(pieces):
        for x in () if piece.isascii() else run.findall(piece):
            if not x.isascii() and (not needs or set(x) & set(needs)) and not set(x) & set(shuns):
                ranked[x] += 1 / (k + 1)
    out = Counter()
    for words, part in ((named, 1 - share if ranked else 1.0), (ranked, share)):
        total = sum(len(w) * n for w, n in words.items())
        for w, n in words.items():
            out[w] += n * part / total
    for w, n in list(out.items()):
        out[w[0].upper() + w[1:]] += CAPITAL * n
    return out


def latin_pairs(pieces: list[str]) -> dict[str, float] | None:
    """Shares of pairs of letters of Western languages in the pieces of a vocabulary."""
    words = Counter()
    for k, piece in enumerate(pieces):
        for x in re.findall("[A-Za-zÀ-ÖØ-öø-ÿ]+", piece):
            words[x] += 1 / (k + 1)
    pairs = _pairs(words)
    total = sum(pairs.values())
    return {p: n / total for p, n in pairs.items()} or None


def train_from_names(spark, vocabulary: str | None = None) -> Pack:
    """A pack from the Java runtime's names and a vocabulary: a file with base64 of a piece and its rank in each line."""
    pieces = vocabulary_pieces(vocabulary) if vocabulary else []
    zones, paired = zone_ids(spark), {x[3] for x in SINGLE_BYTE}
    corpora = {tag: blend(tag, locale_names(spark, tag, zones if tag in paired else ()), pieces) for tag in SCRIPTS}
    return train_pack(corpora, latin_pairs(pieces))


def save_pack(pack: Pack, path: str) -> None:
    """Write a pack as a file of named arrays, without code."""
    names = {"form": FORM, "single": [[m.charset, m.language, m.ratio, m.keep_ascii] for m in pack.single], "ratio": pack.ratio}
    arrays = {"kana": pack.kana, "names": np.frombuffer(json.dumps(names, sort_keys=True).encode(), np.uint8)}
    for k, m in enumerate(pack.single):
        arrays |= {f"is_char_{k}": m.is_char, f"is_freq_{k}": m.is_freq, f"category_{k}": m.category}
    for charset, characters in pack.frequent.items():
        arrays[f"frequent_{charset}"] = np.array(sorted(a * 256 + b for a, b in characters), np.uint16)
    with open(path, "wb") as out:
        np.savez_compressed(out, **arrays)


def load_pack(path: str) -> Pack:
    """Read a pack that ``save_pack`` wrote. ValueError for another form."""
    with np.load(path, allow_pickle=False) as a:
        names = json.loads(a["names"].tobytes())
        if names["form"] != FORM:
            raise ValueError(f"{path} is a pack of form {names['form']}, not {FORM}")
        single = [SingleByteModel(*row, a[f"is_char_{k}"], a[f"is_freq_{k}"], a[f"category_{k}"]) for k, row in enumerate(names["single"])]
        frequent = {c: {bytes(divmod(int(x), 256)) for x in a[f"frequent_{c}"]} for c in names["ratio"]}
        return Pack(single, frequent, names["ratio"], a["kana"])


@lru_cache(1)
def builtin_pack() -> Pack:
    """The fixed pack that comes with this package."""
    return load_pack(BUILT_IN)
