"""The probers as statistics of a byte string, computed with array operations chunk by chunk.

A prober keeps only what later chunks need: counters, a cut character, the last letter. Fed once with everything it gives
the one-shot answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import regex

from ..functions.grammar import GB_FOUR, GRAMMAR
from .classes import OTH, class_model, latin1_classes, macroman_classes
from .models import Pack, SingleByteModel

DETECTING, FOUND_IT, NOT_ME = "DETECTING", "FOUND_IT", "NOT_ME"
SURE_YES, SURE_NO, SHORTCUT, ENOUGH = 0.99, 0.01, 0.95, 1024
#: Place of the Hebrew model in a pack; those before it have one prober each.
HEBREW = 12
#: Least confidence of an answer.
MINIMUM = 0.20

#: Letters of ASCII and bytes beyond it: what words consist of.
_IN_WORD = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def words_of(b: np.ndarray) -> np.ndarray:
    """Words with a high byte, each with a space for the byte that ends it."""
    inside = _IN_WORD[b]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    number = np.cumsum(begins, dtype=np.int32)
    kept = np.zeros(number[-1] + 1 if len(b) else 1, bool)
    kept[number[b >= 0x80]] = True
    taken = inside & kept[number]
    ends = np.zeros_like(taken)
    ends[1:] = taken[:-1] & ~inside[1:]
    return np.where(inside, b, np.uint8(0x20))[taken | ends]


def text_of(b: np.ndarray) -> np.ndarray:
    """What stands outside of <...>, each stretch before a tag with a space."""
    cuts = np.flatnonzero((b == 0x3C) | (b == 0x3E))
    if not len(cuts):
        return b
    closing = b[cuts] == 0x3E
    length = np.diff(cuts, prepend=-1, append=len(b) - 1)
    kept = np.append(True, closing) & np.append(~closing, True)
    kept[:-1] &= length[:-1] > 1
    out = b[np.repeat(kept, length)]
    out[out == 0x3C] = 0x20
    return out


def high_only(data: bytes) -> bytes:
    """Each run of ASCII becomes one space."""
    b = np.frombuffer(data, np.uint8)
    high = b >= 0x80
    kept = high.copy()
    kept[:1] = True
    kept[1:] |= high[:-1]
    return np.where(high, b, np.uint8(0x20))[kept].tobytes()


def international_words(data: bytes) -> bytes:
    return words_of(np.frombuffer(data, np.uint8)).tobytes()


def strip_tags(data: bytes) -> bytes:
    return text_of(np.frombuffer(data, np.uint8)).tobytes()


class Tally:
    """Bytes of a stream and its pairs of neighbours, counted once for all probers that look at it."""

    def __init__(self, s: np.ndarray):
        self.size = len(s)
        if self.size:
            self.first, self.last, self.bytes = int(s[0]), int(s[-1]), np.bincount(s, minlength=256)
            codes = s[:-1].astype(np.uint16) << 8 | s[1:]
            if len(codes) < 8192:
                self.codes, self.counts = np.unique(codes, return_counts=True)
            else:
                counts = np.bincount(codes, minlength=65536)
                self.codes = np.flatnonzero(counts)
                self.counts = counts[self.codes]
            self.sums = None

    def of(self, pack: Pack, model: int, reversed_: bool) -> tuple[int, int, np.ndarray]:
        """A model's letters, its letters with pairs, and its pairs by category."""
        column, units, pairs = _tables(pack)
        if self.sums is None:
            self.sums = (self.bytes @ units).reshape(-1, 2), self.counts.astype(float) @ pairs[self.codes].astype(float)
        k = column[model, reversed_]
        return int(self.sums[0][k, 0]), int(self.sums[0][k, 1]), self.sums[1][4 * k : 4 * k + 4].astype(np.int64)


def _tables(pack: Pack) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of all models side by side: which bytes are letters, and each pair's category as four marks."""
    made = pack.__dict__.get("_tables")
    if made is None:
        ways = [(k, False) for k in range(len(pack.single))] + [(k, True) for k in (HEBREW,) if k < len(pack.single)]
        units, pairs = np.zeros((256, len(ways), 2), np.int64), np.zeros((65536, 4 * len(ways)), np.uint8)
        for k, (model, back) in enumerate(ways):
            m = pack.single[model]
            units[:, k, 0], units[:, k, 1] = m.is_char, m.is_freq
            category = np.asarray(m.category).T if back else np.asarray(m.category)
            both = np.flatnonzero(np.outer(m.is_freq, m.is_freq))
            pairs[both, 4 * k + category.reshape(-1)[both]] = 1
        made = pack.__dict__["_tables"] = {w: k for k, w in enumerate(ways)}, units.reshape(256, -1), pairs
    return made


def _bytes_pattern(text: str) -> bytes:
    return text.encode("ascii")


@dataclass
class Row:
    group: str
    rank: int
    charset: str
    language: str
    state: str
    confidence: float


class Utf8:
    group, language, charset = "mb", "", "utf-8"
    _one, _more = (_bytes_pattern(x) for x in GRAMMAR["utf-8"])
    _legal = regex.compile(rb"(?:" + _one + rb"++|" + _more + rb")*+")
    _longer = regex.compile(_more)

    def __init__(self):
        self.state, self.n, self.carry = DETECTING, 0, b""

    def feed(self, chunk: bytes, pack: Pack, conclude: bool = True) -> str:
        if self.state == NOT_ME:
            return self.state
        data = self.carry + chunk
        end = self._legal.match(data).end()
        # Of a longer character only the first byte is 0xC0 or above.
        self.n += int((np.frombuffer(data, np.uint8)[:end] >= 0xC0).sum())
        self.carry = data[end:]
        if self.carry and not self._longer.fullmatch(self.carry, partial=True):
            self.state = NOT_ME
        return self.conclude(pack) if conclude else self.state

    def conclude(self, pack: Pack) -> str:
        if self.state != NOT_ME and self.confidence(pack) > SHORTCUT:
            self.state = FOUND_IT
        return self.state

    def confidence(self, pack: Pack) -> float:
        return 1.0 - 0.99 * 0.5**self.n if self.n < 6 else SURE_YES


def _euc_kr_of_johab() -> set:
    out = set()
    for a in range(0x88, 0xD4):
        for b in range(0x41, 0xFF):
            try:
                if bytes([a, b]).decode("johab").encode("euc_kr")[0] >= 0xB0:
                    out.add(a * 256 + b)
            except UnicodeError:
                pass
    return out


_JOHAB: list[np.ndarray] = []


def johab_counted() -> np.ndarray:
    """Of each pair of bytes, first times 256 plus second: whether it is a Johab character that counts."""
    if not _JOHAB:
        table = np.zeros(65536, bool)
        table[list(_euc_kr_of_johab())] = True
        _JOHAB.append(table)
    return _JOHAB[0]


def _johab(a, b):
    return johab_counted()[a * 256 + b]


#: Which two-byte characters count, by lead and trail.
COUNTED = {
    "SHIFT_JIS": lambda a, b: ((a >= 0x81) & (a <= 0x9F) | (a >= 0xE0) & (a <= 0xEF)) & (b <= 0x7F),
    "EUC-JP": lambda a, b: a >= 0xA1,
    "GB2312": lambda a, b: (a >= 0xB0) & (b >= 0xA1),
    "EUC-KR": lambda a, b: a >= 0xB0,
    "CP949": lambda a, b: 94 * (a - 0xB0) + b - 0xA1 >= np.where(a >= 0xB0, 0, 1 << 20),
    "Big5": lambda a, b: a >= 0xA4,
    "EUC-TW": lambda a, b: a >= 0xC4,
    "Johab": _johab,
}
#: The language each reports. Fixed values.
LANGUAGES = {"SHIFT_JIS": "Japanese", "EUC-JP": "Japanese", "GB2312": "Chinese", "EUC-KR": "Korean", "CP949": "Korean", "Big5": "Chinese", "EUC-TW": "Taiwan", "Johab": "Korean"}
_LEGAL = {c: regex.compile(rb"(?:" + _bytes_pattern(a) + rb"++|" + _bytes_pattern(b) + rb")*+") for c, (a, b) in GRAMMAR.items()}
_LONGER = {c: regex.compile(_bytes_pattern(b)) for c, (a, b) in GRAMMAR.items()}
_GB_FOUR = regex.compile(_bytes_pattern(GB_FOUR))


#: So much of a text is looked at before all of it is: most charsets end there.
_HEAD = 256


def legal_tokens(charset: str, data: bytes) -> tuple[int, list[bytes]]:
    """Length of the legal beginning, and its two-byte characters."""
    end = _LEGAL[charset].match(data).end()
    return end, [t for t in _LONGER[charset].findall(data, 0, end) if len(t) == 2]


class Layout:
    """A charset's grammar as tables, to tell where characters start in all of a text at once.

    A byte that can't lead a character of two is one by itself or ends one. So a character starts behind it, and from there at
    every second byte as long as bytes can lead. What stands behind the first byte of a character of three is seen as one of two.
    """

    def __init__(self, charset: str):
        self.legal = _LEGAL[charset]
        one, more = regex.compile(_bytes_pattern(GRAMMAR[charset][0])), _LONGER[charset]
        self.single = np.array([bool(one.fullmatch(bytes([a]))) for a in range(256)])
        follows = np.array([[bool(more.fullmatch(bytes([a, b]))) for b in range(256)] for a in range(256)])
        self.lead = follows.any(1)
        three = np.array([[bool(more.fullmatch(bytes([a, b, 0xA1]))) for b in range(256)] for a in range(256)])
        self.three = three.any(1)
        self.some_three = bool(self.three.any())
        self.follows = (follows | three | self.single[:, None]).reshape(-1)

    def split(self, data: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """The bytes, the end of the legal beginning, where its characters start, and their sizes."""
        b = np.frombuffer(data, np.uint8)
        n = len(b)
        if n > _HEAD and (end := self.legal.match(data, 0, _HEAD).end()) <= _HEAD - 4:
            n = end
        if not n:
            return b, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = b[:n]
        lead = self.lead[c]
        at = np.arange(n, dtype=np.int32)
        other = np.maximum.accumulate(np.where(lead, np.int32(-1), at))
        starts = np.ones(n, bool)
        starts[1:] = (at[1:] - other[:-1]) & 1 == 1
        legal = np.empty(n, bool)
        legal[:-1] = self.follows[c[:-1].astype(np.uint16) << 8 | c[1:]]
        legal[-1] = self.single[c[-1]]
        bad = starts & ~legal
        end = int(bad.argmax())
        if not bad[end]:
            end = n
        elif end and self.three[c[end - 1]]:
            end -= 1
        where = np.flatnonzero(starts[:end])
        if self.some_three and len(where):
            kept = np.ones(len(where), bool)
            kept[1:] = ~self.three[c[where[:-1]]]
            where = where[kept]
        sizes = np.empty_like(where)
        sizes[:-1] = where[1:] - where[:-1]
        sizes[-1:] = end - where[-1:]
        return b, end, where, sizes


@cache
def layout(charset: str) -> Layout:
    return Layout(charset)


class MultiByte:
    group = "mb"

    def __init__(self, charset: str):
        self.name, self.language = charset, LANGUAGES[charset]
        self.state, self.total, self.freq, self.carry = DETECTING, 0, 0, b""
        self.kana = Kana(charset) if self.language == "Japanese" else None

    @property
    def charset(self) -> str:
        return "CP932" if self.kana and self.kana.windows else self.name

    def feed(self, chunk: bytes, pack: Pack) -> str:
        if self.state == NOT_ME:
            return self.state
        data = self.carry + chunk
        b, end, starts, sizes = layout(self.name).split(data)
        self.count(b, starts, sizes, pack)
        self.carry = data[end:]
        if self.carry and self.name == "GB2312" and _GB_FOUR.match(self.carry):
            self.state = FOUND_IT
        elif self.carry and not self._cut():
            self.state = NOT_ME
        elif self._enough() and self.confidence(pack) > SHORTCUT:
            self.state = FOUND_IT
        return self.state

    def count(self, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pack: Pack, before: int = 0) -> None:
        """Takes the characters of a legal beginning; ``before`` is the byte in front of it."""
        two = starts[sizes == 2]
        if len(two):
            first, second = b[two].astype(np.int64), b[two + 1].astype(np.int64)
            counted = COUNTED[self.name](first, second)
            self.total += int(counted.sum())
            self.freq += int((counted & pack.often(self.name)[first * 256 + second]).sum())
        if self.kana:
            self.kana.feed(b, starts, sizes, pack, before)

    def _cut(self) -> bool:
        partial = _LONGER[self.name].fullmatch(self.carry, partial=True)
        return bool(partial or self.name == "GB2312" and _GB_FOUR.fullmatch(self.carry, partial=True))

    def _enough(self) -> bool:
        return self.kana.total > 100 if self.kana else self.total > ENOUGH

    def confidence(self, pack: Pack) -> float:
        if self.total <= 0 or self.freq <= 3:
            own = SURE_NO
        else:
            other = (self.total - self.freq) * pack.ratio[self.name]
            own = min(self.freq / other, SURE_YES) if other else SURE_YES
        return max(self.kana.confidence(), own) if self.kana else own


#: Bytes that Shift_JIS reads as the first of two, and those that only its Windows form has.
_LONG = np.array([0x81 <= a <= 0x9F or 0xE0 <= a <= 0xFC for a in range(256)])
_WINDOWS = np.array([a == 0x87 or 0xFA <= a <= 0xFC for a in range(256)])


class Kana:
    """Pairs of hiragana in the order in which characters end.

    A character is looked at through a window that the two charsets choose differently; a window whose character is
    longer than its own length leaves a debt of bytes that is never paid off, and from then on hides what follows.
    """

    def __init__(self, charset: str):
        self.shift = charset == "SHIFT_JIS"
        self.total, self.zero, self.debt, self.last, self.done, self.windows = 0, 0, 0, -1, False, False

    def feed(self, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pack: Pack, before: int = 0) -> None:
        """Takes the characters of a legal beginning; ``before`` is the byte in front of it."""
        if self.done or not len(starts) or self.debt and not self.shift:
            return
        places, owes = self._shift(b, starts, sizes) if self.shift else self._euc(b, starts, sizes, before)
        indebted = 0 if self.debt else int(owes.argmax()) if owes.any() else len(starts)
        places[indebted:] = -1
        earlier = np.append(self.last, places[:-1])
        earlier[1:][sizes[:-1] == 3] = -1
        hits, room, stop = np.flatnonzero((places >= 0) & (earlier >= 0)), 1000 - self.total, len(starts)
        if len(hits) > room:
            self.done, stop = True, int(hits[room]) + 1
        self.total += min(len(hits), room + 1)
        self.zero += int((pack.kana[earlier[hits[:room]], places[hits[:room]]] == 0).sum())
        if self.shift and not self.windows:
            # Before the debt characters are read from their first byte, behind it from their second.
            first, two = starts[: min(indebted + (not self.debt), stop)], np.flatnonzero(sizes[:stop] == 2)
            second = starts[two[(two > indebted) | (b[starts[two]] == 0x80) | bool(self.debt)]] + 1
            self.windows = bool(_WINDOWS[b[first]].any() or _WINDOWS[b[second]].any())
        self.debt = self.debt or int(indebted < len(starts))
        self.last = -1 if sizes[-1] == 3 else int(places[-1])

    @staticmethod
    def _shift(b, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
        """Order of each character's hiragana, or -1, and whether a longer one is seen in its place."""
        a, b_ = b[starts].astype(np.int64), np.append(b, 0)[starts + 1].astype(np.int64)
        places = np.where((a == 0xCA) & (b_ >= 0x9F) & (b_ <= 0xF1), b_ - 0x9F, -1)
        return places, (sizes == 1) & _LONG[a] | (sizes == 2) & (a == 0x80) & _LONG[b_]

    @staticmethod
    def _euc(b, starts, sizes, before) -> tuple[np.ndarray, np.ndarray]:
        stops = starts + sizes
        a, b_ = np.append(b, before)[stops - 2].astype(np.int64), b[stops - 1].astype(np.int64)
        if stops[0] == 1:
            a[0] = before
        places = np.where((a == 0xA4) & (b_ >= 0xA1) & (b_ <= 0xF3), b_ - 0xA1, -1)
        return places, (sizes == 1) & ((a == 0x8E) | (a == 0x8F) | (a >= 0xA1) & (a <= 0xFE))

    def confidence(self) -> float:
        return (self.total - self.zero) / self.total if self.total > 4 else -1.0


class SingleByte:
    group = "sb"

    def __init__(self, model: int, reversed_: bool = False, decider: Hebrew | None = None):
        self.model, self.reversed, self.decider = model, reversed_, decider
        self.state, self.seqs, self.chars, self.freq, self.last = DETECTING, np.zeros(4, np.int64), 0, 0, -1
        self.names = ("", "")

    def feed(self, streams: dict, pack: Pack) -> str:
        m: SingleByteModel = pack.single[self.model]
        tally: Tally = streams["tags" if m.keep_ascii else "words"]
        self.names = (m.charset, m.language)
        if not tally.size:
            return self.state
        chars, freq, seqs = tally.of(pack, self.model, self.reversed)
        self.chars, self.freq, self.seqs = self.chars + chars, self.freq + freq, self.seqs + seqs
        if self.last >= 0 and m.is_freq[self.last] and m.is_freq[tally.first]:
            a, b = (tally.first, self.last) if self.reversed else (self.last, tally.first)
            self.seqs[m.category[a, b]] += 1
        self.last = tally.last
        if self.state == DETECTING and self.seqs.sum() > ENOUGH:
            c = self.confidence(pack)
            self.state = FOUND_IT if c > SHORTCUT else NOT_ME if c < 0.05 else DETECTING
        return self.state

    def confidence(self, pack: Pack) -> float:
        total = int(self.seqs.sum())
        if not total:
            return SURE_NO
        m = pack.single[self.model]
        r = (self.seqs[3] + 0.25 * self.seqs[2]) / total / m.ratio
        r = r * self.freq / self.chars if self.chars else 0.0
        return float(min(r, SURE_YES))

    @property
    def charset(self) -> str:
        return self.decider.charset if self.decider else self.names[0]

    @property
    def language(self) -> str:
        return self.names[1]


class Hebrew:
    """Decides between the names of logical and visual Hebrew by final letters; never a candidate itself."""

    group, language = "sb", "Hebrew"
    _final, _other = b"\xea\xed\xef\xf3\xf5", b"\xeb\xee\xf0\xf4"
    _logical = regex.compile(rb"(?<=[^ ])[" + _final + rb"](?= )")
    _visual = regex.compile(rb"(?<=[^ ])[" + _other + rb"](?= )|(?<= |\A)[" + _final + rb"](?=[^ ])")

    def __init__(self):
        self.state, self.score, self.carry, self.pair, self.names = DETECTING, 0, b" ", (None, None), ("", "Hebrew")

    def feed(self, streams: dict, pack: Pack) -> str:
        if all(p is not None and p.state == NOT_ME for p in self.pair):
            self.state = NOT_ME
            return self.state
        data = self.carry + high_only(streams["raw"])
        # What the kept bytes show by themselves isn't counted again.
        self.score -= len(self._logical.findall(self.carry)) - len(self._visual.findall(self.carry))
        self.score += len(self._logical.findall(data)) - len(self._visual.findall(data))
        self.carry = data[-2:]
        self.apart = (lambda a, b: a - b)(*(p.confidence(pack) for p in self.pair)) if all(self.pair) else 0.0
        return DETECTING

    def settle(self, pack: Pack) -> None:
        self.apart = self.pair[0].confidence(pack) - self.pair[1].confidence(pack)

    @property
    def charset(self) -> str:
        if abs(self.score) >= 5:
            return "windows-1255" if self.score > 0 else "ISO-8859-8"
        if abs(getattr(self, "apart", 0.0)) > 0.01:
            return "windows-1255" if self.apart > 0 else "ISO-8859-8"
        return "ISO-8859-8" if self.score < 0 else "windows-1255"

    def confidence(self, pack: Pack) -> float:
        return 0.0


_VALUES = class_model()
_CLASSES = {"ISO-8859-1": latin1_classes(), "MacRoman": macroman_classes()}
#: Value of each pair of bytes.
_PAIR_VALUES = {name: _VALUES[c][:, c].reshape(-1) for name, c in _CLASSES.items()}


class Western:
    """A charset without language model: values of pairs of classes outside of tags."""

    language = ""

    def __init__(self, charset: str):
        self.group = self.charset = charset
        self.state, self.last = DETECTING, OTH
        self.counts = np.array([0, 0, 0 if charset == "ISO-8859-1" else 10, 0])

    def feed(self, streams: dict, pack: Pack) -> str:
        tally: Tally = streams["tags"]
        if self.state == NOT_ME or not tally.size:
            return self.state
        classes = _CLASSES[self.charset]
        values = np.append(_PAIR_VALUES[self.charset][tally.codes], _VALUES[self.last, classes[tally.first]])
        self.last = int(classes[tally.last])
        if (values == 0).any():
            self.state = NOT_ME
            return self.state
        self.counts = self.counts + np.bincount(values, np.append(tally.counts, 1), minlength=4).astype(np.int64)
        return self.state

    def confidence(self, pack: Pack) -> float:
        if self.state == NOT_ME:
            return SURE_NO
        total = int(self.counts.sum())
        c = (self.counts[3] - self.counts[1] * 20.0) / total if total >= 1 else 0.0
        return float(max(c, 0.0) * 0.73)


@dataclass
class HighByte:
    """All probers of text with high bytes, and the answer of the groups."""

    non_cjk: bool = True
    groups: list = field(default_factory=list)
    found: str | None = None

    def __post_init__(self):
        if self.groups:
            return
        self.groups = [("mb", [Utf8(), *(MultiByte(c) for c in LANGUAGES)])]
        if self.non_cjk:
            hebrew = Hebrew()
            logical, visual = SingleByte(HEBREW, False, hebrew), SingleByte(HEBREW, True, hebrew)
            hebrew.pair = (logical, visual)
            self.groups.append(("sb", [*(SingleByte(k) for k in range(HEBREW)), hebrew, logical, visual]))
        self.groups += [(c, [Western(c)]) for c in ("ISO-8859-1", "MacRoman")]
        self.dropped: set = set()
        self.decided: dict = {}

    def feed(self, chunk: bytes, pack: Pack) -> str | None:
        """Feeds group after group until one has found it; returns that group's name."""
        raw = {"raw": chunk}

        def step(name, p):
            if name == "mb":
                return p.feed(chunk, pack)
            if "tags" not in raw:
                b = np.frombuffer(chunk, np.uint8)
                raw.update(tags=Tally(text_of(b)), words=Tally(words_of(b)))
            return p.feed(raw, pack)

        return self.each(step, pack)

    def each(self, step, pack: Pack) -> str | None:
        """Lets ``step`` feed prober after prober until one has found it; returns its group's name."""
        for name, members in self.groups:
            if self.decided.get(name) == NOT_ME:
                continue
            for k, p in enumerate(members):
                if (name, k) in self.dropped:
                    continue
                state = step(name, p)
                if state == FOUND_IT:
                    self.found, self.decided[name] = name, FOUND_IT
                    self._settle(pack)
                    return name
                if state == NOT_ME:
                    self.dropped.add((name, k))
                    if len(members) > 1 and all((name, j) in self.dropped for j in range(len(members))):
                        self.decided[name] = NOT_ME
        self._settle(pack)
        return None

    def _settle(self, pack: Pack) -> None:
        for _, members in self.groups:
            for p in members:
                if isinstance(p, Hebrew):
                    p.settle(pack)

    def rows(self, pack: Pack) -> list[Row]:
        """Every candidate, in order."""
        out = []
        for name, members in self.groups:
            for p in members:
                if isinstance(p, (SingleByte, Hebrew)) and isinstance(p, SingleByte):
                    m = pack.single[p.model]
                    p.names = (m.charset, m.language)
                out.append(Row(name, len(out), p.charset, p.language, p.state, p.confidence(pack)))
        return out

    def answer(self, pack: Pack) -> tuple[str | None, float, str | None]:
        """Name, confidence and language of the best group; the first of equals. No name at or below MINIMUM."""
        best, top = None, 0.0
        for name, members in self.groups:
            if self.decided.get(name) == FOUND_IT:
                choice, c = next(p for p in members if p.state == FOUND_IT), SURE_YES if len(members) > 1 else None
                c = choice.confidence(pack) if c is None else c
            elif self.decided.get(name) == NOT_ME:
                choice, c = members[-1], SURE_NO
            else:
                alive = [p for k, p in enumerate(members) if (name, k) not in self.dropped] or members
                choice, c = alive[0], 0.0
                for p in alive:
                    if p.confidence(pack) > c or len(members) == 1:
                        choice, c = p, p.confidence(pack)
            if name == self.found:
                return choice.charset, c, choice.language
            if c > top:
                best, top = choice, c
        if best is None or top <= MINIMUM:
            return None, 0.0, None
        return best.charset, top, best.language
