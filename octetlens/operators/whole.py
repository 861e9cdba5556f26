"""The answer of one feed for contents too large to hold: pieces are read twice, and what is kept doesn't grow with them.

Single-byte and Western probers depend on their streams by the bytes and pairs of neighbours only, so that two tables of counts
stand for a stream. Where a word or a stretch of text is open at a piece's end, its counts wait until it is known to be taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import regex

from ..functions.bytesx import BOMS
from ..functions.renames import renamed_value
from .detector import _BAD, _ESC, _ESCAPES, _HIGH, _WIN, ALL, NON_CJK, NOTHING, Wide
from .models import Pack
from .probers import _GB_FOUR, _IN_WORD, FOUND_IT, NOT_ME, SHORTCUT, Hebrew, HighByte, MultiByte, Tally, Utf8, layout, text_of, words_of

#: Bytes of a piece. Fixed value.
PIECE = 1 << 20
_SPACE = np.array([0x20], np.uint8)


class Sums:
    """A stream's counts."""

    def __init__(self):
        self.size, self.first, self.last = 0, -1, -1
        self.bytes, self.pairs = np.zeros(256, np.int64), np.zeros(65536, np.int64)

    def _join(self, first: int, last: int, size: int) -> None:
        if self.size:
            self.pairs[self.last * 256 + first] += 1
        else:
            self.first = first
        self.last, self.size = last, self.size + size

    def add(self, s: np.ndarray) -> None:
        if len(s):
            self._join(int(s[0]), int(s[-1]), len(s))
            self.bytes += np.bincount(s, minlength=256)
            self.pairs += np.bincount(s[:-1].astype(np.uint16) << 8 | s[1:], minlength=65536)

    def take(self, other: Sums) -> None:
        if other.size:
            self._join(other.first, other.last, other.size)
            self.bytes += other.bytes
            self.pairs += other.pairs

    def tally(self) -> Tally:
        out = Tally(_SPACE[:0])
        out.size, out.first, out.last, out.bytes, out.sums = self.size, self.first, self.last, self.bytes, None
        out.codes = np.flatnonzero(self.pairs)
        out.counts = self.pairs[out.codes]
        return out


class Words:
    """Words with a high byte; of an open one it may not be known yet."""

    def __init__(self):
        self.done, self.wait, self.open, self.high = Sums(), Sums(), False, False

    def feed(self, b: np.ndarray) -> None:
        if self.open:
            inside = _IN_WORD[b]
            end = len(b) if inside.all() else int(inside.argmin())
            self._more(b[:end])
            if end == len(b):
                return
            if self.high:
                self.done.add(_SPACE)
            b = b[end:]
        inside = _IN_WORD[b][::-1]
        cut = 0 if inside.all() else len(b) - int(inside.argmin())
        self.done.add(words_of(b[:cut]))
        self.open, self.high, self.wait = cut < len(b), False, Sums()
        self._more(b[cut:])

    def _more(self, s: np.ndarray) -> None:
        if not self.high and (s >= 0x80).any():
            self.high = True
            self.done.take(self.wait)
        (self.done if self.high else self.wait).add(s)

    def close(self) -> Tally:
        return self.done.tally()


class Text:
    """What stands outside of <...>; a stretch is taken if a < or the end follows."""

    def __init__(self):
        self.done, self.wait, self.outside = Sums(), Sums(), True

    def feed(self, b: np.ndarray) -> None:
        cuts = np.flatnonzero((b == 0x3C) | (b == 0x3E))
        if self.outside:
            self.wait.add(b[: cuts[0]] if len(cuts) else b)
        if not len(cuts):
            return
        if self.outside and self.wait.size and b[cuts[0]] == 0x3C:
            self.done.take(self.wait)
            self.done.add(_SPACE)
        self.done.add(text_of(b[cuts[0] : cuts[-1] + 1]))
        self.outside, self.wait = bool(b[cuts[-1]] == 0x3E), Sums()
        if self.outside:
            self.wait.add(b[cuts[-1] + 1 :])

    def close(self) -> Tally:
        if self.outside:
            self.done.take(self.wait)
        return self.done.tally()


class Characters:
    """A multi-byte prober that isn't asked before the end. The last character waits for the byte behind it."""

    def __init__(self, prober: MultiByte):
        self.prober, self.carry, self.before, self.over = prober, b"", 0, False

    def feed(self, piece: bytes, pack: Pack, last: bool = False) -> None:
        if self.over:
            return
        p, data = self.prober, self.carry + piece
        b, end, starts, sizes = layout(p.name).split(data)
        p.carry = data[end:]
        if p.carry and p.name == "GB2312" and _GB_FOUR.match(p.carry):
            p.state = FOUND_IT
        elif p.carry and not p._cut():
            p.state = NOT_ME
        self.over = p.state in (FOUND_IT, NOT_ME)
        if len(starts) and not self.over and not last:
            end, starts, sizes = int(starts[-1]), starts[:-1], sizes[:-1]
        p.count(b, starts, sizes, pack, self.before)
        self.carry, self.before = data[end:], data[end - 1] if end else self.before

    def close(self, pack: Pack) -> str:
        self.feed(b"", pack, True)
        p = self.prober
        if not self.over and p._enough() and p.confidence(pack) > SHORTCUT:
            p.state = FOUND_IT
        return p.state


class Escapes:
    """The escape charset whose sequence ends first: for each what may stand before its parts, in units, and the parts."""

    _PARTS = {
        "HZ-GB-2312": [(rb"[^~" + _BAD + rb"]|~~", rb"~\{"), (rb"~[^}" + _BAD + rb"]|[^~" + _BAD + rb"][^" + _BAD + rb"]", rb"~\}")],
        "ISO-2022-JP": [(rb"[^\x0e\x0f" + _BAD + rb"]", rb"\x1b(?:\$[@B]|\$\(D|\([BIJ])")],
        "ISO-2022-KR": [(rb"[^" + _BAD + rb"]", rb"\x1b\$\)C")],
    }
    _COMPILED = {n: [(regex.compile(rb"(?:" + u + rb")*+"), regex.compile(u), regex.compile(p)) for u, p in parts] for n, parts in _PARTS.items()}

    def __init__(self, lang_filter: int):
        self.alive = {k: (0, b"") for k, (_, _, bit, _) in enumerate(_ESCAPES) if lang_filter & bit}
        self.at, self.answer = 0, None

    def feed(self, piece: bytes) -> None:
        found = []
        for k, (part, carry) in list(self.alive.items()):
            data, at, parts = carry + piece, 0, self._COMPILED[_ESCAPES[k][0]]
            while True:
                units, unit, close = parts[part]
                at = units.match(data, at).end()
                m = close.match(data, at, partial=True)
                if m and not m.partial:
                    at, part = m.end(), part + 1
                    if part < len(parts):
                        continue
                    found.append((self.at - len(carry) + at, k))
                elif m or unit.fullmatch(data, at, partial=True):
                    self.alive[k] = part, data[at:]
                else:
                    del self.alive[k]
                break
        self.at += len(piece)
        if found:
            name, language, _, _ = _ESCAPES[min(found)[1]]
            self.answer, self.alive = (name, 0.99, language), {}


def probe_whole(pieces: Iterable[bytes], pack: Pack, lang_filter: int = ALL) -> HighByte:
    """All probers as after one feed of all pieces."""
    high, words, text = HighByte(bool(lang_filter & NON_CJK)), Words(), Text()
    utf8, *multi = high.groups[0][1]
    parts = [Characters(p) for p in multi]
    hebrew = [p for _, members in high.groups for p in members if isinstance(p, Hebrew)]
    for piece in pieces:
        utf8.feed(piece, pack, False)
        for p in parts:
            p.feed(piece, pack)
        for p in hebrew:
            p.feed({"raw": piece}, pack)
        b = np.frombuffer(piece, np.uint8)
        words.feed(b)
        text.feed(b)
    raw = {"words": words.close(), "tags": text.close()}
    own = {id(p.prober): p for p in parts}

    def step(name, p):
        if isinstance(p, Utf8):
            return p.conclude(pack)
        if isinstance(p, Hebrew):
            return p.state
        return own[id(p)].close(pack) if name == "mb" else p.feed(raw, pack)

    high.each(step, pack)
    return high


def detect_whole(read: Callable[[], Iterable[bytes]], pack: Pack, lang_filter: int = ALL, rename_legacy: bool = False) -> tuple:
    """The answer of a detector that is fed with all pieces at once; ``read`` gives them, each time from the beginning."""
    wide, escapes, head, last, high, escaped, win = Wide(), Escapes(lang_filter), b"", b"", False, False, False
    for piece in read():
        if len(head) < 4:
            head += piece[:4]
            if len(head) >= 4 and (name := _mark(head)):
                return name, 1.0, ""
        high = high or bool(_HIGH.search(piece))
        win = win or bool(_WIN.search(piece))
        escaped = escaped or bool(_ESC.search(last + piece))
        last = piece[-1:] or last
        wide.feed(piece, False)
        if not high:
            escapes.feed(piece)
    if not last:
        return NOTHING
    if name := _mark(head):
        return name, 1.0, ""
    if name := wide.name():
        return name, 0.85, ""
    if high:
        probed = probe_whole(read(), pack, lang_filter)
        name, confidence, language = probed.answer(pack)
        if probed.found:
            return name, confidence, language
        return (renamed_value(name, win, rename_legacy), confidence, language) if name is not None else NOTHING
    return (escapes.answer or NOTHING) if escaped else ("ascii", 1.0, "")


def _mark(head: bytes) -> str | None:
    return next((name for mark, name in BOMS if head.startswith(bytes.fromhex(mark))), None)
