"""A document's detector: chunks in, one answer out. One feed of everything is one-shot detection."""

from __future__ import annotations

import numpy as np
import regex

from ..functions.bytesx import BOMS, ESC_ASCII, HIGH_BYTE, PURE_ASCII
from ..functions.renames import renamed_value
from .models import Pack
from .probers import MINIMUM, HighByte

#: Bits of the language filter. Fixed values.
CHINESE_SIMPLIFIED, CHINESE_TRADITIONAL, JAPANESE, KOREAN, NON_CJK = 1, 2, 4, 8, 16
ALL = 31
NOTHING = (None, 0.0, None)

_BAD = rb"\x00\x1b\x80-\xff"
#: Escape sequences in order, with the bits of the filter that ask for them. Each pattern is what its machine accepts.
ESCAPES = [
    ("HZ-GB-2312", "Chinese", CHINESE_SIMPLIFIED, rb"(?:[^~" + _BAD + rb"]|~~)*+~\{(?:~[^}" + _BAD + rb"]|[^~" + _BAD + rb"][^" + _BAD + rb"])*+~\}"),
    ("ISO-2022-JP", "Japanese", JAPANESE, rb"[^\x0e\x0f" + _BAD + rb"]*+\x1b(?:\$[@B]|\$\(D|\([BIJ])"),
    ("ISO-2022-KR", "Korean", KOREAN, rb"[^" + _BAD + rb"]*+\x1b\$\)C"),
]
_ESCAPES = [(name, language, bit, regex.compile(p)) for name, language, bit, p in ESCAPES]
_HIGH, _ESC, _WIN = regex.compile(rb"[\x80-\xff]"), regex.compile(rb"\x1b|~\{"), regex.compile(rb"[\x80-\x9f]")
_SURROGATES = regex.compile(rb"(?:[^\xd8-\xdf]|[\xd8-\xdb][\xdc-\xdf])*+[\xd8-\xdb]?", regex.DOTALL)


def escape_answer(data: bytes, lang_filter: int = ALL) -> tuple | None:
    """The escape charset whose sequence ends first."""
    ends = [(m.end(), k) for k, (_, _, bit, p) in enumerate(_ESCAPES) if lang_filter & bit and (m := p.match(data))]
    if not ends:
        return None
    name, language, _, _ = _ESCAPES[min(ends)[1]]
    return name, 0.99, language


class Wide:
    """UTF-16 and UTF-32 without mark, by zero bytes at positions modulo four."""

    def __init__(self):
        self.n, self.zeros, self.others, self.cut, self.bad, self.given_up = 0, np.zeros(4, np.int64), np.zeros(4, np.int64), b"", set(), False
        self.lead = {"be": b"", "le": b""}

    def feed(self, chunk: bytes, conclude: bool = True) -> str | None:
        """Name if ``conclude``; else all chunks are counted, and ``name`` tells at the end."""
        if self.given_up:
            return None
        b = np.frombuffer(chunk, np.uint8)
        at = (np.arange(len(b)) + self.n) % 4
        self.zeros += np.bincount(at[b == 0], minlength=4)
        self.others += np.bincount(at[b != 0], minlength=4)
        self.n += len(b)
        data = self.cut + chunk
        whole = len(data) - len(data) % 4
        self.cut = data[whole:]
        if (self.zeros.any() or not conclude) and whole:
            q = np.frombuffer(data, np.uint8, whole).reshape(-1, 4)
            for end, order in (("be", (0, 1, 2)), ("le", (3, 2, 1))):
                high, plane, lead = (q[:, k] for k in order)
                if ((high != 0) | (plane > 0x10) | (plane == 0) & (lead >= 0xD8) & (lead <= 0xDF)).any():
                    self.bad.add("32" + end)
                if "16" + end in self.bad:
                    continue
                leads = self.lead[end] + data[(0 if end == "be" else 1) : whole : 2]
                if not _SURROGATES.fullmatch(leads):
                    self.bad.add("16" + end)
                self.lead[end] = leads[-1:] if 0xD8 <= leads[-1] <= 0xDB and "16" + end not in self.bad else b""
        if not conclude:
            return None
        name = self.name()
        self.given_up = name is None and self.n > 4096
        return name

    def name(self) -> str | None:
        def most(parts, whole):
            return whole >= 20 and all(p / whole > 0.94 for p in parts)

        z, o, c32, c16 = self.zeros, self.others, max(1.0, self.n / 4.0), max(1.0, self.n / 2.0)
        likely = {
            "32be": most((z[0], z[1], z[2], o[3]), c32),
            "32le": most((o[0], z[1], z[2], z[3]), c32),
            "16be": most((o[1] + o[3], z[0] + z[2]), c16),
            "16le": most((o[0] + o[2], z[1] + z[3]), c16),
        }
        return next((f"utf-{k}" for k, yes in likely.items() if yes and k not in self.bad), None)


class Detector:
    """State of one document between chunks."""

    def __init__(self, lang_filter: int = ALL, rename_legacy: bool = False):
        self.lang_filter, self.rename_legacy = lang_filter, rename_legacy
        self.reset()

    def reset(self) -> None:
        self.result, self.done, self.started, self.input_state = NOTHING, False, False, PURE_ASCII
        self.last, self.has_win_bytes, self.wide, self.escaped, self.high = b"", False, Wide(), b"", None
        self.escape_found = False

    def feed(self, chunk: bytes, pack: Pack) -> bool:
        """Takes the next chunk; returns whether the answer is known."""
        if self.done or not chunk:
            return self.done
        if not self.started:
            self.started = True
            for mark, name in BOMS:
                if chunk.startswith(bytes.fromhex(mark)):
                    self.result, self.done = (name, 1.0, ""), True
                    return True
        if self.input_state == PURE_ASCII:
            if _HIGH.search(chunk):
                self.input_state = HIGH_BYTE
            elif _ESC.search(self.last + chunk):
                self.input_state = ESC_ASCII
        self.last = chunk[-1:]
        if name := self.wide.feed(chunk):
            self.result, self.done = (name, 0.85, ""), True
        elif self.input_state == ESC_ASCII:
            self.escaped += chunk
            if found := escape_answer(self.escaped, self.lang_filter):
                self.result, self.done = found, True
        elif self.input_state == HIGH_BYTE:
            self.high = self.high or HighByte(bool(self.lang_filter & NON_CJK))
            if self.high.feed(chunk, pack):
                self.result, self.done = self.high.answer(pack), True
            self.has_win_bytes |= bool(_WIN.search(chunk))
        return self.done

    def close(self, pack: Pack) -> tuple:
        if not self.done:
            self.done = True
            if self.started and self.input_state == PURE_ASCII:
                self.result = ("ascii", 1.0, "")
            elif self.high is not None:
                name, confidence, language = self.high.answer(pack)
                if name is not None:
                    self.result = (renamed_value(name, self.has_win_bytes, self.rename_legacy), confidence, language)
        return self.result

    def candidates(self, pack: Pack, ignore_threshold: bool = False) -> list[tuple]:
        """All answers after close, best first; equals keep the order of the probers."""
        if self.input_state == HIGH_BYTE and self.high is not None:
            rows = [r for r in self.high.rows(pack) if ignore_threshold or r.confidence > MINIMUM]
            found = [(renamed_value(r.charset, self.has_win_bytes, self.rename_legacy), r.confidence, r.language) for r in rows]
            if found:
                return sorted(found, key=lambda x: -x[1])
        return [self.result]
