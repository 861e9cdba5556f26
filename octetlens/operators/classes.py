"""Class models of the two Western charsets without a language model.

Their values are fixed. A byte's class follows from its character's Unicode name by one rule, so the two tables of 256 are
built from it; the bytes below are the exceptions.
"""

from __future__ import annotations

import unicodedata

import numpy as np

UDF, OTH, ASC, ASS, ACV, ACO, ASV, ASO, ODD = range(9)
#: Bytes that get another class than their character's. Fixed values.
LATIN1_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
LATIN1_SMALL_OTHER = (0x83, 0x9A, 0x9C, 0x9E)
LATIN1_CAPITAL_OTHER = (0x8A, 0x8C, 0x8E, 0x9F, 0xDF)
MACROMAN_ODD = (0xAA, 0xAB, 0xC2, 0xC4, 0xD7, 0xDA, 0xF0, *range(0xF6, 0x100))
MACROMAN_CAPITAL_VOWEL = (0xAE, 0xCE, 0xD9, 0xF1)
MACROMAN_CAPITAL_OTHER = (0x82, 0x84)
MACROMAN_SMALL_VOWEL = (0xBE, 0xBF, 0xCF, 0xD8, 0xF5)
MACROMAN_SMALL_OTHER = (0x8D, 0x96, 0xA7)
MACROMAN_OTHER = (0xDE, 0xDF)
#: Pairs of classes of low value: (first, second) -> value; all other pairs of defined classes have 3.
PENALTIES = {
    (ASS, ACV): 1, (ASS, ACO): 1,
    (ACV, ACV): 1, (ACV, ACO): 2, (ACV, ASV): 1, (ACV, ASO): 2,
    (ASV, ASC): 1, (ASV, ACV): 1, (ASV, ACO): 1, (ASV, ASV): 1,
    (ASO, ASC): 1, (ASO, ACV): 1, (ASO, ACO): 1,
}


def _letter_class(c: str) -> int:
    name = unicodedata.name(c, "")
    if not c.isalpha() or not name.startswith("LATIN "):
        return OTH
    base = unicodedata.normalize("NFD", c)[0]
    if c.isascii():
        return ASC if c.isupper() else ASS
    vowel = base.upper() in "AEIOU" or "LETTER O WITH STROKE" in name
    if c.isupper():
        return ACV if vowel else ACO
    return ASV if vowel else ASO


def latin1_classes() -> np.ndarray:
    out = np.array([_letter_class(chr(b)) for b in range(256)])
    out[0x80:0xC0] = OTH
    out[list(LATIN1_UNDEFINED)] = UDF
    out[list(LATIN1_SMALL_OTHER)] = ASO
    out[list(LATIN1_CAPITAL_OTHER)] = ACO
    return out


def macroman_classes() -> np.ndarray:
    out = np.array([_letter_class(bytes([b]).decode("mac_roman")) for b in range(256)])
    for bytes_, kind in ((MACROMAN_CAPITAL_VOWEL, ACV), (MACROMAN_CAPITAL_OTHER, ACO), (MACROMAN_SMALL_VOWEL, ASV), (MACROMAN_SMALL_OTHER, ASO), (MACROMAN_OTHER, OTH), (MACROMAN_ODD, ODD)):
        out[list(bytes_)] = kind
    return out


def class_model() -> np.ndarray:
    """Value of each pair of classes: 0 for undefined bytes, 1 for odd ones."""
    out = np.full((9, 9), 3)
    for (a, b), value in PENALTIES.items():
        out[a, b] = value
    out[ODD, :] = out[:, ODD] = 1
    out[UDF, :] = out[:, UDF] = 0
    return out
