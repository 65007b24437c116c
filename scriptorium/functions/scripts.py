"""Indic scripts in Latin letters. The blocks of the scripts are laid out alike, so that one table by offset serves all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T

#: Latin letters without marks by the offset in a block of 128: vowels, consonants, vowel signs, others. Fixed values.
VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "r", 0x0C: "l", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split(), strict=True))
NUKTA = {0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y"}
SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "r", 0x44: "r", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
OTHERS = {0x01: "m", 0x02: "m", 0x03: "h", 0x3C: "", 0x3D: "", 0x4D: "", 0x64: " ", 0x65: " "}
#: First code points of the blocks.
BLOCKS = [first for name, (first, _) in L.SCRIPTS.items() if name != "Latin"]
_INHERENT = ""


def _at(offsets) -> str:
    return "".join(chr(b + o) for b in BLOCKS for o in offsets)


def _table() -> dict[str, str]:
    parts = VOWELS | CONSONANTS | NUKTA | SIGNS | OTHERS | {0x66 + i: str(i) for i in range(10)}
    return {chr(b + o): latin for b in BLOCKS for o, latin in parts.items()} | {_INHERENT: "a", "।": " ", "॥": " "}


TABLE = _table()


def romanised(t: Column) -> Column:
    """A consonant has an "a" unless a vowel sign or a virama follows."""
    consonants, signs = _at([*CONSONANTS, *NUKTA]), _at([*SIGNS, 0x4D])
    voiced = F.regexp_replace(F.coalesce(t, F.lit("")), f"([{consonants}][{_at([0x3C])}]?)(?![{signs}{_at([0x3C])}])", f"$1{_INHERENT}")
    known = F.create_map(*(F.lit(x) for kv in TABLE.items() for x in kv))
    return F.array_join(F.transform(F.split(voiced, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")


def roman_slug(t: Column, most: int = 60) -> Column:
    """A title's slug in ASCII letters, whichever script it is in."""
    return T.slug(romanised(t), most)
