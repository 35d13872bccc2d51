"""Latin spelling of text in other scripts: accents are dropped, Indic scripts are romanised."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDIC = re.compile("[ऀ-෿]")
#: Scripts (by their first code point) whose words drop the vowel that a last consonant implies.
_SILENT_END = (0x0900, 0x0980, 0x0A00, 0x0A80)
# What the letters that Unicode names by the left side sound like, where the name alone doesn't say.
_CONSONANTS = {"c": "ch", "ch": "chh", "ng": "n", "ny": "n", "ss": "sh", "tt": "t", "tth": "th", "dd": "d", "ddh": "dh", "nn": "n", "nnn": "n", "rr": "r", "ll": "l", "lll": "l", "khh": "kh", "ghh": "g", "dddh": "r", "yy": "y"}
_NUKTA = {"j": "z", "ph": "f", "d": "r", "dh": "rh", "k": "q"}
_CHILLU = {"nn": "n", "n": "n", "rr": "r", "l": "l", "ll": "l", "k": "k"}


@functools.cache
def _unit(ch: str) -> tuple[str, str]:
    """(kind, sound) of an Indic character, from its Unicode name."""
    name = unicodedata.name(ch, "")
    _, _, what = name.partition(" ")
    if what.startswith("LETTER CHILLU "):
        return "closed", _CHILLU.get(what[14:].lower(), "")
    if what == "LETTER KHANDA TA":
        return "closed", "t"
    vowel = re.fullmatch(r"(?:VOWEL SIGN|LETTER) (?:CANDRA |SHORT )?([AEIOU]{1,2}|VOCALIC [RL]{1,2})", what)
    if vowel:
        v = vowel[1].lower()
        v = v[8] + "i" if v.startswith("vocalic") else v
        return ("sign" if "SIGN" in what else "vowel"), v[0] if v in ("aa", "ii", "uu", "ee", "oo") else v
    if what.startswith("LETTER ") and what.endswith("A"):
        c = what[7:-1].lower()
        return "consonant", _CONSONANTS.get(c, c)
    if "VIRAMA" in what:
        return "virama", ""
    if "NUKTA" in what:
        return "nukta", ""
    if "CANDRABINDU" in what or "ANUSVARA" in what or "TIPPI" in what or "BINDI" in what:
        return "coda", "n"
    if "VISARGA" in what:
        return "coda", "h"
    if "DANDA" in what:
        return "space", " "
    digit = unicodedata.digit(ch, None)
    return ("vowel", str(digit)) if digit is not None else ("none", "om" if what == "OM" else "")


def romanize(text: str) -> str:
    """Indic text in Latin letters; text without any Indic character is returned as it is."""
    if not INDIC.search(text):
        return text
    text = unicodedata.normalize("NFC", text).translate({0x200C: None, 0x200D: None})
    units = [(*_unit(ch), ord(ch) - (ord(ch) - 0x900) % 0x80) if INDIC.match(ch) else ("other", ch, 0) for ch in text]
    units = [u for u in units if u[0] != "none" or u[1]]
    out: list[str] = []
    for i, (kind, sound, block) in enumerate(units):
        if kind == "nukta":
            continue
        after = next((u[0] for u in units[i + 1 :] if u[0] != "nukta"), "other")
        if kind != "consonant":
            out.append(sound)
            continue
        if i + 1 < len(units) and units[i + 1][0] == "nukta":
            sound = _NUKTA.get(sound, sound)
        out.append(sound)
        if after in ("sign", "virama"):
            continue
        joined = i > 0 and units[i - 1][0] == "virama"
        if after not in ("other", "space") or joined or block not in _SILENT_END:
            out.append("a")
    return "".join(out)


def latin(text: str) -> str:
    """Romanised, decomposed for compatibility and without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", romanize(text)) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _latin_udf(texts: pd.Series) -> pd.Series:
    return texts.map(latin, na_action="ignore")


def to_latin(text: Column) -> Column:
    """text in Latin letters; ASCII texts, which need nothing, aren't sent to Python."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _latin_udf(F.when(odd, text))).otherwise(text)
