"""Text functions: case folding, token counts, plain tokens, and the stemmed tokens of the full-text index."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def contains_ignoring_case(c: Column, part: str) -> Column:
    """LIKE '%part%' with part taken literally: ASCII letters match in either case."""
    return F.contains(ascii_lower(c), F.lit(part.translate(str.maketrans(UPPER, LOWER))))


def fields(c: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def approx_tokens(c: Column) -> Column:
    """One and a half times the words, rounded down."""
    return F.floor(F.size(fields(c)) * 3 / 2).cast("int")


def has_alphanumeric(c: Column) -> Column:
    """Whether there is a letter or a decimal digit."""
    return c.rlike(r"[\p{L}\p{Nd}]")


def plain_tokens(c: Column) -> Column:
    """Lower-case runs of letters and numbers, unstemmed."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


# Suffix rules of Porter's 1980 stemmer, in the order of the published algorithm: (suffix, replacement).
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _form(stem: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _ends_cvc(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    return max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)


def porter(word: str) -> str:
    """The stem of an ASCII word of 3 to 64 bytes; anything else is its own stem."""
    size = len(word.encode())
    if size <= 2 or size > 64 or not all("a" <= c <= "z" for c in word):
        return word
    if word.endswith("sses") or word.endswith("ies") and size > 3:
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed") and len(word) > 3:
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if "v" in _form(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word[-1:] == word[-2:-1] and word[-1] not in "aeioulsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _ends_cvc(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if (rule := _longest(word, rules)) and _measure(word[: -len(rule[0])]) > 0:
            word = word[: -len(rule[0])] + rule[1]
    if rule := _longest(word, [(s, "") for s in STEP_4]):
        stem = word[: -len(rule[0])]
        if _measure(stem) > 1 and (rule[0] != "ion" or stem[-1:] in ("s", "t")):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _ends_cvc(stem):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@functools.lru_cache(100_000)
def fold(c: str) -> str:
    """A character as the index sees it: '' for a separator, else lower case without its only diacritic if the base is ASCII; a lone mark is dropped."""
    kind = unicodedata.category(c)
    if kind[0] == "M":
        return "\0"
    if kind[0] not in "LN" and kind != "Co":
        return ""
    low = c.lower() if len(c.lower()) == 1 else {"İ": "i"}.get(c, c)
    parts = unicodedata.normalize("NFD", low)
    if len(parts) == 2 and parts[0].isascii() and unicodedata.category(parts[1])[0] == "M":
        return parts[0]
    return low


class _Folds(dict):
    """For str.translate(): what the index makes of each character, found when it is first met."""

    def __missing__(self, code: int) -> str:
        folded = fold(chr(code))
        self[code] = out = " " if folded == "" else "" if folded == "\0" else folded
        return out


class _Stems(dict):
    """Stems by word; starts anew after so many."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = porter(word)
        return out


_FOLDS, _STEMS = _Folds(), _Stems()


def fts_tokens(text: str | None) -> list[str]:
    """Stems of the runs of letters, numbers and private characters."""
    return list(map(_STEMS.__getitem__, text.translate(_FOLDS).split())) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def fts_tokens_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fts_tokens)
