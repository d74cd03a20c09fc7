"""English word stems after Porter (1980), as rule tables, with the later additions that common ROUGE scorers use."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published suffix rules, in the order of the paper. A step's longest fitting suffix decides.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
AFTER_ED_ING = {"at": "ate", "bl": "ble", "iz": "ize"}
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# Whole words that the rules would spoil.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}


def shape(word: str) -> str:
    """``c`` or ``v`` for each letter; a ``y`` after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    form = shape(word)
    return (form.endswith("cvc") and word[-1] not in "wxy") or form == "vc"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def swapped(word: str, table: dict[str, str], least: int) -> str:
    """The word with its longest suffix of the table replaced, if what is left has the measure."""
    suffix = longest(word, table)
    if suffix is None or measure(word[: -len(suffix)]) < least:
        return word
    return word[: -len(suffix)] + table[suffix]


def singular(word: str) -> str:
    if len(word) == 4 and word.endswith("ies"):
        return word[:-1]
    suffix = longest(word, PLURALS)
    return word if suffix is None else word[: -len(suffix)] + PLURALS[suffix]


def without_tense(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    suffix = longest(word, ("ed", "ing"))
    stem = word[: -len(suffix)] if suffix else ""
    if "v" not in shape(stem):
        return word
    ending = longest(stem, AFTER_ED_ING)
    if ending:
        return stem[: -len(ending)] + AFTER_ED_ING[ending]
    if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and short_end(stem) else stem


def second(word: str) -> str:
    if word.endswith("logi"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    new = swapped(word, SECOND, 1)
    return second(new) if word.endswith("alli") and new != word else new


def fourth(word: str) -> str:
    suffix = longest(word, FOURTH)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    return stem if measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st") else word


def last_letters(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of up to two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    word = without_tense(singular(word))
    if word.endswith("y") and len(word) > 2 and shape(word)[-2] == "c":
        word = word[:-1] + "i"
    return last_letters(fourth(swapped(second(word), THIRD, 1)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of the words over three letters of each list; a task works a word out once and remembers a bounded number."""
    return words.map(lambda row: None if row is None else [stem(w) if len(w) > 3 else w for w in row])
