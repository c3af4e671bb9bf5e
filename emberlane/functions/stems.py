"""Porter stems of English words, for ranking."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Endings of the published stemmer with what they become, by step.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def closed_short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def replaced(word: str, endings, least: int) -> str:
    """The longest ending that fits goes if what is before it measures more than least."""
    for ending, put in sorted(endings, key=lambda x: -len(x[0])):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + put if measure(stem) > least else word
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of a lower-case ASCII word of 3 to 64 letters; others stay."""
    if not 3 <= len(word) <= 64 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        double = len(cut) > 1 and cut[-1] == cut[-2] and shape(cut)[-1] == "c"
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif double and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if measure(cut) == 1 and closed_short(cut) else cut
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(word, STEP_2, 0)
    word = replaced(word, STEP_3, 0)
    for ending in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not closed_short(stem)):
            word = stem
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda row: None if row is None else [porter(w) for w in row])


def stem_words(words: Column) -> Column:
    """Stems of an array of lower-case words, in order; null stays null. Arrow batches; a worker keeps stems it has met."""
    return F.pandas_udf(_stems, ArrayType(StringType()))(words)


#: The same of one word, for operators that count words in Python.
stem_words.word = porter
