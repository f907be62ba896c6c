"""Porter stemming of word tokens (the published suffix-stripping algorithm with its common later extensions)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"
# Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix rules of the algorithm's second, third and fourth steps.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
         "iti", "ous", "ive", "ize")


def _consonant(word: str, i: int) -> bool:
    if word[i] in VOWELS:
        return False
    return word[i] != "y" or i == 0 or not _consonant(word, i - 1)


def _shape(stem: str) -> str:
    kinds: list[bool] = []
    for i, letter in enumerate(stem):
        vowel = letter in VOWELS or (letter == "y" and i > 0 and not kinds[i - 1])
        kinds.append(vowel)
    return "".join("v" if k else "c" for k in kinds)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _ends_cvc(word: str) -> bool:
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[:len(word) - len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    stem = next((word[:-len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in _shape(word[:-len(x)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _ends_double(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _consonant(word, len(word) - 2):
        return word[:-1] + "i"
    return word


def _long_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _long_suffix(word[:-4] + "al")
    for suffix, new in STEP2:
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return word


def _middle_suffix(word: str) -> str:
    for suffix, new in STEP3:
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _bare(word: str) -> str:
    for suffix in STEP4:
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                return stem
            if suffix != "ion":
                return word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def porter_stem(word: str) -> str:
    """Stem of one lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _long_suffix, _middle_suffix, _bare, _tidy):
        word = step(word)
    return word


def _stem_arrays(tokens: pa.Array) -> pa.Array:
    """Stem each distinct token of the batch once; tokens of up to three letters stay."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([porter_stem(w) if len(w) > 3 else w for w in words.dictionary.to_pylist()], type=pa.string())
    flat = stems.take(words.indices)
    lengths = tokens.value_lengths().fill_null(0).to_pylist()
    offsets = [0]
    for n in lengths:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)


def stem_tokens(tokens: Column) -> Column:
    """Stem an array of tokens."""
    return F.arrow_udf(_stem_arrays, "array<string>")(tokens)
