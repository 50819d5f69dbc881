"""Words, stop words, Porter stems, key terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple("a about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split())


def normalise(text: Column) -> Column:
    """Lower case; every run of other characters than letters and digits is one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(normalise(text), " "), lambda w: w != "")


def keywords_column(text: Column, k: int, stem: bool = False) -> Column:
    """The k terms of one text by frequency, ties in alphabetical order (one document: the inverse document frequency is constant)."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1))
    if stem:
        kept = porter_column(kept)
    terms = F.array_distinct(kept)
    rated = F.transform(terms, lambda t: F.struct((-F.size(F.filter(kept, lambda w: w == t))).alias("n"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(rated), lambda s: s["t"]), 1, k)


def porter_column(array: Column) -> Column:
    @F.pandas_udf("array<string>")
    def go(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: None if ws is None else [porter(w) for w in ws])

    return go(array)


_V = "aeiou"


def _shape(stem: str) -> str:
    """Runs of consonants (C) and vowels (V)."""
    out = ""
    for i, c in enumerate(stem):
        kind = "V" if c in _V or (c == "y" and i > 0 and stem[i - 1] not in _V) else "C"
        if not out or out[-1] != kind:
            out += kind
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("VC")


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w[-3:]) == "CVC" and w[-1] not in "wxy" and not (w[-3] in _V)


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(w: str) -> str:
    """The stem of an English word by Porter's five steps."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "V" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz" and w[-1] not in _V:
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
