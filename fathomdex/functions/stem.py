"""Porter's stemmer (the published algorithm) and light inflection rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS or (w[i] == "y" and i > 0 and not _is_vowel(w, i - 1))


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    kinds = [_is_vowel(stem, i) for i in range(len(stem))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _is_vowel(w, n - 1) and _is_vowel(w, n - 2) and not _is_vowel(w, n - 3) and w[-1] not in "wxy"


#: Suffix rules of steps 2, 3 and 4 (fixed values of the published algorithm).
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = tuple("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())


def porter(word: str) -> str:
    w = word.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stem_lists(lists: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}

    def one(w):
        if w not in memo:
            memo[w] = porter(w)
        return memo[w]

    return lists.map(lambda a: None if a is None else [one(w) for w in a])


def porter_tokens(toks: Column) -> Column:
    """Stems of an array of terms, in Arrow batches."""
    return F.pandas_udf(_stem_lists, "array<string>")(toks)


def _english(w: str) -> set[str]:
    out = {w + "s", w + "'s", w + "ed", w + "ing"}
    if w.endswith("e"):
        out |= {w + "d", w[:-1] + "ing"}
    if w.endswith("y") and len(w) > 2 and w[-2] not in _VOWELS:
        out |= {w[:-1] + "ies", w[:-1] + "ied"}
    if w.endswith(("s", "x", "z", "ch", "sh")):
        out.add(w + "es")
    for end, news in (("ies", ("y",)), ("es", ("", "e")), ("s", ("",)), ("ied", ("y",)), ("ed", ("", "e")), ("ing", ("", "e"))):
        if w.endswith(end) and len(w) - len(end) >= 3:
            for new in news:
                base = w[: -len(end)] + new
                out |= {base, base + "s", base + "ed" if not base.endswith("e") else base + "d", (base[:-1] if base.endswith("e") else base) + "ing"}
            break
    return out


def _german(w: str) -> set[str]:
    out = {w + e for e in ("e", "en", "er", "es", "n", "s", "em")}
    for e in ("en", "er", "es", "em", "e", "n", "s"):
        if w.endswith(e) and len(w) - len(e) >= 3:
            out |= {w[: -len(e)] + x for x in ("", "e", "en", "er", "es")}
            break
    return out


def _spanish(w: str) -> set[str]:
    out = {w + "s", w + "es"}
    for e, news in (("es", ("",)), ("s", ("",)), ("o", ("a", "os", "as")), ("a", ("o", "os", "as")), ("ar", ("o", "a", "an", "ando", "ado")), ("er", ("o", "e", "en", "iendo", "ido")), ("ir", ("o", "e", "en", "iendo", "ido"))):
        if w.endswith(e) and len(w) - len(e) >= 2:
            out |= {w[: -len(e)] + x for x in news}
    return out


def variants(word: str, language: str = "en") -> list[str]:
    """Inflected forms of a word, in its casing, without the word itself."""
    rules = {"en": _english, "de": _german, "es": _spanish}[language]
    found = sorted(x for x in rules(word.lower()) if x != word.lower() and len(x) > 1)
    if word.isupper() and len(word) > 1:
        return [x.upper() for x in found]
    if word[:1].isupper():
        return [x[:1].upper() + x[1:] for x in found]
    return found


class Morphology:
    """Knowledge source: inflections of a term."""

    def __init__(self, language: str = "en"):
        self.language = language

    def variants_of(self, term: str) -> list[str]:
        return variants(term, self.language)


class Combined:
    """Knowledge source: the union of several."""

    def __init__(self, *sources):
        self.sources = sources

    def variants_of(self, term: str) -> list[str]:
        return sorted({v for s in self.sources for v in s.variants_of(term)})


class Sequenced:
    """Knowledge source: the first of several that knows the term."""

    def __init__(self, *sources):
        self.sources = sources

    def variants_of(self, term: str) -> list[str]:
        return next((got for s in self.sources if (got := s.variants_of(term))), [])
