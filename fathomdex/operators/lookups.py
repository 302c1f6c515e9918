"""Dictionary and field lookups: term statistics, field values, spelling, substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.relations import pattern_score


def terms(index) -> DataFrame:
    """(term, ft) of the dictionary."""
    return index.postings.select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("ft"))


def term_range(index, low: str, high: str) -> DataFrame:
    return terms(index).filter(F.col("term").between(low, high)).orderBy("term")


def wildcard_terms(index, pattern: str) -> DataFrame:
    return terms(index).filter(F.col("term").rlike(T.wildcard(pattern.lower())))


def substring_terms(index, part: str, how: str = "contains") -> DataFrame:
    """Terms that contain, start or end with a part."""
    c = F.col("term")
    ok = {"contains": c.contains, "starts": c.startswith, "ends": c.endswith}[how](part.lower())
    return terms(index).filter(ok)


def stem_matches(index, word: str, cutoff: float = 0.65, least: int = 3) -> DataFrame:
    """Terms that begin like the word and share enough of their length with it."""
    word = word.lower()
    head = word[: max(len(word) // 2, min(least, len(word)))]
    ratio = T.stem_ratio("term", word)
    return terms(index).filter(F.col("term").startswith(head) & (ratio >= cutoff)).select("term", ratio.alias("ratio"))


def spelling(index, word: str, n: int = 10, shared: float = 1.0) -> DataFrame:
    """(term, score) of likely spellings, the best (smallest) n. Candidates hold at least
    the given share of the word's character pairs; a score is twice the edit distance (half
    for none) over the logarithm of the document frequency."""
    word = word.lower()
    pairs = sorted({word[i : i + 2] for i in range(len(word) - 1)}) or [word]
    have = F.size(F.array_intersect(T.bigrams("term"), F.array(*[F.lit(p) for p in pairs])))
    lev = F.levenshtein("term", F.lit(word))
    score = 2 * F.when(lev == 0, F.lit(0.5)).otherwise(lev) / F.log(F.greatest(F.col("ft"), F.lit(2)))
    found = terms(index).filter(have >= shared * len(pairs))
    return found.select("term", score.alias("score")).orderBy("score", "term").limit(n)


def variations(index, word: str, knowledge=None) -> DataFrame:
    """The inflections of a word that are in the dictionary."""
    from ..functions.stem import Morphology

    words = [w.lower() for w in (knowledge or Morphology()).variants_of(word)]
    return terms(index).filter(F.col("term").isin(word.lower(), *words))


def _values(index, field: str):
    spec = index.fields[field.lower()]
    c = F.explode(field) if spec.multiple else F.col(field)
    return index.docs.select(F.col(index.key).alias("key"), c.alias("value")).filter("value is not null")


def field_values(index, field: str, ignore_case: bool = False) -> DataFrame:
    """(value, freq) in order; without case, spellings are merged."""
    v = F.lower("value") if ignore_case else F.col("value")
    return _values(index, field).groupBy(v.alias("value")).agg(F.count("*").alias("freq")).orderBy("value")


def top_values(index, field: str, n: int = -1) -> DataFrame:
    """The n most frequent values (all, if n is below 0), ties by value."""
    out = field_values(index, field).orderBy(F.col("freq").desc(), "value")
    return out if n < 0 else out.limit(n)


def matching_values(index, field: str, pattern: str) -> DataFrame:
    """(value, score) of values that match a wildcard pattern."""
    spec = index.fields[field.lower()]
    fold = (lambda c: c) if spec.case_sensitive else F.lower
    p = pattern if spec.case_sensitive else pattern.lower()
    vals = _values(index, field).select("value").distinct()
    return vals.filter(fold(F.col("value")).rlike(T.wildcard(p))).select("value", pattern_score(p, F.col("value")).alias("score"))


def all_values(index, field: str, key) -> DataFrame:
    return _values(index, field).filter(F.col("key") == F.lit(key)).select("value")
