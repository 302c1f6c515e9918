"""Passages of documents around query terms, and highlighting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def match_positions(text, words: Sequence[str]) -> Column:
    """Positions, from 1, of the words among a text's terms."""
    words = [w.lower() for w in words]
    return F.array_compact(F.transform(T.tokens(text), lambda t, i: F.when(t.isin(*words), i + 1)))


def passages(docs: DataFrame, key: str, field: str, words: Sequence[str], context: int = 5, join: bool = True) -> DataFrame:
    """(key, start, end, positions, passage): windows of terms around matches, clipped at
    the field's ends; context -1 is the whole field. join: matches whose windows touch
    share one passage; else each has its own."""
    rows = docs.select(F.col(key).alias("key"), T.cased_tokens(F.col(field)).alias("toks"), match_positions(F.col(field), words).alias("at")).filter(F.size("at") > 0)
    n = F.size("toks")
    if context < 0:
        whole = rows.select("key", "toks", F.array(F.struct(F.lit(1).alias("s"), n.alias("e"), F.col("at").alias("p"))).alias("w"))
    else:
        one = F.transform("at", lambda p: F.struct(F.greatest(F.lit(1), p - context).alias("s"), F.least(n, p + context).alias("e"), F.array(p).alias("p")))
        if join:

            def add(acc, x):
                last = F.try_element_at(acc, F.lit(-1))
                grown = F.struct(last["s"].alias("s"), x["e"].alias("e"), F.concat(last["p"], x["p"]).alias("p"))
                return F.when((F.size(acc) > 0) & (x["s"] <= last["e"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

            one = F.aggregate(one, F.array().cast("array<struct<s:int,e:int,p:array<int>>>"), add)
        whole = rows.select("key", "toks", one.alias("w"))
    out = whole.select("key", "toks", F.explode("w").alias("w"))
    return out.select("key", F.col("w.s").alias("start"), F.col("w.e").alias("end"), F.col("w.p").alias("positions"), F.array_join(F.slice("toks", F.col("w.s"), F.col("w.e") - F.col("w.s") + 1), " ").alias("passage"))


def highlight(text, words: Sequence[str], before: str = "<b>", after: str = "</b>", encode: bool = False) -> Column:
    """The text with whole-word matches, in any case, between markers."""
    c = T.html_encode(text) if encode else (F.col(text) if isinstance(text, str) else text)
    alts = "|".join(sorted((re.escape(w) for w in words), key=lambda w: (-len(w), w)))
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])({alts})(?![\p{{L}}\p{{N}}])", f"{quote(before)}$1{quote(after)}")


def elide(text, most: int, mark: str = "...") -> Column:
    """The text cut to at most so many characters, with a mark where it was cut."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - len(mark))), F.lit(mark)))


def match_spans(text, words: Sequence[str]) -> Column:
    """array<struct<term, start, end>> of character spans of matches, from 0."""
    c = F.col(text) if isinstance(text, str) else text
    alts = "|".join(sorted((re.escape(w) for w in words), key=lambda w: (-len(w), w)))
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{alts})(?![\p{{L}}\p{{N}}])"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    rest = F.split(c, pattern)
    empty = F.array().cast("array<struct<term:string,start:int,end:int>>")

    def add(acc, m):
        gone = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        start = gone + F.length(F.get(rest, F.size(acc)))
        return F.concat(acc, F.array(F.struct(m.alias("term"), start.alias("start"), (start + F.length(m)).alias("end"))))

    return F.aggregate(found, empty, add)


@dataclass(frozen=True)
class PassageSpec:
    """kind: join (one passage from a field's first match to its last) or unique (one for
    each match); context in terms and most in characters, -1 for no limit; sort: the
    passages of most query words first, else in text order."""

    kind: str = "join"
    context: int = -1
    most: int = -1
    sort: bool = False

    def __post_init__(self):
        if self.kind not in ("join", "unique"):
            raise ValueError(f"unknown passage type {self.kind}")


class PassageBuilder:
    """Passages of several fields, each by its own rules, in one scan of the documents."""

    def __init__(self, words: Sequence[str], before: str = "<b>", after: str = "</b>", encode: bool = False):
        self.words = sorted({w.lower() for w in words})
        self.marks = (before, after, encode)
        self.specs: dict[str | None, PassageSpec] = {}

    def field(self, name: str | None, kind: str = "join", context: int = -1, most: int = -1, sort: bool = False) -> PassageBuilder:
        """Rules of a field; of all other string columns where name is None."""
        self.specs[name.lower() if name is not None else None] = PassageSpec(kind, context, most, sort)
        return self

    def _of(self, text: Column, spec: PassageSpec) -> Column:
        toks, at = T.cased_tokens(text), match_positions(text, self.words)
        n = F.size(toks)
        span = lambda lo, hi: (F.lit(1), n) if spec.context < 0 else (F.greatest(F.lit(1), lo - spec.context), F.least(n, hi + spec.context))

        def one(p: Column, lo: Column, hi: Column) -> Column:
            start, end = span(lo, hi)
            terms = F.transform(p, lambda i: F.lower(F.get(toks, i - 1)))
            score = F.size(F.array_distinct(terms)) / F.lit(float(max(1, len(self.words))))
            words = F.array_join(F.slice(toks, start, end - start + 1), " ")
            return F.struct((-score if spec.sort else F.lit(0.0)).alias("order"), start.alias("start"), end.alias("end"), p.alias("positions"), terms.alias("terms"), score.alias("score"), words.alias("whole"), (words if spec.most < 0 else elide(words, spec.most)).alias("passage"))

        if spec.kind == "unique":
            out = F.transform(at, lambda p: one(F.array(p), p, p))
        else:
            out = F.transform(F.filter(F.array(at), lambda a: F.size(a) > 0), lambda a: one(a, F.array_min(a), F.array_max(a)))
        return F.sort_array(out)

    def passages(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, field, n, start, end, positions, terms, score, whole, passage, highlighted):
        n counts a field's passages from 1, score is the share of the query's words, passage
        is cut to the field's size, whole is not. Null texts have none."""
        kinds = dict(docs.dtypes)
        parts = []
        for c in docs.columns:
            spec = self.specs.get(c.lower(), self.specs.get(None) if kinds[c] == "string" else None)
            if c == key or spec is None:
                continue
            text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
            parts.append(F.struct(F.lit(c).alias("field"), self._of(text, spec).alias("ps")))
        rows = docs.select(F.col(key).alias("key"), F.explode(F.array(*parts)).alias("f"))
        rows = rows.select("key", F.col("f.field").alias("field"), F.posexplode("f.ps").alias("_i", "p"))
        before, after, encode = self.marks
        marked = highlight(F.col("p.passage"), self.words, before, after) if not encode else highlight(T.html_encode(F.col("p.passage")), self.words, before, after)
        names = ["start", "end", "positions", "terms", "score", "whole", "passage"]
        return rows.select("key", "field", (F.col("_i") + 1).alias("n"), *[F.col(f"p.{x}").alias(x) for x in names], marked.alias("highlighted"))
