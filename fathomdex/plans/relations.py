"""Relations on saved fields as columns: whether a document matches, and how well."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import ast as A


class QueryError(ValueError):
    pass


def _value(spec, value):
    """A literal of the field's type; text that is no such value is an error."""
    try:
        if spec.type == "integer":
            return F.lit(int(value))
        if spec.type == "float":
            return F.lit(float(value))
    except (TypeError, ValueError):
        raise QueryError(f"{value!r} is no {spec.type} for {spec.name}") from None
    if spec.type == "date":
        if isinstance(value, dt.datetime):
            return F.lit(value)
        if isinstance(value, dt.date):
            return F.lit(dt.datetime(value.year, value.month, value.day))
        return T.parse_date(F.lit(str(value)))
    return F.lit(str(value))


def _midnight(spec, value) -> bool:
    """Does a date value name a whole day?"""
    if spec.type != "date":
        return False
    if isinstance(value, dt.datetime):
        return value == value.replace(hour=0, minute=0, second=0, microsecond=0)
    return not isinstance(value, str) or ":" not in value


def _sensitive(spec, value) -> bool:
    """Strings compare without case unless the field is sensitive or the value mixed."""
    v = str(value)
    return spec.case_sensitive or (v != v.lower() and v != v.upper())


def pattern_score(pattern: str, value: Column) -> Column:
    n = len(pattern.replace("*", "").replace("?", ""))
    if not n and pattern and set(pattern) <= {"*"}:
        return F.lit(1.0)
    return F.least(F.lit(1.0), F.lit(float(n)) / F.length(value))


def one(spec, op: str, value, c: Column) -> tuple[Column, Column]:
    """(matches, score) of one value c."""
    if op in ("=", "<", "<=", ">", ">="):
        if spec.type == "string" and not _sensitive(spec, value):
            c, v = F.lower(c), F.lit(str(value).lower())
        else:
            v = _value(spec, value)
        day = F.make_dt_interval(F.lit(1))
        if _midnight(spec, value):
            ok = {"=": (c >= v) & (c < v + day), "<": c < v, "<=": c < v + day, ">": c >= v + day, ">=": c >= v}[op]
        else:
            ok = {"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
        return ok, F.lit(0.0)
    if spec.type != "string":
        raise QueryError(f"{op} needs a string field; {spec.name} is {spec.type}")
    v = str(value)
    raw = c
    if not _sensitive(spec, v):
        c, v = F.lower(c), v.lower()
    if op == "matches":
        return c.rlike(T.wildcard(v)), pattern_score(v, raw)
    if op == "substring":
        return c.contains(v), pattern_score(v, raw)
    if op == "starts":
        return c.startswith(v), pattern_score(v, raw)
    if op == "ends":
        return c.endswith(v), pattern_score(v, raw)
    raise QueryError(f"unknown relation {op}")


def relation(spec, node) -> tuple[Column, Column]:
    """(matches, score) of a document; of several values any may match, the best scores."""
    c = F.col(spec.name)
    if isinstance(node, A.Undefined):
        gone = c.isNull() | (F.size(c) == 0) if spec.multiple else c.isNull()
        return gone, F.lit(0.0)
    if not spec.saved:
        return F.lit(False), F.lit(0.0)
    if isinstance(node, A.Range):
        low = ">" if node.low_open else ">="
        high = "<" if node.high_open else "<="

        def both(x):
            return one(spec, low, node.low, x)[0] & one(spec, high, node.high, x)[0]

        ok = F.exists(c, both) if spec.multiple else both(c)
        return F.coalesce(ok, F.lit(False)), F.lit(0.0)
    if node.op == "!=":
        ok, _ = relation(spec, A.Relation(node.name, "=", node.value))
        return ~ok, F.lit(0.0)
    if spec.multiple:
        ok = F.exists(c, lambda x: one(spec, node.op, node.value, x)[0])
        best = F.array_max(F.transform(c, lambda x: F.when(one(spec, node.op, node.value, x)[0], one(spec, node.op, node.value, x)[1])))
        return F.coalesce(ok, F.lit(False)), F.coalesce(best, F.lit(0.0))
    ok, score = one(spec, node.op, node.value, c)
    ok = F.coalesce(ok, F.lit(False))
    return ok, F.when(ok, score).otherwise(0.0)


def similar(index, name: str, value: str):
    """(value, score) of a string field's values that share a character pair with the
    given one: (largest distance - distance) / largest distance over those."""
    spec = index.fields[name]
    c = F.explode(F.col(name)) if spec.multiple else F.col(name)
    vals = index.docs.select(c.alias("value")).filter("value is not null").distinct()
    fold = (lambda x: x) if _sensitive(spec, value) else F.lower
    want = value if _sensitive(spec, value) else value.lower()
    pairs = sorted({want[i : i + 2] for i in range(len(want) - 1)}) or [want]
    vals = vals.filter(F.arrays_overlap(T.bigrams(fold(F.col("value"))), F.array(*[F.lit(p) for p in pairs])))
    vals = vals.withColumn("lev", F.levenshtein(fold(F.col("value")), F.lit(want)))
    top = vals.agg(F.max("lev").alias("top"))
    return vals.join(F.broadcast(top)).select("value", F.when(F.col("top") == 0, F.lit(1.0)).otherwise((F.col("top") - F.col("lev")) / F.col("top")).alias("score"))
