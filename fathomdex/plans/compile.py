"""Query trees to DataFrames of (key, score).

All term leaves of a tree are scored in one pass: one scan of the postings for the terms
of the query, one aggregation by document with a column per leaf, and the tree becomes a
boolean and a double expression over those columns. Documents are joined in only where a
saved field, a complement or the whole collection is asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import Morphology, porter
from . import ast as A
from .optimize import analysed, optimized
from .relations import QueryError, relation, similar

GAP, DISORDER, MISSING, MOST = 0.1, 0.25, 10.0, 100.0


@dataclass
class Leaf:
    """A term leaf: which postings it takes, and the query's weight if it is given."""

    takes: Column
    weight: float | None
    coarse: Column  # on the folded term alone: what a scan clustered by term can skip by


@dataclass
class Out:
    """What a node says of a document."""

    matches: Column
    score: Column
    leaves: list[int] = field(default_factory=list)  # those that normalisation counts
    normal: bool = True  # scores that are normalised already, or none
    filters: bool = False  # matches only, no score of its own


class Compiler:
    def __init__(self, index, knowledge=None, taxonomy=None, boost: bool = True, multipliers: dict[str, float] | None = None):
        self.index = index
        self.knowledge = knowledge or Morphology()
        self.taxonomy = taxonomy
        self.boost = boost
        # occurrences in these fields count so many times
        self.fdt = F.col("fdt")
        if multipliers:
            times = F.create_map(*[F.lit(x) for k, v in sorted(multipliers.items()) for x in (k.lower(), float(v))])
            self.fdt = F.col("fdt") * F.coalesce(F.try_element_at(times, F.col("field")), F.lit(1.0))
        self.leaves: list[Leaf] = []
        self.windows: list[tuple[A.Window, list[Column], tuple]] = []
        self.similars: list[tuple[str, str]] = []
        self.needs_docs = False
        self.uses: set[str] = set()

    # ---- leaves

    def takes(self, term: A.Term, fields) -> tuple[Column, Column]:
        """(the postings of a term and its variants, a wider condition on `term` alone)."""
        word = term.text
        mixed = word != word.lower() and word != word.upper()
        cased = term.case or mixed
        c = F.col("cased") if cased else F.col("term")
        fold = (lambda x: x) if cased else str.lower
        if T.is_wildcard(word):
            ok = c.rlike(T.wildcard(fold(word)))
            coarse = F.col("term").rlike(T.wildcard(word.lower()))
            head = re.split(r"[*?]", word.lower())[0]
            if head:
                coarse = F.col("term").startswith(head) & coarse
        elif term.stem:
            stem = porter(word)
            same = F.pandas_udf(lambda s: s.map(lambda x: porter(x) == stem), "boolean")
            coarse = F.col("term").startswith(stem[: max(1, min(3, len(stem) - 1))])
            ok = coarse & same(F.col("term"))
        else:
            words = [word]
            if term.morph and not term.exact:
                words += self.knowledge.variants_of(word)
            if term.expand and self.taxonomy is not None:
                words += self.taxonomy.subsumed(word)
            words = sorted({fold(w) for w in words})
            ok = c.isin(*words)
            coarse = F.col("term").isin(*sorted({w.lower() for w in words}))
        if fields:
            ok = ok & F.col("field").isin(*fields)
        return ok, coarse

    def one_of(self, terms, fields) -> tuple[Column, Column]:
        pairs = [self.takes(p, fields) for p in terms]
        return _any([a for a, _ in pairs]), _any([b for _, b in pairs])

    def leaf(self, takes: tuple[Column, Column], weight=None) -> int:
        self.leaves.append(Leaf(takes[0], weight, takes[1]))
        return len(self.leaves) - 1

    # ---- nodes

    def node(self, n: A.Node, fields=()) -> Out:
        if isinstance(n, A.Parsed):
            from .parsers import parse

            return self.node(parse(n.text, n.grammar, n.default), fields)
        if isinstance(n, A.Fields):
            return self.node(n.part, n.names)
        if isinstance(n, (A.Term, A.TermOr)):
            parts = n.parts if isinstance(n, A.TermOr) else (n,)
            k = self.leaf(self.one_of(parts, fields), parts[0].weight)
            c = F.col(f"l{k}")
            return Out(c.isNotNull(), F.coalesce(c, F.lit(0.0)), [k], False)
        if isinstance(n, (A.And, A.Or)):
            outs = [self.node(p, fields) for p in n.parts]
            ok = outs[0].matches
            for o in outs[1:]:
                ok = ok & o.matches if isinstance(n, A.And) else ok | o.matches
            score = F.lit(0.0)
            for o in outs:
                if not o.filters:
                    score = score + (o.score if isinstance(n, A.And) else F.when(o.matches, o.score).otherwise(0.0))
            return Out(ok, score, [k for o in outs for k in o.leaves], all(o.normal for o in outs), all(o.filters for o in outs))
        if isinstance(n, A.Not):
            o = self.node(n.part, fields)
            self.needs_docs = True
            return Out(~F.coalesce(o.matches, F.lit(False)), F.lit(0.0), [], True, True)
        if isinstance(n, A.If):
            o = self.node(n.part, fields)
            return Out(o.matches, F.lit(0.0), [], True, True)
        if isinstance(n, A.Hide):
            return self.node(n.part, fields)
        if isinstance(n, A.Weight):
            o = self.node(n.part, fields)
            return Out(o.matches, o.score * n.weight, o.leaves, o.normal, o.filters)
        if isinstance(n, A.MatchAll):
            self.needs_docs = True
            return Out(F.lit(True), F.lit(0.0), [], True, True)
        if isinstance(n, A.Window):
            return self.window(n, fields)
        if isinstance(n, (A.Relation, A.Range, A.Undefined)):
            return self.relation(n)
        raise QueryError(f"no such query: {n!r}")

    def relation(self, n) -> Out:
        self.needs_docs = True
        name = n.name.lower()
        spec = self.index.fields.get(name)
        if spec is None or (not spec.saved and not isinstance(n, A.Undefined)):
            return Out(F.lit(False), F.lit(0.0), [], True, True)
        self.uses.add(name)
        if isinstance(n, A.Relation) and n.op == "similar":
            self.similars.append((name, str(n.value)))
            c = F.col(f"s{len(self.similars) - 1}")
            return Out(c.isNotNull(), F.coalesce(c, F.lit(0.0)))
        ok, score = relation(spec, n)
        pattern = isinstance(n, A.Relation) and n.op in ("matches", "substring", "starts", "ends")
        return Out(ok, score, [], True, not pattern)

    def window(self, n: A.Window, fields) -> Out:
        terms = [p for p in n.parts if isinstance(p, (A.Term, A.TermOr))]
        others = [p for p in n.parts if not isinstance(p, (A.Term, A.TermOr))]
        slots = []
        for t in terms:
            slots.append(self.one_of(t.parts if isinstance(t, A.TermOr) else (t,), fields))
        if not slots:
            raise QueryError(f"{n.kind} needs terms")
        self.windows.append((n, [s for s, _ in slots], [c for _, c in slots]))
        k = len(self.windows) - 1
        pen = F.col(f"w{k}")
        ok = pen.isNotNull()
        score = (MOST - pen) / MOST
        if self.boost:
            extra = None
            for s in slots:
                c = F.coalesce(F.col(f"l{self.leaf(s)}"), F.lit(0.0))
                extra = c if extra is None else extra + c
            score = F.when(pen == 0, score + extra).otherwise(score)
            score = F.when(score > 1, score / F.col(f"m{k}")).otherwise(score)
        for o in (self.node(p, fields) for p in others):
            ok = ok & o.matches
        return Out(ok, F.coalesce(score, F.lit(0.0)))

    # ---- data

    def frame(self, root: Out) -> DataFrame:
        """(key, match, score) before the last filter."""
        index, w = self.index, self.index.weighting
        base = None
        if self.leaves or self.windows:
            exact = [*[f.takes for f in self.leaves], *[s for _, slots, _ in self.windows for s in slots]]
            coarse = _any([*[f.coarse for f in self.leaves], *[c for _, _, cs in self.windows for c in cs]])
            hits = index.postings.filter(coarse).filter(_any(exact))
            stored = "dvl" in index.postings.columns
        if self.leaves:
            kept = [F.max(c).alias(c) for c in ("dvl", "ld")] if stored else []
            # dealt by document once: that serves both aggregations
            per = hits.repartition("key").groupBy("key", "term").agg(*[F.sum(F.when(f.takes, self.fdt)).alias(f"f{k}") for k, f in enumerate(self.leaves)], *kept)
            if index._terms is not None:
                idf = index._terms.filter(coarse).select("term", "ft")
            else:
                idf = hits.select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("ft"))
            idf = idf.select("term", w.idf(F.lit(index.n_docs), F.col("ft")).alias("idf"))
            per = per.join(idf, "term")
            avg = index.average_length if w.uses_length else 1.0
            if not stored:
                per = per.join(index.doc_lengths().select("key", "ld"), "key") if w.uses_length else per.withColumn("ld", F.lit(None).cast("bigint"))
            q = lambda f: F.lit(f.weight) if f.weight is not None else F.col("idf")
            cols = [F.sum(w.weight(F.col("idf"), F.col(f"f{k}"), F.col("ld"), F.lit(avg)) * q(f)).alias(f"l{k}") for k, f in enumerate(self.leaves)]
            base = per.groupBy("key").agg(*cols, *([F.max("dvl").alias("dvl")] if stored else []))
            if root.leaves and not root.normal:
                # each term once per leaf that takes it
                seen = hits.groupBy("term").agg(*[F.max(F.when(self.leaves[k].takes, 1).otherwise(0)).alias(f"t{k}") for k in root.leaves]).join(idf, "term")
                qw = None
                for k in root.leaves:
                    one = F.when(F.col(f"t{k}") == 1, q(self.leaves[k]) * q(self.leaves[k])).otherwise(0.0)
                    qw = one if qw is None else qw + one
                self.norm = seen.agg(F.sum(qw).alias("_sqw"))
        for k, (n, slots, _) in enumerate(self.windows):
            found = self.penalties(hits, n, slots, k)
            base = found if base is None else base.join(found, "key", "full")
        for k, (n, slots, _) in enumerate(self.windows):
            if self.boost:
                sums = None
                for j, f in enumerate(self.leaves):
                    if any(f.takes is s for s in slots):
                        c = F.coalesce(F.col(f"l{j}"), F.lit(0.0))
                        sums = c if sums is None else sums + c
                top = base.filter(F.col(f"w{k}") == 0).agg(F.max(sums + 1).alias(f"m{k}"))
                base = base.join(F.broadcast(top))
        if self.needs_docs or base is None:
            key = index.key
            docs = index.docs.select(F.col(key).alias("key"), *[F.col(f).alias(f) for f in sorted(self.uses) if f != key])
            if key in self.uses and key != "key":
                docs = docs.withColumn(key, F.col("key"))
            for k, (name, value) in enumerate(self.similars):
                vals = similar(index, name, value)
                spec = index.fields[name]
                flat = docs.select("key", (F.explode(name) if spec.multiple else F.col(name)).alias("value"))
                one = flat.join(vals, "value").groupBy("key").agg(F.sum("score").alias(f"s{k}"))
                docs = docs.join(one, "key", "left")
            base = docs if base is None else docs.join(base, "key", "left")
        return base

    def penalties(self, hits: DataFrame, n: A.Window, slots, k: int) -> DataFrame:
        """(key, wk): the least penalty over fields of a window's terms; none, no row."""
        own = hits.filter(_any(slots))
        arrays = [F.sort_array(F.flatten(F.collect_list(F.when(s, F.col("positions"))))).alias(f"p{j}") for j, s in enumerate(slots)]
        per = own.groupBy("key", "field").agg(*arrays)
        if not n.any_term:
            # all terms have to be somewhere in the document
            have = [F.max(F.size(f"p{j}") > 0).over(_by_key()).alias(f"h{j}") for j in range(len(slots))]
            per = per.select("*", *have)
            per = per.filter(_all([F.col(f"h{j}") for j in range(len(slots))]))
        if n.kind == "phrase":
            starts = F.col("p0")
            for j in range(1, len(slots)):
                starts = F.array_intersect(starts, _shifted(f"p{j}", j))
            pen = F.when(F.size(starts) > 0, F.lit(0.0))
        elif len(slots) == 2:
            pen = _pair_penalty(n.size, n.ordered)
            if n.missing:  # one of the two is somewhere
                pen = F.least(pen, F.when(F.size("p0") + F.size("p1") > 0, F.lit(MISSING)))
        else:
            pen = _penalty_udf(n.size, n.ordered, n.missing)(F.array(*[F.col(f"p{j}") for j in range(len(slots))]))
        return per.select("key", pen.alias("pen")).filter(F.col("pen") < MOST).groupBy("key").agg(F.min("pen").alias(f"w{k}"))


def _shifted(name: str, by: int) -> Column:
    return F.transform(F.col(name), lambda x: x - by)


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("key")


def _any(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def _all(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out


def _pair_penalty(size: int, ordered: bool) -> Column:
    """Least penalty of two terms' positions p0 and p1. It grows with the distance, so the
    best pair is next to each other where all positions are sorted: of a position and the
    one after it, each with one or both terms, three steps apart at most."""

    def cost(a, b):
        # twice the position, and one more where it is the second term's
        d = F.shiftright(b, 1) - F.shiftright(a, 1)
        first = (a.bitwiseAND(1) == 0) & (b.bitwiseAND(1) == 1)
        last = (a.bitwiseAND(1) == 1) & (b.bitwiseAND(1) == 0)
        near = (d > 0) & (d <= size)
        out = F.when(near & first, GAP * (d - 1))
        return out if ordered else out.when(near & last, GAP * d + DISORDER)

    def least(all_: Column) -> Column:
        step = lambda x, i: F.least(*[cost(x, F.get(all_, i + k)) for k in (1, 2, 3)])
        return F.array_min(F.transform(all_, step))

    code = lambda name, add: F.transform(F.array_distinct(F.col(name)), lambda x: x * 2 + add)
    return F.element_at(F.transform(F.array(F.sort_array(F.concat(code("p0", 0), code("p1", 1)))), least), 1)


def least_penalty(cols: list[list[int]], size: int, ordered: bool, missing: int):
    """Least penalty over windows of several terms' positions: GAP for each word between
    successive terms, DISORDER for a step back, MISSING for each absent term, of which
    `missing` at most. None where no window qualifies."""
    best = None
    starts = sorted({p for c in cols for p in c})
    for lo in starts:
        # states: last position -> least penalty, by number of absent terms
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}
        for c in cols:
            here = [p for p in c if lo <= p <= lo + size]
            nxt: dict[tuple[int, int], float] = {}
            for (last, gone), pen in states.items():
                if gone < missing:
                    at = (last, gone + 1)
                    v = pen + MISSING
                    if v < nxt.get(at, MOST):
                        nxt[at] = v
                for p in here:
                    d = p - last
                    if last and (d == 0 or (ordered and d < 0)):
                        continue
                    v = pen + (0.0 if not last else GAP * (d - 1) if d > 0 else GAP * -d + DISORDER)
                    if v < nxt.get((p, gone), MOST):
                        nxt[(p, gone)] = v
            states = nxt
        for (last, _), pen in states.items():
            if last and pen < MOST and (best is None or pen < best):
                best = pen
        if best == 0.0:
            break
    return best


def _penalty_udf(size: int, ordered: bool, missing: int):
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda cols: least_penalty([[] if c is None else [int(p) for p in c] for c in cols], size, ordered, missing)).astype("float64")

    return F.pandas_udf(run, "double")


def run(index, tree: A.Node, knowledge=None, taxonomy=None, boost: bool = True, fields=(), multipliers: dict[str, float] | None = None) -> DataFrame:
    """(key, score) of the documents that match. Unscored queries give everyone 1.

    knowledge gives terms' inflections, taxonomy the terms below one; boost adds term
    weights to perfect windows; fields are those of parts that name none; multipliers
    make occurrences in a field count more."""
    if fields:
        tree = A.Fields(tuple(f.lower() for f in fields), tree)
    tree = optimized(analysed(tree, index), index)
    comp = Compiler(index, knowledge, taxonomy, boost, multipliers)
    root = comp.node(tree)
    base = comp.frame(root)
    out = base.filter(root.matches)
    score = root.score
    if root.filters:
        score = F.lit(1.0)
    elif not root.normal:
        if "dvl" not in out.columns:
            out = out.join(index.doc_lengths().select("key", "dvl"), "key", "left")
        out = out.join(F.broadcast(comp.norm))
        norm = F.sqrt(F.when(F.col("_sqw") > 0, F.col("_sqw")).otherwise(1.0))
        score = score / (F.when(F.coalesce(F.col("dvl"), F.lit(0.0)) > 0, F.col("dvl")).otherwise(1.0) * norm)
    return out.select("key", score.cast("double").alias("score"))
