"""Quality rules: base checks and a learned decision list, in DataFrame operations only.

Statistics of each whole text are one row of native expressions. From the rows that have
a quality label, sequential covering grows conjunctions of thresholds for the reject
class on two thirds of them (by a hash of the id), prunes each on the rest, and takes it
into the list while it is precise on both. The list becomes one ordered conditional
expression. Counting runs as Spark aggregates over all labelled rows; the driver sees
only histograms of fixed size.

Defined cases: a null or empty text has zeros everywhere and fails the base checks; a very
long text is one row like any other (its words must fit in a task's memory); repeated rows
are judged alike; without labels, or with one class only, the list is
empty and only the base checks decide; extra columns are carried by `filter_quality`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, only_columns, staged, table, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[^#*$%&|<>]+"
BINS = 32
MAX_RULES = 12
MAX_LITERALS = 4
MIN_PRECISION = 0.97
MIN_COVERED = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marks", "n_upper")


def _repeat_words(words: Column, hashes: Column, key=F.xxhash64) -> Column:
    """Words in 3-word windows found twice or more, of a text's words and their hashes.

    The windows' hashes are sorted with their positions in the low bits (so many as the
    text needs). Neighbours with the same high bits and the same three words are repeats,
    and the covered words are the union of the 3-word intervals at the repeats' sorted
    positions. Where neighbours have the same high bits and other words, the windows
    themselves are sorted instead.
    """

    def same(a: Column, b: Column) -> Column:
        out = F.get(words, a) == F.get(words, b)
        for k in (1, 2):
            out = out & (F.get(words, a + k) == F.get(words, b + k))
        return out

    def union(at: Column) -> Column:
        last = F.lit(3)
        steps = F.transform(at, lambda x, j: F.least(last.cast("long"), F.coalesce(F.get(at, j + 1) - x, last.cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(sorted_: Column, place, alike) -> Column:
        """Sorted positions of the windows of which a neighbour is the same."""
        near = lambda j, k: F.coalesce(alike(F.get(sorted_, k), F.get(sorted_, j)), F.lit(False))
        return F.sort_array(F.array_compact(F.transform(sorted_, lambda x, j: F.when(near(j, j - 1) | near(j, j + 1), place(x)))))

    def covered(win: Column) -> Column:
        n = F.size(win)
        k = F.length(F.bin(n.cast("long")))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1

        def fast(s: Column) -> Column:
            keys, mask = s["keys"], s["low"]
            place = lambda x: x.bitwiseAND(mask)
            equal = lambda x, y: x.bitwiseAND(F.bitwise_not(mask)) == y.bitwiseAND(F.bitwise_not(mask))
            here = lambda x: place(x).cast("int")
            confused = F.exists(F.sequence(F.lit(1), F.size(keys) - 1), lambda j: equal(F.get(keys, j - 1), F.get(keys, j)) & ~same(here(F.get(keys, j - 1)), here(F.get(keys, j))))
            return F.when(confused, slow()).otherwise(bind(repeats(keys, place, equal), union))

        def slow() -> Column:
            spelled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.cast("long").alias("i")))
            return bind(F.sort_array(spelled), lambda x: bind(repeats(x, lambda y: y["i"], lambda a, b: a["w"] == b["w"]), union))

        keys = F.sort_array(F.transform(win, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        return bind(F.struct(keys.alias("keys"), low.alias("low")), fast)

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: key(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    some = F.when(F.size(hashes) >= 4, bind(windows, lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(F.lit(0).cast("long"))))
    return F.coalesce(some, F.lit(0).cast("long"))


def stats(df: DataFrame, text: str = "text", key=F.xxhash64) -> DataFrame:
    """df with the columns of COUNTS, each long; text is kept. key hashes windows of words."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of(s: Column) -> Column:
        words = s["w"]
        joined = F.array_join(words, "")
        lines = F.filter(F.split(s["t"], "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
        hashes = F.transform(words, lambda x: F.xxhash64(x))

        def with_hashes(h: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(joined).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(s["t"], SYMBOLS, "")).cast("long").alias("n_symbols"),
                bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
                _repeat_words(words, h, key).alias("n_repeat_words"),
                F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
                (F.length(s["t"]) - F.length(F.replace(s["t"], F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
                F.length(F.regexp_replace(s["t"], r"[^A-Z]+", "")).cast("long").alias("n_upper"),
            )

        return bind(hashes, with_hashes)

    out = df.withColumn("_s", bind(F.struct(t.alias("t"), words_of(t).alias("w")), of))
    s = F.col("_s")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        (s["l"]["n"] - s["l"]["d"]).alias("n_dup_lines"),
        s["n_repeat_words"].alias("n_repeat_words"),
        s["l"]["n"].alias("n_lines"),
        *[s[c].alias(c) for c in ("n_distinct", "n_marks", "n_upper")],
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def features() -> dict[str, Column]:
    """Ratios that the rules put thresholds on."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeat_words": F.col("n_repeat_words") / n,
        "chars_per_word": chars / n,
        "distinct_words": F.col("n_distinct") / n,
        "marks_per_word": F.col("n_marks") / n,
        "upper_share": F.col("n_upper") / chars,
        "words_per_line": n / lines,
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool  # value > cut, else value <= cut
    cut: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


def rules_column(rules: list[list[Literal]]) -> Column:
    """Number of the first rule that holds, null where none does: an ordered CASE WHEN."""
    out = None
    for k, rule in enumerate(rules):
        cond = F.lit(True)
        for x in rule:
            cond = cond & x.column()
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def _holds(rule: list[Literal]) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column()
    return out


def learn(rows: DataFrame, names: list[str]) -> list[list[Literal]]:
    """Ordered rules for rows with reject = 1, from (names..., reject, prune) rows."""
    grow = ~F.col("prune")
    spots = [(j + 1) / BINS for j in range(BINS - 1)]
    # cuts at quantiles of both classes, so that a rare class has its own
    got = rows.filter(grow).agg(
        F.count("*").alias("n"),
        F.sum("reject").alias("p"),
        *[F.percentile_approx(F.when(F.col("reject") == c, F.col(n)), spots, 2000).alias(f"{n}_{c}") for n in names for c in (0, 1)],
    ).first()
    if not got["n"] or not got["p"] or got["p"] == got["n"]:
        return []
    cuts = {n: sorted({round(x, 9) for c in (0, 1) for x in got[f"{n}_{c}"]}) for n in names}
    # bin b of a feature: the number of cuts below its value
    binned = rows.withColumn(
        "bins",
        F.array(*[_bin(n, cuts[n]) for n in names]),
    )
    binned = staged(binned, "quality-bins")
    rules: list[list[Literal]] = []
    left = binned
    while len(rules) < MAX_RULES:
        rule: list[Literal] = []
        while len(rule) < MAX_LITERALS:
            hist = left.filter(grow & _holds(rule)).select("reject", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("reject").alias("p"), F.count("*").alias("n")).collect()
            best = _best_literal(hist, names, cuts)
            if best is None:
                break
            gain, lit, precision = best
            rule.append(lit)
            if precision >= 0.999:
                break
        if not rule:
            break
        rule, ok = _prune(left, rule)
        if not ok:
            break
        rules.append(rule)
        left = left.filter(~_holds(rule))
    return rules


def _bin(name: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(name)))


def _best_literal(hist, names, cuts):
    """The literal of the highest information gain, as FOIL counts it."""
    from math import log2

    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in hist:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    best = None
    for f in sorted(by):
        P, N = sum(x[0] for x in by[f].values()), sum(x[1] for x in by[f].values())
        if not P or P == N:
            return None
        p = n = 0
        for j, cut in enumerate(cuts[names[f]]):
            dp, dn = by[f].get(j, (0, 0))
            p, n = p + dp, n + dn
            for above, (a, b) in ((False, (p, n)), (True, (P - p, N - n))):
                if a < MIN_COVERED or b == N:
                    continue
                gain = a * (log2(a / b) - log2(P / N))
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Literal(names[f], above, cut), a / b)
    return best


def _prune(left: DataFrame, rule: list[Literal]):
    """Drops last literals while (p - n) / (p + n) on the pruning rows does not fall.
    ok: the rule is precise on the growing and on the pruning rows."""
    forms = [rule[: k + 1] for k in range(len(rule))]
    one = lambda cond: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0))
    got = left.agg(*[one(_holds(r) & (F.col("prune") == q) & (F.col("reject") == c)).alias(f"x{k}_{q}_{c}") for k, r in enumerate(forms) for q in (False, True) for c in (0, 1)]).first()
    at = lambda k, q: (got[f"x{k}_{q}_1"], got[f"x{k}_{q}_0"])
    worth = lambda k: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*at(k, True))
    k = max(range(len(forms)), key=lambda k: (worth(k), -k))
    if worth(k) == -1.0:
        k = len(forms) - 1
    p, n = at(k, False)
    pp, pn = at(k, True)
    ok = p >= MIN_COVERED and p >= MIN_PRECISION * (p + n) and pp + pn > 0 and (pp + 1) >= MIN_PRECISION * (pp + pn + 1)
    return forms[k], ok


def with_features(st: DataFrame) -> DataFrame:
    return st.select("*", *[c.alias(f"f_{n}") for n, c in features().items()])


def feature_names() -> list[str]:
    return [f"f_{n}" for n in features()]


def fit(st: DataFrame, labels: DataFrame) -> list[list[Literal]]:
    """The decision list, from statistics rows (doc_id and COUNTS) that labels cover.
    Rows that the base checks reject take no part: the list only sees the others."""
    names = feature_names()
    lab = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = with_features(st.filter(~base_failed())).join(lab, "doc_id")
    rows = rows.select(
        *[F.round(F.col(n), 9).alias(n) for n in names],
        F.when(F.col("quality") == 0, 1).otherwise(0).alias("reject"),
        (F.pmod(F.crc32(F.concat(F.lit("prune"), F.col("doc_id").cast("string"))), F.lit(3)) == 0).alias("prune"),
    )
    return learn(staged(rows, "quality-labelled"), names)


def judged(st: DataFrame, rules) -> DataFrame:
    """Statistics rows with base_failed, the rule that rejects (or null) and kept."""
    out = with_features(st).select("*", *[F.round(F.col(n), 9).alias(f"{n}_r") for n in feature_names()])
    named = [[Literal(f"{x.feature}_r", x.above, x.cut) for x in r] for r in rules]
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", rules_column(named))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*feature_names(), *[f"{n}_r" for n in feature_names()])


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, rule, kept."""
    st = staged(stats(only_columns(docs, ("doc_id", "text"))).drop("text"), "quality-stats")
    return judged(st, fit(st, labels))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' kept rows, with docs' columns. Rows are written once with their statistics;
    learning reads the statistics alone, so no text is shuffled."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("text"))
    held = staged(stats(held).drop("text"), "quality-rows")
    rules = fit(held.drop("_row"), labels)
    return judged(held, rules).filter("kept").select("_row.*")


def op4_quality(spark, sf_dir) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
