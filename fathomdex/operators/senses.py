"""Word senses: naive Bayes over labelled contexts, and a mixture found by EM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import joined, staged

#: Most senses that contexts are scored for one by one, most numbers (terms by senses) that
#: every worker holds for that, and most scores that it computes at once.
MOST_SENSES, MOST_CELLS, AT_ONCE = 2000, 2_000_000, 1_000_000


def contexts(docs: DataFrame, key: str, field: str, word: str, width: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    """(key, pos, context): the terms around each occurrence of a word, and columns of the
    document to keep."""
    rows = docs.select(F.col(key).alias("key"), T.tokens(F.col(field)).alias("toks"), *keep)
    at = F.filter(F.transform("toks", lambda t, i: F.when(t == word.lower(), i)), lambda i: i.isNotNull())
    rows = rows.select("key", "toks", F.explode(at).alias("pos"), *keep)
    lo = F.greatest(F.lit(1), F.col("pos") + 1 - width)
    left = F.slice("toks", lo, F.col("pos") + 1 - lo)
    right = F.slice("toks", F.col("pos") + 2, F.lit(width))
    return rows.select("key", "pos", F.concat(left, right).alias("context"), *keep)


def train_senses(labelled: DataFrame) -> DataFrame:
    """(sense, term, logp, prior, missing) of (sense, context) rows: naive Bayes with
    one added to each count; unseen terms have one over a sense's total."""
    n = staged(labelled.groupBy("sense").agg(F.count("*").alias("docs")), "senses")
    every = n.agg(F.sum("docs").alias("all"))
    terms = staged(labelled.select("sense", F.explode("context").alias("term")).groupBy("sense", "term").agg(F.count("*").alias("n")), "terms")
    total = terms.groupBy("sense").agg((F.sum("n") + F.count("*")).alias("total"))
    out = joined(terms, total.join(n, "sense"), "sense").join(F.broadcast(every))
    return out.select("sense", "term", F.log((F.col("n") + 1) / F.col("total")).alias("logp"), F.log(F.col("docs") / F.col("all")).alias("prior"), F.log(1 / F.col("total")).alias("missing"))


def assign_senses(rows: DataFrame, model: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """(key, sense, score): the likeliest sense of each (key, context) row, the least of
    equal ones. Every worker holds what the commonest terms (most_cells numbers) say for
    each sense and scores a context where it lies; only the rarer terms, few by nature, are
    joined by shuffle, and a context gets what they say before it is scored. With more than
    MOST_SENSES senses, all terms are joined."""
    model = staged(model, "model")
    senses = model.select("sense", "prior", "missing").distinct().orderBy("sense").limit(MOST_SENSES + 1).collect()
    if len(senses) > MOST_SENSES:
        return _assign_by_joins(rows, model)
    spark, sense, key = rows.sparkSession, dict(model.dtypes)["sense"], dict(rows.dtypes)["key"]
    if not senses:
        return spark.createDataFrame([], f"key {key}, sense {sense}, score double")
    ids = spark.createDataFrame([(r["sense"], i) for i, r in enumerate(senses)], f"sense {sense}, i int")
    gains = model.join(F.broadcast(ids), "sense").select("term", "i", (F.col("logp") - F.col("missing")).alias("gain"))
    # a gain is ln(occurrences + 1); size: eighths of a power of two of all of a term's
    gains = gains.groupBy("term").agg(F.sum(F.exp("gain")).alias("n"), F.sort_array(F.collect_list(F.struct("i", "gain"))).alias("gains"))
    gains = staged(gains.select("term", F.floor(F.log2("n") * 8).alias("size"), "gains"), "gains")
    cut, room = None, most_cells // len(senses)
    for r in gains.groupBy("size").count().orderBy(F.col("size").desc()).collect():  # some hundreds of sizes
        room -= r["count"]
        if room < 0:
            break
        cut = r["size"]
    common = F.lit(False) if cut is None else F.col("size") >= cut
    held = gains.filter(common).toArrow()
    lists = held.column("gains").combine_chunks()
    table = np.zeros((len(held) + 1, len(senses)))  # the last row: terms that are not held
    at = np.repeat(np.arange(len(held)), lists.value_lengths().to_numpy(False))
    table[at, lists.flatten().field("i").to_numpy(False)] = lists.flatten().field("gain").to_numpy(False)
    prior, missing = (np.array([r[c] for r in senses]) for c in ("prior", "missing"))
    sent = spark.sparkContext.broadcast((held.column("term").combine_chunks(), table, prior, missing))

    words = rows.select("key", F.explode("context").alias("term")).join(F.broadcast(gains.filter(common).select("term")), "term", "left_anti")
    rare = words.join(gains.filter(~common).select("term", "gains"), "term").select("key", "gains")
    none = F.array().cast(rare.schema["gains"].dataType)
    both = rows.select("key", "context", none.alias("gains")).unionByName(rare.select("key", F.array().cast("array<string>").alias("context"), "gains"))
    # in a row's own order, so that the same gains make the same sum
    flat = lambda c: F.flatten(F.collect_list(c))
    both = both.groupBy("key").agg(flat("context").alias("context"), F.sort_array(flat("gains")).alias("gains")).filter(F.size("context") > 0)

    def score(batches):
        terms, table, prior, missing = sent.value
        step = max(1, AT_ONCE // len(prior))
        for whole in batches:
            picked, scores = [], []
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                context, extra = batch.column("context"), batch.column("gains")
                n = context.value_lengths().to_numpy(False)
                code = context.flatten().dictionary_encode()
                known = pc.fill_null(pc.index_in(code.dictionary, terms), len(terms)).to_numpy(False) if len(terms) else np.zeros(len(code.dictionary), int)
                ids = np.append(known, len(terms))[pc.fill_null(code.indices, len(code.dictionary)).to_numpy(False)]
                got = np.empty((len(n), table.shape[1]))
                start = np.append(0, n.cumsum())
                a = 0
                while a < len(n):  # as many contexts as have AT_ONCE numbers; a longer one alone
                    b = max(a + 1, int(np.searchsorted(start, start[a] + step, "right")) - 1)
                    if b == a + 1:
                        got[a] = sum(table[ids[k : min(k + step, start[b])]].sum(0) for k in range(start[a], start[b], step))
                    else:
                        got[a:b] = np.add.reduceat(table[ids[start[a] : start[b]]], start[a:b] - start[a], axis=0)
                    a = b
                more = extra.flatten()
                row = np.repeat(np.arange(len(n)), extra.value_lengths().to_numpy(False))
                np.add.at(got, (row, more.field("i").to_numpy(False)), more.field("gain").to_numpy(False))
                got += prior + n[:, None] * missing
                best = got.argmax(1)
                picked.append(best)
                scores.append(got[np.arange(len(n)), best])
            if picked:
                cols = [whole.column("key"), pa.array(np.concatenate(picked).astype(np.int32)), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "i", "score"])

    out = both.mapInArrow(score, f"key {key}, i int, score double")
    return out.join(F.broadcast(ids), "i").select("key", "sense", "score")


def _assign_by_joins(rows: DataFrame, model: DataFrame) -> DataFrame:
    """assign_senses for any number of senses. A term of a sense always raises it above
    what it has without it, so a row has to be scored for the senses that share a term with
    it, and beside them only for the best sense of contexts of its length."""
    senses = staged(model.select("sense", "prior", "missing").distinct(), "senses")
    words = staged(rows.select("key", F.explode("context").alias("term")).groupBy("key", "term").agg(F.count("*").alias("n")), "words")
    size = words.groupBy("key").agg(F.sum("n").alias("words"))
    sizes = size.agg(F.collect_set("words").alias("sizes"))  # at most one a context length
    level = lambda: F.col("prior") + F.col("words") * F.col("missing")
    plain = senses.join(F.broadcast(sizes)).withColumn("words", F.explode("sizes"))
    plain = plain.groupBy("words").agg(F.min(F.struct((-level()).alias("less"), "sense")).alias("b"))
    hit = joined(words, model.select("sense", "term", "logp", "missing"), "term").groupBy("key", "sense").agg(F.sum(F.col("n") * (F.col("logp") - F.col("missing"))).alias("gain"))
    known = joined(hit.join(size, "key"), senses, "sense").select("key", F.struct((-(level() + F.col("gain"))).alias("less"), "sense").alias("b"))
    best = joined(size, plain, "words").select("key", "b").unionByName(known)
    return best.groupBy("key").agg(F.min("b").alias("b")).select("key", F.col("b.sense").alias("sense"), (-F.col("b.less")).alias("score"))


def _counts(contexts, at: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(contexts), max(1, len(at))))
    for i, ts in enumerate(contexts):
        for t in ts:
            if t in at:
                x[i, at[t]] += 1
    return x


def _mixture(x: np.ndarray, most: int, rounds: int, seed: int, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, log p of each feature) of the likeliest mixture, less its parameters."""
    rng = np.random.default_rng(seed)
    best = None
    for k in range(2, most + 1):
        r = rng.dirichlet(np.ones(k), len(x))
        last = -np.inf
        for _ in range(rounds):
            prior = np.log(r.mean(0) + 1e-9)
            p = r.T @ x + 0.1
            p = np.log(p / p.sum(1, keepdims=True))
            logs = prior + x @ p.T
            high = logs.max(1, keepdims=True)
            norm = high[:, 0] + np.log(np.exp(logs - high).sum(1))
            r = np.exp(logs - norm[:, None])
            if abs(norm.sum() - last) < 1e-6:
                break
            last = norm.sum()
        value = last - 0.5 * k * n_features * np.log(max(2, len(x)))
        if best is None or value > best[0]:
            best = (value, prior, p)
    return best[1], best[2]


def discover_senses(rows: DataFrame, most: int = 7, features: int = 500, rounds: int = 100, seed: int = 5, most_contexts: int = 20_000) -> DataFrame:
    """(key, pos, sense) of the contexts of one word: mixtures of 2 to `most` senses by
    EM with a fixed seed, the likeliest (less a cost per parameter) kept. The mixture is
    fitted to at most most_contexts contexts, drawn by a hash; all are assigned by it."""
    kind = dict(rows.dtypes)["key"]
    top = rows.select(F.explode("context").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(features)
    names = sorted(r["term"] for r in top.collect())
    at = {t: i for i, t in enumerate(names)}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "pos"])
        prior, p = _mixture(_counts(pdf["context"], at), most, rounds, seed, len(names))
        return pd.DataFrame({"prior": prior, "p": list(p)})

    drawn = rows.select("key", "pos", "context").orderBy(F.xxhash64("key", "pos"), "key", "pos").limit(most_contexts)
    model = drawn.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "prior double, p array<double>").collect()  # one row a sense
    prior, p = np.array([r["prior"] for r in model]), np.array([r["p"] for r in model])

    def assign(batches):
        for pdf in batches:
            best = (prior + _counts(pdf["context"], at) @ p.T).argmax(1)
            yield pd.DataFrame({"key": pdf["key"], "pos": pdf["pos"], "sense": best.astype(int)})

    return rows.select("key", "pos", "context").mapInPandas(assign, f"key {kind}, pos int, sense int")
