"""Clustering of documents' vectors: k-means, complete-linkage, spanning tree; and
statistics of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .vectors import vectors

#: Most elements that the quadratic methods cluster in one task; more go in rounds.
MAX_PAIRWISE = 4000
#: Clusters whose distances are held at once, when few are left of more elements; rows of
#: a task, and columns of a block.
HELD_CLUSTERS, TASK_ROWS, COLUMNS = 2000, 512, 2048
#: Nearest pairs of clusters that a pass over all pairs brings to the driver, and its tasks.
PAIRS, PAIR_TASKS = 2_000_000, 48


def elements(index, keys: DataFrame | None = None, n_features: int = 50, field: str | None = None) -> DataFrame:
    """(key, features): unit vectors over the n features of the largest total weight.
    Documents without any of them have an empty array (the remainder)."""
    v = vectors(index, field)
    docs = keys.select("key") if keys is not None else index.docs.select(F.col(index.key).alias("key"))
    v = v.join(docs, "key", "left_semi")
    top = v.groupBy("term").agg(F.sum("weight").alias("w")).orderBy(F.col("w").desc(), "term").limit(n_features)
    names = [r["term"] for r in top.select("term").collect()]
    order = {t: i for i, t in enumerate(sorted(names))}
    picked = v.filter(F.col("term").isin(*names)) if names else v.limit(0)
    cols = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("weight"))), F.lit(0.0)).alias(f"c{i}") for t, i in order.items()]
    dense = picked.groupBy("key").agg(*cols) if cols else picked.select("key").distinct()
    raw = F.array(*[F.col(f"c{i}") for i in range(len(order))]) if cols else F.array().cast("array<double>")
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    dense = dense.select("key", F.transform(raw, lambda x: x / norm).alias("features"))
    return docs.join(dense, "key", "left").select("key", F.coalesce("features", F.array().cast("array<double>")).alias("features"))


def kmeans(rows: DataFrame, k: int, seed: int = 17, rounds: int = 50) -> DataFrame:
    """(key, cluster, distance), by distributed k-means with a fixed seed. Rows without
    features are in cluster -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # every round reads the rows again
    rows = staged(rows.select("key", "features"), "kmeans")
    full = rows.filter(F.size("features") > 0)
    if not full.limit(1).count():
        return rows.select("key", F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("distance"))
    data = full.select("key", "features", array_to_vector("features").alias("v"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="v", predictionCol="cluster").fit(data)
    centers = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    from .vectors import euclid

    out = model.transform(data).join(F.broadcast(centers), "cluster").select("key", "cluster", euclid(F.col("features"), F.col("center")).alias("distance"))
    rest = rows.filter(F.size("features") == 0).select("key", F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("distance"))
    return out.unionByName(rest)


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)
    return np.sqrt(np.maximum(0, sq[:, None] + sq[None] - 2 * x @ x.T))


def _join_nearest(d: np.ndarray, k: int):
    """(i, j, distance), i < j, of each join in order, of the two whose farthest members
    are nearest; d is used up."""
    np.fill_diagonal(d, np.inf)
    for _ in range(len(d) - max(1, k)):
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        i, j = min(i, j), max(i, j)
        yield int(i), int(j), float(d[i, j])
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j] = np.inf
        d[:, j] = np.inf


def _complete_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters, joining the two whose farthest members are nearest."""
    label = np.arange(len(x))
    for i, j, _ in _join_nearest(_distances(x), k):
        label[label == j] = i
    return label


def _spanning_tree(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters: a minimum spanning tree without its k - 1 longest edges."""
    n = len(x)
    d = _distances(x)
    best, near, done = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    done[0] = True
    edges = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((float(best[j]), int(near[j]), j))
        done[j] = True
        closer = d[j] < best
        best, near = np.where(closer, d[j], best), np.where(closer, j, near)
    forest = _Forest(n)
    for _, a, b in sorted(edges)[: max(0, n - k)]:
        forest.join(a, b)
    return forest.labels()


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart; the smaller root stays."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def labels(self) -> np.ndarray:
        return np.array([self.find(a) for a in range(len(self.parent))])


def _in_tasks(spark, parts: list, run) -> list:
    """run(part) of each part, each in a task of its own."""
    return spark.sparkContext.parallelize(parts, len(parts)).map(run).collect() if parts else []


def _squares(x, sq, rows, cols) -> np.ndarray:
    return np.maximum(0, sq[rows][:, None] + sq[cols] - 2 * x[rows] @ x[cols].T)


def _spanning_tree_rounds(spark, x: np.ndarray, k: int) -> np.ndarray:
    """_spanning_tree in rounds (Boruvka's): of each part of the tree so far the shortest
    edge out of it is found, by tasks of some rows against all. A row's nearest one is
    kept while it is in another part, and is a lower bound after that. Of a round's edges,
    shortest first, those are taken that close no cycle; so ties do no harm."""
    n = len(x)
    held = spark.sparkContext.broadcast(x)
    best, near = np.zeros(n), np.arange(n)
    forest, part, edges = _Forest(n), np.arange(n), []
    while len(edges) < n - 1:
        out = part[near] != part
        least = np.full(n, np.inf)
        np.minimum.at(least, part[out], best[out])
        todo = np.flatnonzero(~out & (best < least[part]))
        parts = spark.sparkContext.broadcast(part)

        def run(rows, held=held, parts=parts):
            x, part = held.value, parts.value
            sq = (x * x).sum(1)
            b, at = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
            for c in range(0, len(x), COLUMNS):
                cols = slice(c, c + COLUMNS)
                d = _squares(x, sq, rows, cols)
                d[part[rows][:, None] == part[cols]] = np.inf
                j = d.argmin(1)
                v = d[np.arange(len(rows)), j]
                at[v < b] = c + j[v < b]
                b = np.minimum(b, v)
            return rows, b, at

        for rows, b, at in _in_tasks(spark, [todo[i : i + TASK_ROWS] for i in range(0, len(todo), TASK_ROWS)], run):
            best[rows], near[rows] = b, at
        parts.unpersist()
        out = np.flatnonzero(part[near] != part)
        out = out[np.lexsort((out, best[out]))]
        _, first = np.unique(part[out], return_index=True)
        for i in out[np.sort(first)].tolist():
            if forest.join(i, int(near[i])):
                edges.append((float(best[i]), i, int(near[i])))
        part = forest.labels()
    held.unpersist()
    forest = _Forest(n)
    for _, a, b in sorted(edges)[: max(0, n - k)]:
        forest.join(a, b)
    return forest.labels()


def _nearest_pairs(spark, held, label: np.ndarray):
    """(i, j, distance), i < j, of every pair of clusters nearer than some bound, about
    PAIRS of them: a task keeps its share of the nearest of its pairs, and those count that
    are below every task's bound. Clusters are dealt at random, so bounds are alike."""
    names = np.unique(label)
    place = np.random.default_rng(7).permutation(len(names))
    of = place[np.searchsorted(names, label)]
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(names) + 1))
    named = np.empty_like(names)
    named[place] = names
    share = max(1, PAIRS // PAIR_TASKS)
    state = spark.sparkContext.broadcast((order, start))

    def blocks(clusters, start, most):
        """Clusters in runs of at most so many elements, or one larger cluster."""
        sums = np.append(0, np.cumsum(start[clusters + 1] - start[clusters]))
        a = 0
        while a < len(clusters):
            b = max(a + 1, int(np.searchsorted(sums, sums[a] + most, "right")) - 1)
            yield a, b
            a = b

    def run(t):
        x, (order, start) = held.value, state.value
        sq = (x * x).sum(1)
        every = np.arange(len(start) - 1)
        mine = every[t::PAIR_TASKS]
        bound, got, waiting = np.inf, [], 0
        cuts = list(blocks(every, start, COLUMNS))

        def least():
            i, j, d = (np.concatenate(c) for c in zip(*got))
            if len(d) <= share:
                return [(i, j, d)], bound
            low = np.partition(d, share)[share]
            keep = d < low
            return [(i[keep], j[keep], d[keep])], low

        for a, b in blocks(mine, start, TASK_ROWS):
            rows = mine[a:b]
            at = np.concatenate([order[start[r] : start[r + 1]] for r in rows])
            first = np.append(0, np.cumsum(start[rows + 1] - start[rows]))
            left = np.hstack([-2 * x[at], sq[at][:, None], np.ones((len(at), 1))])
            for lo, hi in cuts:
                if hi - 1 <= rows[0]:  # each pair once: columns behind the row
                    continue
                cols = order[start[lo] : start[hi]]
                right = np.hstack([x[cols], np.ones((len(cols), 1)), sq[cols][:, None]]).T
                k = int(np.searchsorted(rows, hi - 1))
                e = np.full((k, hi - lo), -np.inf)
                step = max(1, 2 * TASK_ROWS * COLUMNS // len(cols))
                for r in range(0, first[k], step):
                    d = left[r : min(r + step, first[k])] @ right
                    if hi - lo < len(cols):
                        d = np.maximum.reduceat(d, start[lo:hi] - start[lo], axis=1)
                    g0 = int(np.searchsorted(first, r, "right")) - 1
                    g1 = int(np.searchsorted(first, r + len(d), "left"))
                    cut = np.maximum(first[g0:g1] - r, 0)
                    e[g0:g1] = np.maximum(e[g0:g1], np.maximum.reduceat(d, cut, axis=0) if g1 - g0 < len(d) else d)
                np.maximum(e, 0, out=e)
                i, j = np.nonzero(e < bound)
                ok = rows[i] < j + lo
                i, j = i[ok], j[ok]
                if len(i):
                    got.append((rows[i], j + lo, e[i, j]))
                    waiting += len(i)
                    if waiting > 2 * share:
                        got, bound = least()
                        waiting = len(got[0][0])
        if got:
            got, bound = least()
        i, j, d = got[0] if got else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return i.astype(np.int32), j.astype(np.int32), d, bound

    found = _in_tasks(spark, list(range(PAIR_TASKS)), run)
    state.unpersist()
    bound = min(f[3] for f in found)
    i, j, d = (np.concatenate([f[c][f[2] < bound] for f in found]) for c in range(3))
    i, j = named[i], named[j]
    return np.minimum(i, j), np.maximum(i, j), np.sqrt(d)


def _joins_below(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int):
    """Rounds of joins (i, j, distance) among n clusters, of which the pairs below a bound
    are given: pairs that are each other's nearest. The joined cluster is below the bound
    from another one only if all its parts are."""
    while len(d):
        rank = np.empty(len(d), np.int64)
        rank[np.lexsort((b, a, d))] = np.arange(len(d))  # a strict order, so one pair is always joined
        least = np.full(n, len(d))
        np.minimum.at(least, a, rank)
        np.minimum.at(least, b, rank)
        both = (least[a] == rank) & (least[b] == rank)
        i, j = a[both], b[both]
        yield i, j, d[both]
        into, parts = np.arange(n), np.ones(n, np.int64)
        into[j] = i
        parts[i] = 2
        a, b = into[a], into[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        keep = a != b
        a, b, d = a[keep], b[keep], d[keep]
        if not len(d):
            break
        pair = a.astype(np.int64) * n + b
        order = np.argsort(pair, kind="stable")
        pair, d = pair[order], d[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        size = np.diff(np.append(first, len(pair)))
        pair, d = pair[first], np.maximum.reduceat(d, first)
        a, b = pair // n, pair % n
        whole = size == parts[a] * parts[b]
        a, b, d = a[whole], b[whole], d[whole]


def _complete_linkage_rounds(spark, x: np.ndarray, k: int) -> np.ndarray:
    """_complete_linkage in rounds: any two clusters that are each other's nearest are
    joined, which makes the same joins in another order, because a join brings no cluster
    nearer. A pass over all pairs of clusters finds every pair nearer than a bound that
    leaves about PAIRS of them, and all joins below the bound follow from these pairs alone
    (_joins_below). Where a pass brings no join, as with very many equal distances, each
    cluster's nearest one is found, by tasks of some clusters against all. When few
    clusters are left, their distances are held at once. The n - k lowest joins are kept.
    Equal elements are one from the start."""
    _, first, back = np.unique(x, axis=0, return_index=True, return_inverse=True)
    point = np.sort(first)
    back = np.searchsorted(point, first[back.ravel()])
    x = x[point]
    n = len(x)
    held = spark.sparkContext.broadcast(x)
    label, joins = np.arange(n), []
    best, near, height = np.zeros(n), np.full(n, -1), np.zeros(n)
    alive = np.arange(n)

    def far(clusters, whole):
        """Of each of the clusters its nearest other one and its distance; with whole,
        its distances from all."""
        order = np.argsort(label, kind="stable")
        ids, start, size = np.unique(label[order], return_index=True, return_counts=True)
        cuts = [0]
        for i, end in enumerate(start + size):
            if end - start[cuts[-1]] > COLUMNS and i > cuts[-1]:
                cuts.append(i)
        state = spark.sparkContext.broadcast((order, start, size, [*cuts, len(ids)]))

        def run(mine, held=held, state=state):
            x, (order, start, size, cuts) = held.value, state.value
            sq = (x * x).sum(1)
            b, at, every = np.full(len(mine), np.inf), np.zeros(len(mine), np.int64), []
            for lo, hi in zip(cuts, cuts[1:]):
                cols = order[start[lo] : start[hi - 1] + size[hi - 1]]
                d = np.zeros((len(mine), hi - lo))
                rows = np.concatenate([order[start[i] : start[i] + size[i]] for i in mine])
                of = np.repeat(np.arange(len(mine)), size[mine])
                for r in range(0, len(rows), TASK_ROWS):
                    e = _squares(x, sq, rows[r : r + TASK_ROWS], cols)
                    if hi - lo < len(cols):
                        e = np.maximum.reduceat(e, start[lo:hi] - start[lo], axis=1)
                    g, s = np.unique(of[r : r + TASK_ROWS], return_index=True)
                    d[g] = np.maximum(d[g], np.maximum.reduceat(e, s, axis=0) if len(g) < len(e) else e)
                if whole:
                    every.append(d)
                    continue
                own = np.flatnonzero((mine >= lo) & (mine < hi))
                d[own, mine[own] - lo] = np.inf
                j = d.argmin(1)
                v = d[np.arange(len(mine)), j]
                at[v < b] = lo + j[v < b]
                b = np.minimum(b, v)
            return mine, b, at, np.concatenate(every, 1) if whole else None

        todo = np.searchsorted(ids, clusters)
        task = np.cumsum(size[todo]) // TASK_ROWS
        found = _in_tasks(spark, np.split(todo, np.flatnonzero(np.diff(task)) + 1) if len(todo) else [], run)
        state.unpersist()
        return [(ids[m], b, ids[at], d) for m, b, at, d in found]

    def join(i, j, d):
        """The bookkeeping of joins i < j, each cluster in one of them at most."""
        nonlocal label, alive, joins
        height[i] = np.maximum(d, np.maximum(height[i], height[j]))
        joins += zip(height[i].tolist(), i.tolist(), j.tolist())
        into = np.arange(n)
        into[j] = i
        label = into[label]
        alive = alive[into[alive] == alive]
        gone = np.zeros(n, bool)
        gone[i] = gone[j] = True
        near[alive[gone[alive] | (near[alive] < 0) | gone[near[alive]]]] = -1

    tried = np.inf
    while len(alive) > HELD_CLUSTERS:
        if len(alive) < 0.75 * tried:
            before = len(alive)
            for i, j, d in _joins_below(*_nearest_pairs(spark, held, label), n):
                join(i, j, d)
            tried = np.inf if len(alive) < before else before
            continue
        for m, b, at, _ in far(alive[near[alive] < 0], False):
            best[m], near[m] = b, at
        i = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(i):  # ties that rounding has broken
            i = alive[[np.argmin(best[alive])]]
        j = near[i]
        i, j = np.minimum(i, j), np.maximum(i, j)
        join(i, j, best[i])
    d = np.zeros((len(alive), len(alive)))
    for m, _, _, rows in far(alive, True):
        d[np.searchsorted(alive, m)] = rows
    held.unpersist()
    for i, j, h in _join_nearest(np.maximum(d, d.T), 1):
        i, j = int(alive[i]), int(alive[j])
        height[i] = max(h, height[i], height[j])
        joins.append((float(height[i]), i, j))
    forest = _Forest(n)
    for _, i, j in sorted(joins, key=lambda e: e[0])[: max(0, n - k)]:
        forest.join(i, j)
    return point[forest.labels()][back]


def _numbered(x: np.ndarray, label: np.ndarray):
    """(clusters numbered as they come, distances from their means)."""
    ids = {v: i for i, v in enumerate(dict.fromkeys(label.tolist()))}
    cluster = np.array([ids[v] for v in label.tolist()], np.int32)
    dist = np.zeros(len(x))
    for v in range(len(ids)):
        at = cluster == v
        dist[at] = np.sqrt(((x[at] - x[at].mean(0)) ** 2).sum(1))
    return cluster, dist


def _pairwise(rows: DataFrame, k: int, method, in_rounds) -> DataFrame:
    """A quadratic method: in one task up to MAX_PAIRWISE elements, and else in rounds of
    tasks, for which the driver and each executor hold all elements' features."""
    full = rows.filter(F.size("features") > 0)
    kind = dict(rows.dtypes)["key"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        x = np.array(pdf["features"].tolist(), float)
        cluster, dist = _numbered(x, method(x, k))
        return pd.DataFrame({"key": pdf["key"], "cluster": cluster, "distance": dist})

    if full.limit(MAX_PAIRWISE + 1).count() <= MAX_PAIRWISE:
        out = full.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"key {kind}, cluster int, distance double")
    else:
        t = full.select("key", "features").orderBy("key").toArrow()
        x = t.column("features").combine_chunks().flatten().to_numpy().astype(float).reshape(len(t), -1)
        cluster, dist = _numbered(x, in_rounds(rows.sparkSession, x, k))
        out = rows.sparkSession.createDataFrame(pa.table({"key": t.column("key"), "cluster": pa.array(cluster), "distance": pa.array(dist)}))
    rest = rows.filter(F.size("features") == 0).select("key", F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("distance"))
    return out.unionByName(rest)


def hac(rows: DataFrame, k: int) -> DataFrame:
    """(key, cluster, distance) by complete-linkage agglomeration."""
    return _pairwise(rows, k, _complete_linkage, _complete_linkage_rounds)


def mst(rows: DataFrame, k: int) -> DataFrame:
    """(key, cluster, distance) by cutting a minimum spanning tree into k parts."""
    return _pairwise(rows, k, _spanning_tree, _spanning_tree_rounds)


def stats(clusters: DataFrame) -> DataFrame:
    """(cluster, size, mean, variance, medoid) of members' distances."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("distance").alias("mean"), F.var_pop("distance").alias("variance"), F.min(F.struct("distance", "key"))["key"].alias("medoid")).orderBy("cluster")


def descriptions(index, clusters: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, terms): the n heaviest terms of each cluster's mean vector."""
    from pyspark.sql import Window

    v = vectors(index).join(clusters.select("key", "cluster"), "key")
    w = v.groupBy("cluster", "term").agg(F.sum("weight").alias("w"))
    by = Window.partitionBy("cluster").orderBy(F.col("w").desc(), "term")
    top = w.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= n)
    return top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
