import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomdex.functions import text as T
from fathomdex.functions.text import query_tokens, register_analyzer
from fathomdex.operators import classification as C
from fathomdex.operators import clustering as K
from fathomdex.operators import lookups as L
from fathomdex.operators import passages as P
from fathomdex.operators import senses as W
from fathomdex.operators import vectors as V
from fathomdex.operators.index import FieldSpec, Index
from fathomdex.operators.results import results_for
from fathomdex.operators.taxonomy import Taxonomy
from fathomdex.plans import ast as A
from fathomdex.plans.compile import least_penalty
from fathomdex.plans.relations import QueryError
from fathomdex.sources import ingest, markup
from fathomdex.streaming.upsert import KeyedStore, index_stream, latest_per_key

WORDS = "java install graphical build latency syscall issue provider two thread".split()


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    out = []
    for k in range(40):
        body = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 25)))
        out.append((f"d{k:02d}", rng.choice(WORDS).title() + " notes", body, rng.randint(1, 9) if k % 5 else None, [rng.choice("abc") for _ in range(k % 4)], dt.datetime(2007, 8, 1 + k % 28, 12 * (k % 2))))
    return out


@pytest.fixture(scope="module")
def index(spark, docs):
    rows = spark.createDataFrame(docs, "key string, subject string, body string, num long, tags array<string>, day timestamp")
    fields = [
        FieldSpec("subject", "string", indexed=True, tokenized=True, vectored=True, saved=True),
        FieldSpec("body", indexed=True, tokenized=True, vectored=True),
        FieldSpec("num", "integer", saved=True),
        FieldSpec("tags", "string", saved=True, multiple=True),
        FieldSpec("day", "date", saved=True),
    ]
    ix = Index.build(rows, "key", fields)
    ix.postings = ix.postings.cache()
    return ix


def found(index, q, **kw):
    return {r["key"] for r in index.search(q, **kw).df.collect()}


def test_field_rules():
    with pytest.raises(ValueError):
        FieldSpec("x", "string")
    with pytest.raises(ValueError):
        FieldSpec("x", saved=True)
    assert FieldSpec("TiTle").name == "title"


def test_terms_against_brute_force(index, docs):
    for w in WORDS[:4]:
        want = {k for k, s, b, *_ in docs if w in query_tokens((s + " " + b).lower())}
        assert found(index, f"<exact> {w}") == want
        assert found(index, f"body <contains> <exact> {w}") == {k for k, s, b, *_ in docs if w in b.split()}


def test_set_laws(index):
    for a, b in itertools.combinations(WORDS[:3], 2):
        x, y = A.Term(a), A.Term(b)
        every = found(index, "*")
        assert found(index, x & y) <= found(index, x | y)
        assert found(index, ~x) | found(index, x) == every
        assert found(index, ~(x & y)) == found(index, ~x | ~y)
        assert found(index, x & ~y) == found(index, x) - found(index, y)


def test_text_and_tree_agree(index):
    pairs = [("<exact> java <and> <exact> build", A.And((A.Term("java", exact=True), A.Term("build", exact=True)))), ("num > 3", A.Relation("num", ">", 3)), ("<undefined> num", A.Undefined("num")), ("<exact> two <near/2> <exact> thread", A.Near(A.Term("two"), A.Term("thread"), n=2))]
    for text, tree in pairs:
        a = {r["key"]: r["score"] for r in index.search(text).df.collect()}
        b = {r["key"]: r["score"] for r in index.search(tree).df.collect()}
        assert a == pytest.approx(b)


def test_generated_booleans(index, docs):
    bag = {k: set(query_tokens((s + " " + b).lower())) for k, s, b, *_ in docs}
    rng = random.Random(3)
    for _ in range(6):
        a, b, c = rng.sample(WORDS, 3)
        q = f"(<exact> {a} <or> <exact> {b}) <and> <not> <exact> {c}"
        assert found(index, q) == {k for k, t in bag.items() if (a in t or b in t) and c not in t}


def test_scores_are_cosines(index, docs):
    n = len(docs)
    bags = {k: query_tokens((s + " " + b).lower()) for k, s, b, *_ in docs}
    df = {w: sum(w in t for t in bags.values()) for t in bags.values() for w in t}
    idf = {w: math.log(n / f) or 1e-7 for w, f in df.items()}
    w = lambda t, x: idf[x] * (1 + math.log(t.count(x)))
    for r in index.search("<exact> java <or> <exact> build").df.collect():
        t = bags[r["key"]]
        s = sum(w(t, x) * idf[x] for x in ("java", "build") if x in t)
        norm = math.sqrt(sum(w(t, x) ** 2 for x in set(t))) * math.hypot(idf["java"], idf["build"])
        assert r["score"] == pytest.approx(s / norm)


def test_relations(index, docs):
    num = {k: n for k, _, _, n, *_ in docs}
    assert found(index, "num != 4") == {k for k, n in num.items() if n != 4}
    assert found(index, "<not> <undefined> num") == {k for k, n in num.items() if n is not None}
    assert found(index, "num >= 3 <and> num < 6") == {k for k, n in num.items() if n is not None and 3 <= n < 6}
    assert found(index, "nosuch = 4") == set()
    assert found(index, "tags = B") == {k for k, *_, t, _ in docs if "b" in t}
    # several values: each bound may be met by another one
    assert found(index, "tags > a <and> tags < c") == {k for k, *_, t, _ in docs if any(x > "a" for x in t) and any(x < "c" for x in t)}
    assert found(index, "<undefined> tags") == {k for k, *_, t, _ in docs if not t}
    with pytest.raises(QueryError):
        found(index, "num = many")
    with pytest.raises(QueryError):
        found(index, "num <matches> 3*")


def test_dates_cover_days(index, docs):
    day = {k: d for k, *_, d in docs}
    assert found(index, "day = 08/02/2007") == {k for k, d in day.items() if d.date() == dt.date(2007, 8, 2)}
    assert found(index, 'day = "08/02/2007 12:00:00"') == {k for k, d in day.items() if d == dt.datetime(2007, 8, 2, 12)}
    assert found(index, "day > 08/20/2007") == {k for k, d in day.items() if d >= dt.datetime(2007, 8, 21)}


def test_proximity_by_brute_force(index, docs):
    for n in (1, 3):
        want = {k for k, s, b, *_ in docs if any(abs(i - j) <= n + 1 and i != j for t in (query_tokens(b), query_tokens(s.lower())) for i, x in enumerate(t) if x == "two" for j, y in enumerate(t) if y == "thread")}
        assert found(index, f"<exact> two <near/{n}> <exact> thread") == want
    phrase = {k for k, s, b, *_ in docs if " two thread " in f" {b} "}
    assert found(index, '"two thread"') == phrase


def test_least_penalty():
    assert least_penalty([[1], [2], [3]], 2, True, 0) == 0
    assert least_penalty([[1], [4]], 10, False, 0) == pytest.approx(0.2)
    assert least_penalty([[4], [1]], 10, False, 0) == pytest.approx(0.55)
    assert least_penalty([[4], [1]], 10, True, 0) is None
    assert least_penalty([[1], [], [2]], 10, False, 1) == pytest.approx(10)
    assert least_penalty([[1], [], [2]], 10, False, 0) is None
    assert least_penalty([[1], [50]], 10, False, 0) is None


def test_sorting_paging_and_groups(index, docs):
    rs = index.search("*")
    rows = [r["key"] for r in rs.all("-num,+key").collect()]
    want = [d[0] for d in sorted(docs, key=lambda d: (-(d[3] or 0), d[0]))]
    assert rows == want
    assert [r["key"] for r in rs.top(5, 10, "-num,+key").collect()] == want[10:15]
    g = {r["value"]: r["size"] for r in rs.group_by("tags").collect()}
    assert g["Empty"] == sum(not d[4] for d in docs) and g.get("a", 0) == sum(d[4].count("a") for d in docs)
    assert results_for(index, ["d01", "zz"]).size() == 1


def test_result_algebra(index):
    a, b = index.search(A.Term("java")), index.search(A.Term("build"))
    k = lambda r: {x["key"]: x["score"] for x in r.df.collect()}
    x, y = k(a), k(b)
    assert k(a.union(b)) == pytest.approx({i: x.get(i, 0) + y.get(i, 0) for i in x.keys() | y.keys()})
    assert k(a.intersect(b)) == pytest.approx({i: x[i] + y[i] for i in x.keys() & y.keys()})
    assert k(a.difference(b)) == pytest.approx({i: x[i] for i in x.keys() - y.keys()})


def test_find_similar_puts_the_document_first(index):
    top = V.find_similar(index, V.vector_of(index, "d07")).top(1).first()
    assert top["key"] == "d07" and top["score"] == pytest.approx(1.0)
    assert V.similarity(index, "d01", "d02").first()[0] == pytest.approx(V.similarity(index, "d02", "d01").first()[0])
    assert V.dot(V.vector_of_text(index, "java build"), V.vector_of_text(index, "java build")).first()[0] == pytest.approx(1.0)


def test_replace_delete_merge(spark, index):
    new = index.docs.filter("key = 'd03'").withColumn("num", F.lit(77).cast("long")).withColumn("body", F.lit("zebra"))
    up = index.upsert(new)
    assert found(up, "num = 77") == {"d03"} == found(up, "<exact> zebra")
    assert up.docs.count() == index.docs.count()
    assert "d03" not in found(index.delete(["d03"]), "*")
    assert found(index.merge(2), "<exact> java") == found(index, "<exact> java")
    assert found(index.purge(), "*") == set()


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    a = {r["key"]: r["score"] for r in index.search("<exact> java").df.collect()}
    b = {r["key"]: r["score"] for r in again.search("<exact> java").df.collect()}
    assert a == pytest.approx(b)


def test_lookups(index):
    assert {r["term"] for r in L.wildcard_terms(index, "in*ll").collect()} == {"install"}
    assert L.spelling(index, "instal").first() is None or L.spelling(index, "instal").first()["term"] == "install"
    assert L.spelling(index, "thraed", shared=0.4).first()["term"] == "thread"
    assert [r["value"] for r in L.top_values(index, "tags", 2).collect()][0] in "abc"


def test_passages(spark):
    df = spark.createDataFrame([(1, "a b the c d e the f the")], "key int, text string")
    rows = P.passages(df, "key", "text", ["the"], 1).orderBy("start").collect()
    assert [(r["start"], r["end"], r["passage"]) for r in rows] == [(2, 4, "b the c"), (6, 9, "e the f the")]
    assert P.passages(df, "key", "text", ["the"], -1).first()["positions"] == [3, 7, 9]
    assert df.select(P.highlight("text", ["the", "b"])).first()[0] == "a <b>b</b> <b>the</b> c d e <b>the</b> f <b>the</b>"
    assert [tuple(x) for x in df.select(P.match_spans("text", ["the"])).first()[0]] == [("the", 4, 7), ("the", 14, 17), ("the", 20, 23)]
    assert df.select(P.elide("text", 8)).first()[0] == "a b t..."


def test_clusters(spark):
    pts = [(i, [float(i // 5 * 10), float(i % 5)]) for i in range(15)] + [(99, [])]
    df = spark.createDataFrame(pts, "key int, features array<double>")
    for method in (K.kmeans, K.hac, K.mst):
        got = {r["key"]: r["cluster"] for r in method(df, 3).collect()}
        assert got[99] == -1
        assert len({frozenset(k for k in range(15) if got[k] == c) for c in {got[k] for k in range(15)}} & {frozenset(range(0, 5)), frozenset(range(5, 10)), frozenset(range(10, 15))}) == 3


def test_clusters_of_many_elements(spark, monkeypatch):
    """In rounds of tasks as in one: on random points with copies, and beyond 4,000 rows."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(2, 6)), 20, 0), rng.normal(size=(60, 6)) + 4])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(999, [])], "key int, features array<double>")
    monkeypatch.setattr(K, "HELD_CLUSTERS", 25)
    parts = lambda out: {frozenset(r["key"] for r in out if r["cluster"] == c) for c in {r["cluster"] for r in out}}
    for method in (K.hac, K.mst):
        for k in (3, 12, 200):
            one = method(df, k).collect()
            with monkeypatch.context() as m:
                m.setattr(K, "MAX_PAIRWISE", 10)
                got = method(df, k).collect()
            assert parts(got) == parts(one)
            assert {r["key"]: r["distance"] for r in got} == pytest.approx({r["key"]: r["distance"] for r in one})
    many = spark.createDataFrame([(i, [float(i % 3 * 100), float(i) / 5000]) for i in range(4100)], "key int, features array<double>")
    assert parts(K.mst(many, 3).collect()) == {frozenset(range(c, 4100, 3)) for c in range(3)}
    assert parts(K.hac(many, 3).collect()) == {frozenset(range(c, 4100, 3)) for c in range(3)}


def test_hac_finds_its_joins_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 5)), rng.normal(size=(500, 5)) * 0.1 + 3, np.round(rng.normal(size=(200, 5)))])
    want = K._complete_linkage(x.copy(), 1)
    assert len(set(want)) == 1
    calls, plain = [], K._in_tasks
    monkeypatch.setattr(K, "_in_tasks", lambda spark, parts, run: calls.append(len(parts)) or plain(spark, parts, run))
    monkeypatch.setattr(K, "HELD_CLUSTERS", 40)
    same = lambda a, b: len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))
    some = x[:1400]
    for k in (5, 60, 700):
        calls.clear()
        assert same(K._complete_linkage_rounds(spark, some, k), K._complete_linkage(some, k))
        assert len(calls) <= 4
    # few pairs at once, larger blocks of one cluster, and nothing but equal distances
    for name, value in (("PAIRS", 300), ("PAIR_TASKS", 3), ("TASK_ROWS", 16), ("COLUMNS", 32)):
        monkeypatch.setattr(K, name, value)
    assert same(K._complete_linkage_rounds(spark, some[700:1100], 5), K._complete_linkage(some[700:1100], 5))
    assert len(set(K._complete_linkage_rounds(spark, np.eye(60), 7).tolist())) == 7


def test_classification(index, spark):
    members = index.search("<exact> java").df.select("key")
    t = C.contingency(index, members, prune=False)
    row = t.filter("term = 'java'").first()
    assert row["b"] == 0 and row["c"] == 0 and row["a"] == members.count()
    assert C.chi_squared(t, index.n_docs, 1).first()["term"] == "java"
    model = C.rocchio(index, members, n_features=20)
    top = C.scores(index, model).orderBy(F.col("score").desc()).limit(3).join(members, "key", "left_semi").count()
    assert top == 3
    folds = C.k_folds(members, k=3).groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_rocchio_query_tries_the_whole_grid(spark, monkeypatch):
    from fathomdex import queries as engine

    tried, grid = [], C.grid_points
    monkeypatch.setattr(C, "grid_points", lambda *a: tried.append(a) or grid(*a))
    engine.QUERIES["rocchio_classify"](spark, "/root/testdata/sf0.001")
    three = (32.0, 64.0, 128.0)
    assert tried == [((0.0, 8.0), three, three)]
    assert set(grid(*tried[0])) == {(a, b, g) for a in (0.0, 8.0) for b, g in itertools.permutations(three, 2)}


def test_ranking_quality_by_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        own = sorted((rng.choice([0, 1, 2, 3, 5, 8]) for _ in range(rng.randint(1, 12))), reverse=True)
        others = [rng.choice([0, 1, 2, 4, 5]) for _ in range(30)]
        above = np.array([sum(o >= s for o in others) for s in own])
        points, best = [], (0.0, 0.0)
        curve = [((k + 1) / (k + 1 + above[k]), (k + 1) / len(own), own[k]) for k in range(len(own)) if own[k] > 0]
        for level in range(11):
            points.append(max([p for p, r, _ in curve if r >= level / 10 - 1e-12], default=0.0))
        for p, r, s in curve:
            f1 = 2 * p * r / (p + r)
            if f1 > best[0] + 1e-12:
                best = (f1, s)
        quality, cut = C.ranking_quality(np.array(own, float), above, len(own))
        assert quality == pytest.approx(sum(points) / 11 if curve else 0.0) and cut == best[1]


def test_classes_are_learned_kept_and_applied(spark, tmp_path):
    rng = random.Random(11)
    rows = [(f"k{i:03d}", " ".join(rng.choice(["apple", "pear", "plum"] if i % 4 == 0 else WORDS) for _ in range(8))) for i in range(120)]
    ix = Index.build(spark.createDataFrame(rows, "key string, body string"), "key", [FieldSpec("body", indexed=True, tokenized=True, vectored=True)])
    fruit = spark.createDataFrame([(f"k{i:03d}",) for i in range(0, 120, 4)], "key string")
    model = C.RocchioModel.train(ix, "fruit", fruit, n_features=10, back_off=False)
    found_by_model = {r["key"] for r in model.classify(ix).collect()}
    # held-out members may score below the threshold, which training members set
    assert len(found_by_model) >= 28 and found_by_model <= {r["key"] for r in fruit.collect()}
    assert C.RocchioModel.train(ix, "none", fruit.limit(0)).classify(ix).count() == 0
    C.Classes(spark, [model]).save(f"{tmp_path}/c")
    kept = C.Classes.load(spark, f"{tmp_path}/c")
    assert kept.names() == ["fruit"] and kept.get("fruit").threshold == model.threshold
    out = kept.classified(ix)
    assert found(out, "class = fruit") == found_by_model
    assert kept.classified(ix, skip=["fruit"]).search("class = fruit").df.count() == 0
    more = kept.ingest(out, spark.createDataFrame([("new", "pear plum"), ("k000", "java build")], "key string, body string"))
    got = {r["key"]: r["class"] for r in more.docs.select("key", "class").collect()}
    assert got["new"] == ["fruit"] and got["k000"] == [] and {k for k, c in got.items() if c} == found_by_model - {"k000"} | {"new"} and len(got) == 121


def test_order_over_ranges(spark):
    from fathomdex.session import ranked

    rng = random.Random(2)
    rows = [(i, rng.randint(0, 5), rng.randint(0, 1), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, score int, hit int, `a.b` string").repartition(7)
    got = ranked(df, [F.col("score").desc(), F.col("k")], {"hits": "hit"}).collect()
    hits = 0
    for place, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        hits += r[2]
        assert (place, hits) in {(g["rank"], g["hits"]) for g in got if g["k"] == r[0]}
    assert ranked(df.limit(0), [F.col("k")]).count() == 0


def test_feature_clusters(spark):
    df = spark.createDataFrame([("run", 1.0), ("runs", 2.0), ("x1", 5.0), ("java", 0.0)], "term string, weight double")
    names = lambda how, **kw: sorted(r["terms"] for r in C.clustered_features(df, how, **kw).collect())
    assert names("contingency") == [["java"], ["run"], ["runs"]]
    assert names("stemming") == names("morph") == [["java"], ["run", "runs"]]

    class Alias:
        def variants_of(self, term):
            return ["java"] if term == "run" else []

    assert names("source", source=Alias()) == [["java", "run"], ["runs"]]
    w = C.cluster_weights(C.clustered_features(df, "stemming"), df)
    top = C.first_clusters(w).collect()
    assert [(r["cluster"], r["weight"]) for r in top] == [("run", 1.0)]
    twice = {r["cluster"]: (r["terms"], r["weight"]) for r in C.merged_clusters(w, w).collect()}
    assert twice == {"run": (["run", "runs"], 6.0), "java": (["java"], 0.0)}
    assert C.cluster_of(w, "runs").first()["cluster"] == "run"


def test_analyzers(spark):
    rows = [("a", "東京都に行く and Java", "running tests"), ("b", "京都 大阪", "runs"), ("c", "大阪へ東京", "the run of it"), ("d", "東", None)]
    fields = [FieldSpec("t", indexed=True, tokenized=True, vectored=True, analyzer="universal"), FieldSpec("u", indexed=True, tokenized=True, analyzer="stem")]
    ix = Index.build(spark.createDataFrame(rows, "key string, t string, u string"), "key", fields)
    cjk = {"東京": "ac", "京都": "ab", "東京都": "a", "東": "acd", "java": "a", "大阪": "bc", '"京都 大阪"': "b", '"京都大阪"': "", "java <and> running": "a"}
    for q, want in cjk.items():
        assert found(ix, q) == set(want), q
    assert found(ix, "runs") == {"a", "b", "c"} and found(ix, A.Term("runs").within("t")) == set()
    with pytest.raises(ValueError):
        FieldSpec("t", analyzer="no such")
    register_analyzer("comma", lambda c: F.split(F.coalesce(c, F.lit("")), ","), lambda q: q.split(","))
    ix = Index.build(spark.createDataFrame([("a", "x y,z"), ("b", "x,y z")], "key string, t string"), "key", [FieldSpec("t", indexed=True, tokenized=True, analyzer="comma")])
    assert found(ix, A.Term("x y")) == {"a"} and found(ix, A.Term("z")) == {"a"}


def test_stop_words_of_queries_are_left_out(spark):
    ix = Index.build(spark.createDataFrame([("a", "the end of java"), ("b", "java")], "key string, t string"), "key", [FieldSpec("t", indexed=True, tokenized=True, analyzer="stop")])
    assert found(ix, "the <and> java") == {"a", "b"} and found(ix, "the") == set()
    assert found(ix, A.Phrase(A.Term("end"), A.Term("the"), A.Term("java"))) == {"a"}


def test_passage_builder(spark):
    df = spark.createDataFrame([(1, "a the b c d e java the z", "java"), (2, None, "no")], "key int, text string, title string")
    got = P.PassageBuilder(["the", "java"]).field("text", "unique", 1, 9, True).field(None).passages(df, "key").orderBy("field", "n").collect()
    assert [(r["field"], r["n"], r["passage"]) for r in got] == [("text", 1, "a the b"), ("text", 2, "e java..."), ("text", 3, "java t..."), ("title", 1, "java")]
    one = P.PassageBuilder(["the", "java"], "[", "]").field("text", "join", 0).passages(df, "key").collect()
    assert len(one) == 1 and one[0]["passage"] == "the b c d e java the" and one[0]["positions"] == [2, 7, 8] and one[0]["score"] == 1.0
    assert one[0]["highlighted"] == "[the] b c d e [java] [the]"
    assert P.PassageBuilder(["the"]).field("text").passages(df, "key").first()["start"] == 1


def test_senses_by_brute_force(spark):
    rng = random.Random(5)
    labelled = [(rng.choice("xyz"), [rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))]) for _ in range(40)]
    asked = [(f"k{i}", [rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))]) for i in range(60)]
    model = W.train_senses(spark.createDataFrame(labelled, "sense string, context array<string>"))
    m = model.collect()
    logp = {(r["sense"], r["term"]): r["logp"] for r in m}
    senses = {(r["sense"], r["prior"], r["missing"]) for r in m}
    got = {r["key"]: (r["sense"], r["score"]) for r in W.assign_senses(spark.createDataFrame(asked, "key string, context array<string>"), model).collect()}
    for k, ctx in asked:
        best = max(prior + sum(logp.get((s, t), missing) for t in ctx) for s, prior, missing in senses)
        s, score = got[k]
        assert score == pytest.approx(best)
        assert next(prior + sum(logp.get((s, t), missing) for t in ctx) for n, prior, missing in senses if n == s) == pytest.approx(best)


def _shuffled(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in map(sc.statusStore().executorList(False).apply, range(sc.statusStore().executorList(False).size())))


def test_senses_with_rare_terms_joined_and_many_senses(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: [words[min(int(rng.expovariate(0.15)), 39)] for _ in range(n)]
    labelled = [(rng.choice("xyz"), draw(rng.randint(1, 6))) for _ in range(80)]
    asked = [(f"k{i}", [*draw(rng.randint(1, 7)), "unseen"]) for i in range(200)] + [("k0", draw(3)), ("none", [])]
    df = spark.createDataFrame(asked, "key string, context array<string>")
    model = W.train_senses(spark.createDataFrame(labelled, "sense string, context array<string>"))
    m = model.collect()
    logp = {(r["sense"], r["term"]): r["logp"] for r in m}
    senses = {(r["sense"], r["prior"], r["missing"]) for r in m}
    merged = {}
    for k, ctx in asked:
        merged[k] = merged.get(k, []) + ctx
    want = {k: max(prior + sum(logp.get((s, t), missing) for t in ctx) for s, prior, missing in senses) for k, ctx in merged.items() if ctx}
    for cells in (0, 40, 2_000_000):
        got = {r["key"]: r["score"] for r in W.assign_senses(df, model, most_cells=cells).collect()}
        assert got == pytest.approx(want)
    monkeypatch.setattr(W, "AT_ONCE", 9)
    assert {r["key"]: r["score"] for r in W.assign_senses(df, model, most_cells=40).collect()} == pytest.approx(want)
    monkeypatch.setattr(W, "MOST_SENSES", 2)
    assert {r["key"]: r["score"] for r in W.assign_senses(df, model).collect()} == pytest.approx(want)


def test_senses_shuffle_contexts_and_not_their_senses(spark):
    labelled = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 40).alias("sense"), F.array(*[F.concat(F.lit(f"t{i}"), F.hash("id", F.lit(i)) % 3) for i in range(6)]).alias("context"))
    asked = spark.range(20_000).select("id", F.array(*[F.concat(F.lit(f"t{i}"), F.hash("id", F.lit(i)) % 3) for i in range(6)]).alias("context")).withColumnRenamed("id", "key")
    model = W.train_senses(labelled)
    before = _shuffled(spark)
    assert W.assign_senses(asked, model).count() == 20_000
    assert (_shuffled(spark) - before) / 20_000 < 60


def test_senses_found_in_a_sample_go_to_all(spark):
    rows = [(i, 0, ["river", "water", "boat"] if i % 2 else ["money", "loan", "cash"]) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, pos int, context array<string>")
    got = {r["key"]: r["sense"] for r in W.discover_senses(df, 2, most_contexts=20).collect()}
    assert len(got) == 60 and len({got[i] for i in range(0, 60, 2)}) == len({got[i] for i in range(1, 60, 2)}) == 1 and got[0] != got[1]


def test_stop_words_in_one_field(spark):
    df = spark.createDataFrame([("review",), ("title",)], "field string")
    rows = df.select(T.stop_in_field(F.split(F.lit("the good"), " "), "field")).collect()
    assert [r[0] for r in rows] == [["good"], ["the", "good"]]


def test_taxonomy(spark):
    t = Taxonomy(spark.createDataFrame([("b", "a", "kind_of"), ("c", "b", "morph"), ("a", "c", "kind_of"), ("x", "y", "kind_of")], "child string, parent string, link string"))
    assert t.subsumed("a") == ["b", "c"]
    assert {r["child"] for r in t.children("a").collect()} == {"b"}


def test_markup(spark):
    html = '<html><head><title>T &amp; U</title><meta name="keywords" content="k1 k2"></head><body><script>x<y</script><p>One<br>two <a href="/q">li<b>n</b>k</a></body></html>'
    df = spark.createDataFrame([(html,)], "html string")
    r = markup.html_fields(df).first()
    assert (r["title"], r["keywords"], r["anchors"], r["bold"]) == ("T & U", "k1 k2", ["link"], ["n"])
    assert r["body"].endswith("One two link")
    box = spark.createDataFrame([("m", "From a b\nFrom: x@y\nSubject: Hi\nDate: Fri, 17 Aug 2007 12:50:03 +0000\nReferences: <1> <2>\n\nBody\nline\nFrom c d\nSubject: Two\n\nEnd\n")], "key string, text string")
    rows = markup.parse_mbox(box).orderBy("sequence").collect()
    assert [r["subject"] for r in rows] == ["Hi", "Two"] and rows[0]["reference"] == ["<1>", "<2>"]
    assert rows[0]["date"] == dt.datetime(2007, 8, 17, 12, 50, 3) and rows[0]["body"].startswith("Body\nline")


def test_simple_indexer(spark):
    s = ingest.SimpleIndexer(spark)
    s.start_document("SUN")
    s.add_field("Name", "hello world")
    s.add_term("extra", 2, "name")
    s.end_document()
    rows, terms = s.finish("key string, name string")
    ix = Index.build(rows, "key", [FieldSpec("name", "string", indexed=True, tokenized=True, saved=True)]).add_terms(terms)
    assert found(ix, "hello") == {"SUN"} == found(ix, "<exact> extra")


def test_last_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, name string, seq int")
    ix = Index.build(rows, "key", [FieldSpec("name", "string", indexed=True, tokenized=True, saved=True)], order="seq")
    assert found(ix, "new") == {"k"} and found(ix, "<exact> old") == set()


def test_streaming_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 3), (2, "d", 0)], "key int, v string, t int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.filter("key = 1").withColumn("t", F.lit(9)).write.mode("append").parquet(str(tmp_path / "in"))
    store, told = KeyedStore(spark, str(tmp_path / "store"), "key", rows.schema), []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index_stream(stream, store, str(tmp_path / "cp"), "t", [lambda keys, b: told.append(b)]).awaitTermination()
    got = {r["key"]: r["t"] for r in store.read().collect()}
    assert got == {1: 9, 2: 1} and len(told) >= 2
    assert {r["key"]: r["v"] for r in latest_per_key(rows, "key", "t").collect()} == {1: "c", 2: "b"}


def test_store_goes_on_after_a_restart_and_a_replay(spark, tmp_path):
    """A new object on the folder finds everything; a batch that runs again changes
    nothing; folders that nothing names are deleted."""
    frame = lambda rows: spark.createDataFrame(rows, "key int, v string, t int")
    schema = frame([(0, "", 0)]).schema
    opened = lambda: KeyedStore(spark, str(tmp_path / "store"), "key", schema, buckets=4)
    rows = lambda: {(r["key"], r["v"]) for r in opened().read().collect()}
    assert rows() == set()
    assert {r[0] for r in opened().upsert(frame([(i, "a", 1) for i in range(20)]), 0, "t").collect()} == set(range(20))
    for _ in range(2):
        told = opened().upsert(frame([(1, "b", 2), (2, "old", 0), (99, "b", 2), (None, "n", 1)]), 1, "t")
        assert {r[0] for r in told.collect()} == {1, 2, 99, None}
        assert rows() == {(i, "b" if i == 1 else "a") for i in range(20)} | {(99, "b"), (None, "n")}
    opened().upsert(frame([]), 2, "t")
    before = rows()
    for k in range(3, 8):
        opened().upsert(frame([(3, f"v{k}", k)]), k)
    assert rows() == {x for x in before if x[0] != 3} | {(3, "v7")}
    assert opened().manifests() == [5, 6, 7]
    # half a batch: rows without a manifest
    frame([(1, "x", 1)]).write.parquet(str(tmp_path / "store" / "batch-000000000008-x" / "_bucket=1"))
    assert rows() == {x for x in before if x[0] != 3} | {(3, "v7")}


def test_clusters_of_search_results(spark):
    """k-means over the vectors of found documents, which are a plan of many joins."""
    from fathomdex import queries as engine

    got = engine.QUERIES["cluster_results"](spark, "/root/testdata/sf0.01").collect()
    found_ = engine.docs_index(spark, "/root/testdata/sf0.01").search(A.Term("idiot")).df.count()
    assert len(got) == found_ and {r["cluster"] for r in got} <= {-1, 0, 1, 2}
    rows = spark.createDataFrame([(1, [])], "key int, features array<double>")
    from fathomdex.operators.clustering import kmeans

    assert [tuple(r) for r in kmeans(rows, 2).collect()] == [(1, -1, None)]


def test_two_terms_by_brute_force(spark):
    """The plan's least penalty of two terms' positions, against all windows."""
    import random

    from fathomdex.plans import compile as C

    rng = random.Random(4)
    rows = [(i, sorted(rng.sample(range(1, 60), rng.randint(0, 9))), sorted(rng.sample(range(1, 60), rng.randint(0, 9)))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p0 array<int>, p1 array<int>")
    for size, ordered in ((3, False), (10, True), (150, False), (2, True)):
        got = {r["i"]: r["x"] for r in df.select("i", C._pair_penalty(size, ordered).alias("x")).collect()}
        for i, a, b in rows:
            want = C.least_penalty([a, b], size, ordered, 0)
            assert (got[i] is None and want is None) or got[i] == pytest.approx(want), (i, a, b, size, ordered)


def test_weightings_of_one_index(spark, docs, index, tmp_path):
    """A saved index scores by any weighting as one that was built with it."""
    from fathomdex.operators.vectors import find_similar, vector_of
    from fathomdex.operators.weights import weightings

    index.save(str(tmp_path / "ix"))
    saved = Index.load(spark, str(tmp_path / "ix"))
    scores = lambda rs: {r["key"]: pytest.approx(r["score"]) for r in rs.df.collect()}
    for w in weightings():
        own = Index(index.docs, list(index.fields.values()), index.key, index.postings, w)
        for ix in (saved.using(w), index.using(w)):
            assert scores(ix.search(A.any_terms("java", "build"))) == {k: v.expected for k, v in scores(own.search(A.any_terms("java", "build"))).items()}
            key = index.docs.first()[index.key]
            assert scores(find_similar(ix, vector_of(ix, key))) == {k: v.expected for k, v in scores(find_similar(own, vector_of(own, key))).items()}


def test_field_options(index, docs):
    """Default fields restrict what names none; multipliers raise a field's occurrences."""
    assert found(index, "<exact> java", fields=["body"]) == {k for k, _, b, *_ in docs if "java" in b.split()}
    plain = {r["key"]: r["score"] for r in index.search(A.Term("java")).df.collect()}
    more = {r["key"]: r["score"] for r in index.search(A.Term("java"), multipliers={"body": 3.0}).df.collect()}
    bodies = {k for k, _, b, *_ in docs if "java" in b.split()}
    assert plain.keys() == more.keys()
    assert all((more[k] > plain[k]) == (k in bodies) for k in plain)


def test_observed_results(index):
    rs, seen = index.search("<exact> java").observed()
    n = rs.df.count()
    assert seen.get["size"] == n and seen.get["best"] > 0


def test_index_by_document_has_the_same_vectors_and_classes(spark, monkeypatch):
    from fathomdex import session

    rng = random.Random(9)
    words = [f"{c}{d}" for c in "abcdefghijkl" for d in ("x", "Y", "z1", "q")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), rng.choice(words)) for i in range(300)] + [(300, "", None), (301, None, "aX ax"), (302, None, None)]
    fields = [FieldSpec("text", indexed=True, tokenized=True, vectored=True), FieldSpec("title", indexed=True, tokenized=True)]
    plain = Index.build(spark.createDataFrame(rows, "key int, text string, title string"), "key", fields, unique=True)
    members = spark.createDataFrame([(i,) for i in range(0, 303, 5)], "key int")
    of = lambda df: {tuple(r)[:-1]: pytest.approx(r[-1]) for r in df.collect()}
    want = of(V.vectors(plain))
    model = of(C.rocchio(plain, members, n_features=1000))
    for most in (200_000, 20):
        monkeypatch.setattr(session, "COMMON_ROWS", most)
        ix = plain.by_document()
        assert {tuple(r)[:-1]: r[-1] for r in V.vectors(ix).collect()} == want
        assert {tuple(r)[:-1]: r[-1] for r in C.rocchio(ix, members, n_features=1000).collect()} == model
    assert sorted(map(tuple, ix.term_stats().collect())) == sorted(map(tuple, plain.term_stats().select("term", "ft", "cf", "maxfdt").collect()))
    features = C.rocchio(plain, members, n_features=30)
    classes = C.Classes(spark, [C.RocchioModel("wide", features, 0.05), C.RocchioModel("near", features, 0.3)])
    a, b = ({(r["key"], r["class"]): r["score"] for r in classes.assignments(x).collect()} for x in (plain, ix))
    assert a and b == pytest.approx(a)


def test_class_field_keeps_no_postings(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(3)
    rows = [(i, " ".join(f"t{rng.randint(0, 3000):x}y" for _ in range(300))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(400).selectExpr("id as doc_id", "1 as quality", "cast(id % 9 = 0 as int) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = lambda: sum(r.memSize() + r.diskSize() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    before, written = kept(), _shuffled(spark)
    assert entry.queries()["class_field"](spark, str(tmp_path)).count() == 400
    assert kept() == before and _shuffled(spark) - written < sum(len(t) for _, t in rows)
