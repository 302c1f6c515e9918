"""Operators over whole corpora: mixing, near duplicates, toxicity, the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomdex.llm import mixing, ngram_join, toxicity


def words(rng, n, alphabet="abcdefghijklmnop"):
    return ["".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n)]


# ---- op3


def water_fill(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(1)
    src = ["b", "a", None, "é", "z", "B"]
    rows = [(i, " ".join(words(rng, rng.randint(0, 30))) if i % 17 else None, rng.choices(src, (9, 1, 1, 1, 1, 0.3))[0]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("rate", F.lit("x"))
    out = mixing.allocation(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sums = Counter()
    for i, _, s in rows:
        sums[s] += size[i]
    want = water_fill(sums)
    by = {i: s for i, _, s in rows}
    assert len(out) == 600
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[by[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[by[r["doc_id"]]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sum(want.values()) == pytest.approx(sum(sums.values()))
    again = {(r["doc_id"], r["taken"]) for r in mixing.allocation(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}
    df = df.withColumn("_rate", F.lit(7)).withColumn("_source", F.lit("s")).withColumn("_copy", F.lit(9)).withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r"))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert {tuple(r)[3:] for r in mixed.collect()} <= {tuple(r)[3:] for r in df.collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.allocation(none).count() == 0 and mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["target"], r["taken"]) for r in mixing.allocation(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


# ---- op6


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def joined(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(df).collect()}


def test_join_against_brute_force(spark):
    rng = random.Random(2)
    base = [words(rng, rng.randint(3, 60)) for _ in range(25)]
    texts = [None, "", " \n ", "a b", "A  b", "a b c d e", "a b c d E"]
    for w in base:
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 12))):
                v[rng.randrange(len(v))] = "zz%d" % rng.randint(0, 9)
            texts.append(" ".join(v))
        texts.append(" ".join(w))
    shared = " ".join(words(rng, 60))
    texts += [" ".join(words(rng, 30)) + " " + shared for _ in range(12)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("component_id", F.lit(1))
    assert joined(df.repartition(5)) == brute_components(rows)


def test_join_of_large_groups(spark):
    """Lists of far more than LIST_MAX classes: near copies whose links form chains, and
    many that share their rarest shingles without linking."""
    rng = random.Random(3)
    rows = []
    origin = words(rng, 80)
    for i in range(120):
        v = list(origin)
        for _ in range(rng.randint(0, 5)):
            v[rng.randrange(80)] = "".join(rng.choice("qrstuvw") for _ in range(6))
        rows.append((1000 + i, " ".join(v)))
    chain = words(rng, 140)
    rows += [(2000 + i, " ".join(chain[3 * i : 3 * i + 40])) for i in range(30)]
    rows += [(3000 + i, rows[5][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == brute_components(rows)


def test_links_are_counted_in_full(spark, monkeypatch):
    """Every link of every document, in groups far over LIST_MAX that overlap, across
    blocks, with copies, and in short lists beside them."""
    rng = random.Random(5)
    rows = []
    for g, n in enumerate((60, 25, 3, 2)):
        origin = words(rng, 70)
        for i in range(n):
            v = list(origin)
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(70)] = "".join(rng.choice("qrstuvw") for _ in range(6))
            rows.append((1000 * g + i, " ".join(v)))
    chain = words(rng, 140)
    rows += [(7000 + i, " ".join(chain[3 * i : 3 * i + 40])) for i in range(30)]
    rows += [(8000 + i, rows[3][1]) for i in range(15)] + [(9000, None), (9001, "a b"), (9002, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for i, t in rows}
    want = {i: sum(i != j and bool(a & b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    monkeypatch.setattr(ngram_join, "COUNT_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", 8)
    monkeypatch.setattr(ngram_join, "HOT_LOG", 4)
    out = ngram_join.join_documents(df).collect()
    assert {r["doc_id"]: r["n_links"] for r in out} == want
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows)


def test_join_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert joined(none) == {}
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "other words are in here now")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.join_documents(df).collect())
    assert rows == [(-1, 7), (7, 7), (7, 7), (9, 9)]
    kept = ngram_join.keep_one(df.withColumn("lang", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r["doc_id"] or -1 for r in kept.collect()) == [7, 9]


def test_join_of_repeated_and_null_ids(spark):
    """Rows of one id are one document, whatever their order; null ids stay where nothing
    that they link with has an id."""
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    near = lambda w: " ".join([*w[:-1], "zz"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, None), (2, near(a)), (3, near(b)), (4, "alone are these words of it"), (None, "x y z"), (None, "x y z"), (None, near(b)), (5, ""), (5, "")]
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_join.join_documents(df).collect())
        assert got == Counter([(1, 1, 1), (1, 1, 2), (1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0), (None, None, 1), (None, None, 1), (None, 1, 2), (5, 5, 0), (5, 5, 0)])
        kept = ngram_join.keep_one(df.withColumn("_id", F.lit(0)).withColumn("key", F.lit("k")).withColumn("a.b", F.lit(2)))
        assert kept.columns == ["doc_id", "text", "_id", "key", "a.b"]
        # of document 1, the first row by its columns: null texts are left out of them
        assert sorted(((r["doc_id"] or 0, r["text"] if r["doc_id"] != 1 else "") for r in kept.collect()), key=str) == sorted([(1, ""), (4, "alone are these words of it"), (0, "x y z"), (5, "")], key=str)


def thue_morse(n):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t


@pytest.mark.parametrize("n", [10, 12])
def test_words_that_polynomials_confuse(spark, n):
    x = thue_morse(n)
    y = x.translate(str.maketrans("ab", "ba"))
    rest = " ".join(words(random.Random(n), 4))
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x), (4, y), (5, f"{x} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == brute_components(rows)


def test_shingles_of_one_hash_are_told_apart_by_their_words(monkeypatch):
    texts = [b"a b c d e f", b"a b c d e f g", b"q r s t u v", b"", b"a b", None, b"x" * 400]
    plain = ngram_join.exact_sets(texts)
    monkeypatch.setattr(ngram_join, "strong", lambda w: np.zeros(len(w), np.uint64))
    told = ngram_join.exact_sets(texts)
    for sets in (plain, told):
        assert [len(s) for s in sets] == [2, 3, 2, 0, 1, 0, 1]
        assert len(np.intersect1d(sets[0], sets[1])) == 2 and not len(np.intersect1d(sets[0], sets[2]))


def test_suffix_filter_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 63, rng.integers(1, 90)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert ngram_join.may_link(a, b, 75) or 100 * both < 75 * (len(a) + len(b) - both)
    assert not ngram_join.may_link(np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64), 75)


def test_overlaps_against_brute_force(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(ngram_join, "DENSE", 5)
    monkeypatch.setattr(ngram_join, "DENSE_COLUMNS", 7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(20)]
    for left in (20, 7):
        base = 0 if left == 20 else left
        got = ngram_join._overlaps(sets, left)
        for i in range(left):
            for j in range(base, 20):
                if i != j:
                    assert got[i, j - base] == len(np.intersect1d(sets[i], sets[j]))


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.7], rng.integers(0, 1 << 63, rng.integers(1, 90)).astype(np.uint64)]))
        assert ngram_join._differ(ngram_join.parity_bits(a), ngram_join.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_prefixes_and_needed():
    for n in range(1, 200):
        assert ngram_join.prefix_size(n) == n - -(-75 * n // 100) + 1
        for m in range(n, min(200, n * 4 // 3 + 1)):
            o = ngram_join.needed(n, m)
            assert 100 * o >= 75 * (n + m - o) and 100 * (o - 1) < 75 * (n + m - o + 1)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 499), (499, 498)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in ngram_join.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 499: 498, 500: 498}


# ---- op1


def brute_score(text, m):
    """The score of one text, window by window, with compressors made from scratch."""
    import math

    import zstandard

    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    saved, held = [], []
    for w in [*(text or "").encode().lower().split(), None]:
        if w is not None:
            held += [w[k : k + toxicity.WINDOW] for k in range(0, len(w), toxicity.WINDOW)] if len(w) > toxicity.WINDOW else [w]
        while held and (w is None or sum(len(x) + 1 for x in held) >= toxicity.WINDOW):
            n = next((k + 1 for k in range(len(held)) if sum(len(x) + 1 for x in held[: k + 1]) >= toxicity.WINDOW), len(held))
            window = b" " + b" ".join(held[:n]) + b" "
            held = held[n:]
            saved.append(min(toxicity.MAX_CUT, max(0, size(window, m.ordinary) - size(window, m.toxic + m.ordinary))))
    n, hit = len(saved), sum(x >= m.cut for x in saved)
    z = (hit - n * m.chance) / math.sqrt(n * m.chance * (1 - m.chance) + 0.5)
    x = [math.copysign(math.log1p(abs(z)), z) if z else 0.0, z, min(hit / max(n, 1), 0.2), min(sum(saved) / max(n, 1), 1.0)]
    return 1 / (1 + math.exp(-max(-30, min(30, m.weights[0] + sum(w * (v - a) / b for w, v, a, b in zip(m.weights[1:], x, m.mean, m.scale, strict=True))))))


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.withColumn("toxicity", F.lit(1)).withColumn("row", F.lit("r")).withColumn("a.b", F.lit(2))
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out()), model, "score").select("score", "toxic", "text").collect()
    s, y = np.array([r["score"] for r in held]), np.array([r["toxic"] for r in held])
    for r in held[:60]:
        assert r["score"] == pytest.approx(brute_score(r["text"], model), abs=1e-9)
    assert toxicity._order(s, y) > 0.93
    assert ((s >= 0.5) & (y == 0)).sum() <= 0.01 * (y == 0).sum()
    assert ((s >= 0.5) & (y == 1)).sum() >= 0.7 * (y == 1).sum()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "some text", None), (3, "some text", None)], "doc_id long, text string, row string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r["toxicity"] for r in toxicity.score(docs, model).collect()] == [0.0] * 4
    assert toxicity.filter_toxic(docs, labels).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_carries_columns_of_any_name(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    odd = docs.withColumn("toxicity", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2))
    kept = toxicity.filter_toxic(odd, labels)
    assert kept.columns == odd.columns and {r["toxicity"] for r in kept.collect()} == {"mine"}
    assert 0 < kept.count() <= docs.count()
    long = spark.createDataFrame([(1, "plain words of text " * 60_000), (2, "x" * 500_000)], "doc_id long, text string")
    assert toxicity.score(long, toxicity.fit(docs, labels)).count() == 2


def test_windows_keep_every_word():
    rng = random.Random(5)
    t = " ".join(words(rng, 500)) + " " + "y" * 333
    assert b"".join(b"".join(toxicity.windows(t.encode(), 40)).split()) == t.replace(" ", "").encode()


# ---- pipeline


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        docs = stage(spark, docs, d).cache()
        assert docs.columns == names, name
        after = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(after) <= set(before)
        seen.append(len(after))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 0 < seen[-1] < 200


def test_pipeline_stages_by_brute_force(spark):
    """Each stage's rows from its own input, by plain Python; the learned list and the
    learned scores are those of the operators' fits on that input."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from fathomdex.llm import quality
    from tests.llm.test_text_ops import brute_stats

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r"))
    rows = {n: sorted(x.collect(), key=str) for n, x in [("in", docs)]}
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        rows[name] = sorted(docs.collect(), key=str)
    old = {n: list(rows)[list(rows).index(n) - 1] for n in list(rows)[1:]}

    def text_of(n):
        return {r["doc_id"]: r["text"] for r in rows[old[n]]}

    # quality: the base checks by hand, the list's verdict by its statistics
    rule = {r["doc_id"]: r["rule"] for r in quality.assess(first, labels).collect()}
    stats = {i: brute_stats(t) for i, t in text_of("quality_rules").items()}
    good = {i for i, s in stats.items() if s[0] >= 50 and 100 * s[4] <= 50 * s[0] and rule[i] is None}
    assert [r for r in rows["in"] if r["doc_id"] in good] == rows["quality_rules"]
    # toxicity: every window of every text
    kept = spark.createDataFrame(rows["quality_rules"], first.schema)
    model = toxicity.fit(kept, labels)
    good = {i for i, t in text_of("toxicity").items() if brute_score(t, model) < 0.5}
    assert [r for r in rows["quality_rules"] if r["doc_id"] in good] == rows["toxicity"]
    # near duplicates: all pairs
    comp = brute_components(sorted(text_of("near_duplicates").items()))
    assert [r for r in rows["toxicity"] if comp[r["doc_id"]][1] == r["doc_id"]] == rows["near_duplicates"]
    # mixing: targets by resharing, draws by the hash
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows["near_duplicates"]}
    sums = Counter()
    for r in rows["near_duplicates"]:
        sums[r["source"]] += size[r["doc_id"]]
    target, want = water_fill(sums), []
    for r in rows["near_duplicates"]:
        rate = min(3.0, target[r["source"]] / sums[r["source"]])
        draw = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        want += [r] * (int(rate) + (draw < rate - int(rate)))
    assert want == rows["mixing"]
    # packing: every copy's ids, and no sequence over its capacity
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, pieces, filled = text_of("packing"), Counter(), Counter()
    copies = Counter(r["doc_id"] for r in rows["mixing"])
    for r in rows["packing"]:
        pieces[r["doc_id"], r["piece"], r["length"], r["ids_crc32"]] += 1
        filled[r["sequence_id"]] += r["length"]
    want = Counter()
    for i, n in copies.items():
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += n
    assert pieces == want and max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(filled.values()) // 2048) * 1.01 + 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
