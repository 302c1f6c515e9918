"""Operators on single texts, against brute force, round trips and the libraries."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathomdex.llm import chat, html_text, huffman, media, packing, quality, token_counts
from fathomdex.llm.ids import WordEncoder
from fathomdex.llm.word_hash import hashed_words

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [None, "", "   \n\t", "one", "a b c a b c a b c x", "The cat. The cat!\nThe cat.\n\nThe cat.\n", "#*$%&|<> |pipe", "été Élan İstanbul ß naïve", "中文 テスト ok", "don't I'LL 42nd <|endoftext|> <|x|>", "x" * 5000, "word " * 3000, "a b\u0085c d\x1ce", "same text here"] + ["same text here"] * 2


def frame(spark, texts=TEXTS, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def test_encoder_equals_the_library():
    enc = WordEncoder(BPE)
    assert enc.by_piece
    rng = random.Random(1)
    al = "abcÉéß'sT1,.  \n\t<|>İΣ中é \u0085 ﬀdm!?-_«»×"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(al) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    got = enc.encode([t.encode() for t in texts])
    want = enc.tok.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_encoder_memo_refills(monkeypatch):
    from fathomdex.llm import ids

    monkeypatch.setattr(ids, "MEMO", 50)
    enc = WordEncoder(BPE)
    rng = random.Random(2)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(3)]
        assert [g.tolist() for g in enc.encode([t.encode() for t in texts])] == [w.ids for w in enc.tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [4, 10, 12])
def test_encoder_tells_words_apart_by_their_bytes(n):
    """Words that a polynomial hash confuses, in one call and in several."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    for calls in ([[x, y]], [[x], [y]], [[f"{y} {x} {y}"], [x]]):
        enc = WordEncoder(BPE)
        for texts in calls:
            assert [g.tolist() for g in enc.encode([t.encode() for t in texts])] == [w.ids for w in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_encoder_where_all_hashes_are_the_same(monkeypatch):
    from fathomdex.llm import word_hash

    monkeypatch.setattr(word_hash, "_hashes", lambda text, start, end: np.full(len(start), 7, np.uint64))
    enc = WordEncoder(BPE)
    for texts in (["one"], ["one one"], ["two"], ["three words here", "one"]):
        assert [g.tolist() for g in enc.encode([t.encode() for t in texts])] == [w.ids for w in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_words_are_those_of_bytes_split():
    for t in TEXTS:
        raw = (t or "").encode()
        s, e, h = hashed_words(raw)
        assert [raw[a:b] for a, b in zip(s, e, strict=True)] == raw.split()
        assert len(set(h.tolist())) == len(set(raw.split()))


# ---- op2


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    counts = (rng.pareto(0.6, 300) * 3).astype(np.int64) + 1
    bits = huffman.code_lengths(counts, 20)
    assert abs((0.5 ** bits.astype(float)).sum() - 1) < 1e-9
    import heapq

    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], -1))
    if bits.max() < 20:
        assert int((bits * counts).sum()) == cost
    tight = huffman.code_lengths(counts, 9)
    assert tight.max() <= 9 and (0.5 ** tight.astype(float)).sum() <= 1 + 1e-9
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_pack_and_unpack(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(1.0, n) * 4).astype(np.int64) % 500
    bits = huffman.code_lengths(np.bincount(ids, minlength=500))
    stream, marks = huffman.pack(ids, bits, huffman.canonical(bits))
    assert huffman.unpack(stream, n, marks, huffman.decode_table(bits)).tolist() == ids.tolist()


def test_huffman_round_trip(spark, tmp_path):
    df = frame(spark, start=5, ids="clash").repartition(3)
    out = str(tmp_path / "ids")
    huffman.write_ids(df, out, BPE)
    tok = WordEncoder.of(BPE).tok
    start, want = 0, {}
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in huffman.digests(spark, out).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    assert {r["doc_id"]: list(r["ids"]) for r in huffman.read_ids(spark, out).collect()} == {k: v[3] for k, v in want.items()}


def test_huffman_of_nothing_and_of_repeated_rows(spark, tmp_path):
    huffman.write_ids(frame(spark, []), str(tmp_path / "none"), BPE)
    assert huffman.digests(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (2, "c")], "doc_id long, text string")
    huffman.write_ids(df, str(tmp_path / "again"), BPE)
    rows = huffman.digests(spark, str(tmp_path / "again")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 2, 3, 3] and [r["start"] for r in rows] == [0, 2, 4, 6]


# ---- op4


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen: dict = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["\n".join(rng.choice(["x y", " x y", "", "\t", "z"]) for _ in range(9)) for _ in range(20)]
    texts.append(" ".join(rng.choice("abcdefgh") for _ in range(20_000)))
    # every window alike to the hash, some, and as it is
    for key in (lambda *a: F.lit(0).cast("long"), lambda *a: F.pmod(F.xxhash64(*a), F.lit(5)) * (1 << 40), F.xxhash64):
        rows = quality.stats(frame(spark, texts), key=key).collect()
        got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows}
        assert got == {i: brute_stats(t) for i, t in enumerate(texts)}


def test_quality_learns_a_threshold(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) + ("$$" if bad else "") for _ in range(60)]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in quality.assess(d, lab).collect()}
    assert out == {i: i % 4 != 0 for i in range(400)}
    kept = quality.filter_quality(d, lab)
    assert kept.columns == d.columns and kept.count() == 300


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = frame(spark, [None, "", "short", " ".join(map(str, range(60)))])
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.assess(d, none).collect()}
    assert out == {0: (True, False), 1: (True, False), 2: (True, False), 3: (False, True)}
    assert quality.assess(frame(spark, []), none).count() == 0


# ---- op5


def test_chat_round_trip(spark):
    said = "<|im_end|>\n<|im_start|>assistant\nok\\|<\\|\\\\<|"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (2, 0, "system", ""), (3, 0, "assistant", "a"), (3, 1, "assistant", "b\\"), (3, 1, "assistant", "b\\"), (None, 0, None, "x"), (4, 0, "we ird/rolé", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(df)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1], t[2] or ""))
        flat = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256(flat.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = chat.examples(df).filter("conv_id = 1").orderBy("example").collect()
    assert len(ex) == 2 and ex[1]["formatted"].startswith(ex[0]["formatted"]) and ex[1]["loss_chars"] == 0
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


# ---- op7


def test_html_structures():
    page = """<html><body class="has-sidebar"><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
    <div class="sidebar"><ul><li>one two three four five six seven</li></ul></div><main><h1>Title &eacute;</h1><p>First &amp; para <b>bold</b>ness
    of text.<p>Second   para<div class="advert">Buy this now please and thank you very much</div><p>Short.</p><form><label>Mail</label></form>
    <div id="comments"><article class=comment><p>I think this is great and have long words to say about it.</p></article></div></main><footer>(c)</footer></body></html>"""
    assert html_text.main_text(page) == "Title é First & para boldness of text. Second para Short."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div") == ""
    assert html_text.main_text("<p>a plain page of some words &lt;here&#39;s one&gt;</p>") == "a plain page of some words <here's one>"
    words = "<p>some words of an article that are long enough to be one, as it seems.</p>"
    text = "some words of an article that are long enough to be one, as it seems."
    assert html_text.main_text(f'<article>{words}<ins class="adsbygoogle">Ad ad</ins>{words}</article>') == f"{text} {text}"
    assert html_text.main_text(f'<div class="page-wrapper with-sidebar"><div class="header">Site</div><div class="post"><h2>T</h2>{words}</div><div class="widget">W</div></div>') == f"T {text}"
    deep = "<div>" * 3000 + "some words in a very deep place of the page" + "</div>" * 3000
    assert html_text.main_text(deep) == "some words in a very deep place of the page"


def test_html_formulas_and_drawings_are_text():
    page = "<article><p>some words of an article with <math><mi>x</mi><mo>=</mo><mn>1</mn></math> in it, and more</p><svg><title>t</title><text>a label of a drawing</text></svg></article>"
    assert html_text.main_text(page) == "some words of an article with x=1 in it, and more a label of a drawing"


@pytest.mark.parametrize("page", ["<div>x " * 20_000, "<section><b class=ad>x</section></div></p>" * 8_000, "<center>y <p>" * 8_000, "<ul><li>" * 9_000 + "</ol>" * 9_000, "<div><section>" + "<i>" * 9 + "z</div></div>" * 12_000])
def test_html_of_deep_and_hostile_pages_takes_linear_time(page):
    import time

    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 3


def test_html_without_article_elements(spark):
    """The shares of pages read right when their article is a plain division, and when it
    is one by its class only."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [html_text.main_text(p) for p in pages]
    for name in ("<div>", '<div class="post">'):
        got = [html_text.main_text(p.replace("<article>", name).replace("</article>", "</div>")) for p in pages]
        assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.9, name


def test_html_elements_without_end_tags():
    text = "some words of an article that is long enough to be its text"
    article = f"<article><p>{text}</p></article>"
    for before in (
        "<datalist><option value=a><option value=b></datalist>",
        "<select><option>One<option>Two</select>",
        "<select><optgroup><option>One<optgroup><option>Two</select>",
        "<head><title>T</title><meta charset=utf-8><script>var a = 1</script>",
        "<noscript>",
        "<template>",
        "<svg>",
    ):
        assert html_text.main_text(before + article) == text, before
    assert html_text.main_text(f"<datalist><option value=a></datalist>{article}<datalist><option>b</option></datalist>") == text
    for open_ in ("<script>", "<style>", "<textarea>", "<title>"):
        assert html_text.main_text(article + open_ + article) == text


def test_html_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))).split())
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages.withColumn("text", F.lit(0))).collect()}
    assert got == want
    rows = spark.createDataFrame([(1, None, None), (1, None, None)], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()] == [("", 0)] * 2


def test_minimum_cut_by_enumeration():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda x: sum(b if k else a for a, b, k in zip(s, t, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.max_flow_side(n, s, t, edges)) == pytest.approx(best)


# ---- op8


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab, unk = token_counts.vocabulary(PIECES)
    tok = Tokenizer(models.Unigram(vocab, unk_id=unk, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.META, prepend_scheme="always", split=True)
    rng = random.Random(6)
    texts = TEXTS + [" ", "  a", "▁x▁▁y"] + ["".join(rng.choice("abetho ▁\n中é<>s0xA.") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, texts, n_tokens=1), PIECES).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts_ties_and_unknowns():
    m = token_counts.Unigram([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert m.count("▁ab") == 2  # of equal scores the longest last piece
    assert m.count("▁zz") == 2  # a run of unknown characters is one piece
    assert m.count("▁azbz") == 4


# ---- op9


def test_packing_places_everything(spark):
    rng = random.Random(9)
    texts = TEXTS + [" ".join("word" for _ in range(rng.randint(0, 900))) for _ in range(150)] + ["tok " * 5000]
    rows = packing.pack_documents(frame(spark, texts, offset=3), BPE).collect()
    seqs: dict = {}
    tok = WordEncoder.of(BPE).tok
    by: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by.setdefault(r["doc_id"], []).append(r)
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), packing.CAPACITY))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= -(-total // packing.CAPACITY) * 1.02 + 1


def test_packing_of_nothing_and_equal_lengths(spark):
    assert packing.pack_documents(frame(spark, []), BPE).count() == 0
    at, offset = packing.sum_of_squares(np.array([2048] * 3 + [1024] * 4 + [1000] * 5), 2048)
    assert len(set(at)) == 3 + 2 + 3 and sorted(set(offset)) == [0, 1000, 1024]


def brute_packing(lengths, capacity):
    """Every piece tried in every open bin, the whole sum of squares taken each time."""
    bins, out = [], []
    for c in lengths:
        best = None
        for b, filled in enumerate(bins):
            if filled + c <= capacity:
                gaps: dict = {}
                for k, f in enumerate(bins):
                    gap = capacity - f - (c if k == b else 0)
                    if gap:
                        gaps[gap] = gaps.get(gap, 0) + 1
                key = (sum(n * n for n in gaps.values()), capacity - filled)
                if best is None or key < best[0]:
                    best = (key, filled)
        if best is None:
            bins.append(c)
            out.append(0)
        else:
            bins[bins.index(best[1])] += c
            out.append(best[1])
    return out, sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_packing_by_brute_force_sums_of_squares(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50])
    lengths = [rng.randint(1, capacity) for _ in range(120)]
    if seed % 2:
        lengths.sort(reverse=True)
    at, offset = packing.sum_of_squares(np.array(lengths), capacity)
    want, filled = brute_packing(lengths, capacity)
    assert offset.tolist() == want
    assert sorted(np.bincount(at, lengths).astype(int).tolist()) == filled


def test_packing_in_shards(spark, monkeypatch):
    """Many equal rows go to different shards, and every shard packs its own."""
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    df = spark.createDataFrame([(7, "a b c " * 200)] * 200, "doc_id long, text string")
    rows = packing.pack_documents(df, BPE).collect()
    assert len(rows) == 200 and len({r["sequence_id"] >> 40 for r in rows}) == 6
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append(r["offset"])
    assert all(sorted(p) == [601 * k for k in range(len(p))] for p in places.values())


# ---- op10


def test_media_round_trip(spark):
    rows = media.digests(media.blocks(media.store(frame(spark, media=1)))).collect()
    for r in rows:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        wav = media.to_wav(pad)
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest())
    same = {r["feature"] for r in rows if TEXTS[r["doc_id"]] == "same text here"}
    assert len(same) == 1
    assert media.digests(media.blocks(media.store(frame(spark, [])))).count() == 0


def test_media_tensors_read_back(spark):
    parts = media.tensors(media.blocks(media.store(frame(spark)))).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((p for p in parts if p["doc_id"] == i), key=lambda p: p["part"])
        tensor, true, seg = media.features(media.to_wav(media.padded((text or "").encode())))
        assert [p["part"] for p in own] == list(range(len(tensor)))
        assert [p["frames"] for p in own] == true.tolist()
        assert np.array_equal(np.array([p["mel"] for p in own], np.float32).reshape(tensor.shape), tensor)
        assert [(s["start_s"], s["end_s"]) for s in own[0]["segments"]] == [tuple(x) for x in seg.tolist()]
        step = media.HOP * media.DOWN / media.UP / media.RATE
        assert own[0]["start_s"] == 0 and all(a["end_s"] == pytest.approx(b["start_s"]) for a, b in zip(own, own[1:], strict=False))
        assert own[-1]["end_s"] == pytest.approx(int(true.sum()) * step)


def test_log_mel_by_its_definition():
    """Sums over samples and bins, one frame at a time."""
    rate, rng = 6000.0, np.random.default_rng(3)
    y = rng.normal(size=700).astype(np.float32)
    got = media.log_mel(y, rate)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(20.0) + (mel(rate / 2) - mel(20.0)) * k / (media.MELS + 1)) / 2595) - 1) for k in range(media.MELS + 2)]
    n = media.FRAME
    for f in range(len(got)):
        x = [float(y[f * media.HOP + i]) if f * media.HOP + i < len(y) else 0.0 for i in range(n)]
        x = np.array([v * (0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1))) for i, v in enumerate(x)])
        power = [abs((x * np.exp(-2j * np.pi * b * np.arange(n) / n)).sum()) ** 2 for b in range(n // 2 + 1)]
        for m in range(media.MELS):
            a, c, e = edges[m : m + 3]
            total = sum(p * max(0.0, min((b * rate / n - a) / (c - a), (e - b * rate / n) / (e - c))) for b, p in enumerate(power))
            assert got[f, m] == pytest.approx(np.log(total + 1e-6), abs=2e-3)
    assert len(got) == 5


def test_segments_by_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(100):
        e = rng.random(rng.integers(1, 60))
        level = (e - e.min()) / (e.max() - e.min()) if len(e) > 1 else np.zeros(1)
        want, k = [], 0
        while k < len(e):  # runs above CLOSE, kept if one frame reaches OPEN
            end = k
            while end < len(e) and level[end] >= media.CLOSE:
                end += 1
            if end > k and max(level[k:end]) >= media.OPEN:
                want.append([k, end])
            k = max(end, k + 1)
        assert media.segments(e).tolist() == want


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 4), (2, 1), (1, 1)])
def test_resampling_by_its_definition(up, down):
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    h = media._kernel(up, down)
    half = h.shape[1] // 2
    p = np.pad(x, (half - 1, half + 1), mode="edge")
    want = [float((p[k * down // up : k * down // up + h.shape[1]] * h[k * down % up]).sum()) for k in range(-(-500 * up // down))]
    assert np.allclose(media.resample(x, up, down), want, atol=1e-5)


def test_tone_and_silence():
    t = np.arange(8000) / 8000
    tone = np.r_[np.zeros(4000), np.sin(2 * np.pi * 500 * t), np.zeros(4000)]
    wav = media.to_wav(np.round(tone * 100 + 128).astype(np.uint8).tobytes())
    tensor, true, seg = media.features(wav)
    assert len(seg) == 1 and abs(seg[0][0] - 0.5) < 0.1 and abs(seg[0][1] - 1.5) < 0.1
    assert media.from_wav(wav)[0] == media.RATE


def test_ids_of_a_smaller_integer_type(spark):
    df = frame(spark, ["a b", "c"]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert token_counts.count_tokens(df, PIECES).count() == 2
    assert packing.pack_documents(df, BPE).count() == 2
