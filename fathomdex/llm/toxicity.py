"""Toxicity by compression distance.

A text is cut at white space into windows. Each is compressed twice with zstandard, with a
dictionary trained on ordinary text and with that and one trained on toxic text before it,
and the lengths compared; a window counts where the toxic dictionary saves at least `cut`
bytes. How many windows a document should have that count by chance is known from ordinary
rows, and a logistic curve over the excess gives its score.

Both dictionaries are trained by zstandard, apart from each other: the ordinary one on the
words of ordinary rows, the toxic one on the telling words of toxic rows, those with a form
(a beginning, or the whole word) that many distinct toxic documents use in distinct
contexts and ordinary ones hardly. Contexts of documents count, not occurrences, so that
copies and long documents add little. (Trained on whole toxic rows, which are ordinary text
but for a few words, a dictionary tells hardly anything: see the README.) The ordinary
dictionary stands behind the toxic one so that the ordinary words of a window take as many
bytes in both. Cut and curve are fitted on rows of another fold.

Fitting uses samples of the labelled rows of bounded size, documented below, chosen by
hash: text segments for the dictionaries, and documents of a separate fold for the rest.
Scoring covers whole texts. Labels, lang, source and doc_id are no inputs of a score, and
rows held out (crc32 of the id as text, mod 5, is 0) take no part in fitting.

Defined cases: a null or empty text has no window and gets the curve's value for none;
equal texts have equal scores; a very long text is scored window by window; without both
classes among the labels, or without telling words, all scores are 0; samples that are too
few to train from are dictionary content as they are; repeated labels of one id count as
the largest; an empty table gives no rows; columns of any name are carried by `score` and
`filter_toxic`.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import only_columns, staged, table

WINDOW = 40
SEGMENT = 512
LEVEL = 9
#: Bounds of the samples, per class: segments, and documents they are cut from, for the
#: dictionaries; documents of the other fold.
SEGMENTS_PER_CLASS = 6_000
DICTIONARY_DOCUMENTS = 4_000
DOCUMENTS_PER_CLASS = 2_000
#: Size of the ordinary dictionary; the toxic one grows with the telling forms.
ORDINARY_BYTES = 4_096
#: Bytes of a training sample at least, and of the pieces that zstandard picks.
LEAST_SAMPLE, SAMPLE_BYTES = 12, 16
#: The least evidence of a telling form: documents times the logarithm of the ratio, alone
#: and as a share of the strongest form's.
MIN_SCORE, MIN_SHARE = 20.0, 0.02
MIN_CONTEXTS, MIN_RATIO = 4, 4.0
#: No window saves more bytes than this.
MAX_CUT = 40

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    cut: int
    chance: float
    mean: tuple
    scale: tuple
    weights: tuple  # empty: no model


def windows(text: bytes, size: int) -> list[bytes]:
    """The whole text, lower-cased, in runs of words of about `size` bytes."""
    out, held, n = [], [], 0
    for w in text.lower().split():
        for k in range(0, len(w), size) if len(w) > size else (0,):
            held.append(w[k : k + size])
            n += len(held[-1]) + 1
            if n >= size:
                out.append(b" " + b" ".join(held) + b" ")
                held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def _forms(word: bytes):
    """Beginnings of a word, from 3 bytes on, and the whole word."""
    for n in range(3, min(len(word), 12)):
        yield b" " + word[:n]
    if len(word) > 2:
        yield b" " + word + b" "


def _contexts(segments: list[tuple[int, bytes]], only=None) -> tuple[dict[bytes, int], int]:
    """In how many documents each form occurs in a context (word before, the word) that no
    document before it has, and the number of documents; of forms in `only`, if given."""
    counts: dict[bytes, int] = defaultdict(int)
    every, own = set(), set()
    for doc, s in segments:
        words = _LETTERS.findall(s)
        for k, w in enumerate(words):
            at = (words[k - 1] if k else b"", w)
            if at in every:
                continue
            every.add(at)
            for f in _forms(w):
                if (only is None or f in only) and (doc, f) not in own:
                    own.add((doc, f))
                    counts[f] += 1
    return counts, len({doc for doc, _ in segments})


def telling(toxic: list[tuple[int, bytes]], ordinary: list[tuple[int, bytes]]) -> set[bytes]:
    """The forms that tell toxic segments, (document, text) each, from ordinary ones: of
    each family of words the longest that tells nearly as much as the best."""
    t, nt = _contexts(toxic)
    t = {k: a for k, a in t.items() if a >= MIN_CONTEXTS}
    o, no = _contexts(ordinary, t)
    score = {}
    for k, a in t.items():
        ratio = (a / nt) / ((o.get(k, 0) + 0.5) / no)
        if ratio >= MIN_RATIO:
            score[k] = a * float(np.log(ratio))
    least = max(MIN_SCORE, MIN_SHARE * max(score.values(), default=0))
    heads: dict[bytes, set[bytes]] = {}  # by beginnings, of words that are told already
    out = set()
    for k in sorted(score, key=lambda k: (-score[k], k)):
        word = k.strip()
        if score[k] < least or word in heads or any(word[:n] in heads and word[:n] in heads[word[:n]] for n in range(2, len(word))):
            continue
        family = [f for f in score if f.strip().startswith(word) and score[f] >= 0.8 * score[k]]
        out.add(max(family, key=lambda f: (len(f), score[f], f)))
        for n in range(2, len(word) + 1):
            heads.setdefault(word[:n], set()).add(word)
    return out


def trained(words: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of about `size` bytes, trained on words, each as often as it
    stands there and repeated to LEAST_SAMPLE bytes; of too few words, the words."""
    import zstandard

    samples = [w * -(-LEAST_SAMPLE // len(w)) for w in words]
    try:
        return zstandard.train_dictionary(size, samples, k=SAMPLE_BYTES, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: list[tuple[int, bytes]], ordinary: list[tuple[int, bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries, trained apart; the toxic one is empty where no word
    tells."""
    forms = telling(toxic, ordinary)
    stem = lambda w: next((f for f in _forms(w) if f in forms), None)
    stems = [f for f in (stem(w) for _, s in toxic for w in _LETTERS.findall(s)) if f]
    plain = [b" " + w + b" " for _, s in ordinary for w in _LETTERS.findall(s) if len(w) > 2 and not stem(w)]
    size = LEAST_SAMPLE * len(set(stems)) * 2 + 256
    return trained(plain, ORDINARY_BYTES) if plain else b"", trained(stems, size) if stems else b""


def _compressors(model: Model):
    """Of a window: compression with the ordinary dictionary, and with the toxic one and
    the ordinary one behind it, so that lengths differ by what toxic text alone has."""
    import zstandard

    out = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return out


def _savings(text: bytes, pair) -> np.ndarray:
    a, b = pair
    return np.array([len(a(w)) - len(b(w)) for w in windows(text, WINDOW)], np.int64)


def _histogram(text: bytes, pair) -> np.ndarray:
    """Windows by bytes saved, 0 to MAX_CUT (clipped), and their sum."""
    s = np.clip(_savings(text, pair), 0, MAX_CUT)
    return np.bincount(s, minlength=MAX_CUT + 1)


def _inputs(hist: np.ndarray, cut: int, chance: float) -> np.ndarray:
    """Of rows of histograms: the excess of counting windows in deviations, their share,
    and the mean saving."""
    n = hist.sum(1)
    hit = hist[:, cut:].sum(1)
    saved = (hist * np.arange(MAX_CUT + 1)).sum(1)
    m = np.maximum(n, 1)
    z = (hit - n * chance) / np.sqrt(n * chance * (1 - chance) + 0.5)
    return np.stack([np.sign(z) * np.log1p(np.abs(z)), z, np.minimum(hit / m, 0.2), np.minimum(saved / m, 1.0)], 1)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.1
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _order(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a toxic row scores above an ordinary one, ties as half."""
    s = np.sort(score[y == 0])
    t = score[y == 1]
    return float((np.searchsorted(s, t, "left") + np.searchsorted(s, t, "right")).mean() / 2 / max(1, len(s)))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    none = Model(b"", b"", 1, 0.0, (), (), ())
    lab = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.withColumn("h", F.xxhash64(F.concat(F.lit("fit"), F.col("doc_id").cast("string")))).withColumn("fold", F.when(F.pmod(F.col("h"), F.lit(5)) < 3, 0).otherwise(1))
    # ids of bounded number, chosen among the labels alone; their texts are read in one pass
    ids = None
    for c in (0, 1):
        for fold, most in ((0, DICTIONARY_DOCUMENTS), (1, DOCUMENTS_PER_CLASS)):
            part = lab.filter((F.col("toxic") == c) & (F.col("fold") == fold)).orderBy("h", "doc_id").limit(most)
            ids = part if ids is None else ids.unionByName(part)
    rows = staged(only_columns(docs, ("doc_id", "text")).join(F.broadcast(ids), "doc_id").filter("text is not null"), "toxic-sample")
    fold = F.col("fold") == 0

    def cut_up(batches):
        for b in batches:
            for text, toxic, h in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                got = windows(text.encode(), SEGMENT)
                for k in range(0, len(got), 5_000):
                    part = got[k : k + 5_000]
                    order = [zlib.crc32(b"%d:%d" % (h, k + i)) for i in range(len(part))]
                    yield pa.record_batch([pa.array([toxic] * len(part), pa.int32()), pa.array([h] * len(part), pa.int64()), pa.array(order, pa.int64()), pa.array(part, pa.binary())], names=["toxic", "doc", "h", "segment"])

    segments = rows.filter(fold).select("text", F.col("toxic").cast("int"), "h").mapInArrow(cut_up, "toxic int, doc long, h long, segment binary")
    sample = {c: [(r["doc"], bytes(r["segment"])) for r in segments.filter(F.col("toxic") == c).orderBy("h", "segment", "doc").limit(SEGMENTS_PER_CLASS).collect()] for c in (0, 1)}
    if not sample[0] or not sample[1]:
        return none
    common, toxic = dictionaries(sample[1], sample[0])
    if not toxic:
        return none
    model = Model(common, toxic, 1, 0.0, (), (), ())

    def count(batches):
        pair = _compressors(model)
        for b in batches:
            got = [_histogram(t.encode(), pair).tolist() for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), pa.array(got, pa.list_(pa.int64()))], names=["toxic", "hist"])

    seen = [[], []]
    for c in (0, 1):
        part = rows.filter(~fold & (F.col("toxic") == c)).orderBy("h").limit(DOCUMENTS_PER_CLASS).select("text", F.col("toxic").cast("int")).repartition(8)
        for r in part.mapInArrow(count, "toxic int, hist array<long>").collect():
            seen[c].append(r["hist"])
    if not seen[0] or not seen[1]:
        return none
    hist = np.array(seen[0] + seen[1], np.int64)
    y = np.r_[np.zeros(len(seen[0])), np.ones(len(seen[1]))]
    best = None
    for cut in range(1, MAX_CUT + 1):
        plain = hist[y == 0]
        chance = float((plain[:, cut:].sum() + 0.5) / (plain.sum() + 1))
        got = _order(_inputs(hist, cut, chance)[:, 0], y)
        if best is None or got > best[0] + 1e-9:
            best = (got, cut, chance)
    _, cut, chance = best
    x = _inputs(hist, cut, chance)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _curve((x - mean) / scale, y)
    # the sample is drawn by class: shift the curve to the shares among all labelled rows
    share = lab.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    share = min(max(share, 1e-6), 1 - 1e-6)
    w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return replace(model, cut=cut, chance=chance, mean=tuple(mean), scale=tuple(scale), weights=tuple(w))


def _scores(texts: list[bytes | None], model: Model, pair) -> np.ndarray:
    if not model.weights:
        return np.zeros(len(texts))
    hist = np.array([_histogram(t or b"", pair) for t in texts], np.int64).reshape(-1, MAX_CUT + 1)
    x = (_inputs(hist, model.cut, model.chance) - np.array(model.mean)) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ np.array(model.weights), -30, 30)))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, toxicity): docs' rows whole, so that no column's name can clash."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        pair = _compressors(m)
        for b in batches:
            got = _scores(b.column(1).cast(pa.binary()).to_pylist(), m, pair)
            yield pa.record_batch([b.column(0), pa.array(got)], names=["row", "toxicity"])

    schema = StructType([StructField("row", held.schema["row"].dataType), StructField("toxicity", DoubleType())])
    return held.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs' columns and, last, the score, a double from 0 to 1, as column `name`."""
    return _scored(docs, model).select("row.*", F.col("toxicity").alias(name))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs' rows that score below the threshold, with docs' columns."""
    return _scored(docs, fit(docs, labels)).filter(F.col("toxicity") < threshold).select("row.*")


def op1_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
