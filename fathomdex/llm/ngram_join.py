"""N-gram Jaccard self-join: which documents share at least 75 % of their word shingles.

Shingles are ordered rare first by a count sketch of fixed width over all documents (ties
and sketch noise by the shingle's hash, so the order is one for all). Two sets that reach
the threshold share a shingle among the first n - ceil(t n) + 1 of each. Those prefixes
are joined on the shingle; pairs pass a length filter and a positional filter where they
meet, then two suffix filters: parity bitmaps of both sets, which are met without the
texts, and the sizes of the parts into which common pivots cut both sets, each of which
bounds the sets' difference. What is left is verified once a pair against the whole sets.

Equal sets are one class and joined as one; copies are never paired. Prefixes travel as
packed blocks of numbers, dealt out by the shingle's hash; those of very common shingles
by class too, so that no task gets all of one. Of a list of more than LIST_MAX classes
that share a prefix shingle, the pairs that pass all filters are found inside one task
per pair of blocks of members, and only a spanning forest of them, over components known
so far, goes on to be verified; in a second round all that are left between different
components follow. So groups of near copies cost about their size, and components stay
exact. Links are counted inside the components, as every link is: each pair of a
component's classes is counted in one task, components of few classes many to a task,
others by pairs of blocks of classes.

Sets are of 64-bit hashes of shingles, made of BLAKE2b hashes of the words. Where pairs
are verified and counted, shingles of one hash are the same only if their words are.

Defined cases: a null or blank text has no shingles and links with nothing; a text of
fewer words than a shingle is one shingle; a very long text is one row like any other (its
words must fit in a task's memory). Rows that repeat an id are one document: its rows are
told apart by their texts, each links on its own, and all of them are in one component;
links are counted by rows. A null id is a document of its own for each text; components of
null ids alone have a null component_id. An empty table gives no rows; extra columns are
ignored by join_documents and carried by keep_one, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .ids import text_chunks
from .word_hash import distinct, hashed_words, strong
from .word_hash import mix as _mix

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 20
#: Prefix shingles in a bucket, about, and held by a task before it writes them out.
BUCKET_ROWS = 500_000
HELD_ROWS = 1_000_000
#: Classes in a list that are all paired at once; members of a block of a longer one.
LIST_MAX = 8
BLOCK = 1024
#: Shingles that so many documents have (a power of two) are dealt out by class as well.
HOT_LOG = 15
#: Classes of a block, and their shingles, about, where links are counted; shingles that
#: so many of them have are counted by products of matrices, of so many columns at a time.
COUNT_BLOCK = 2048
BLOCK_SHINGLES = 1_000_000
DENSE, DENSE_COLUMNS = 24, 2048
#: Documents of one group of verification and their shingles, about, and rows of a small
#: table that may be broadcast.
GROUP_DOCS = 256
GROUP_SHINGLES = 1_000_000
BROADCAST_ROUTES = 500_000
#: Parts that the pivots of the suffix filter cut a set into.
PARTS = 8
#: Bits of a parity bitmap: the power of two from BITS_EACH a shingle on, within bounds.
BITS_EACH, BITS_LEAST, BITS_MOST = 2, 64, 1 << 13

_U64 = np.uint64


def _word_hashes(texts: list[bytes | None], vocab: dict | None = None):
    """(edges, hashes, numbers): of the words of all texts in a row, A-Z lower-cased,
    their strong hashes and, with vocab, the words' numbers in it; edges are the texts'
    bounds in the row."""
    low = [(t or b"").lower() for t in texts]
    buf = b" ".join(low)
    start, end, fast = hashed_words(buf)
    edges = np.r_[0, np.searchsorted(start, np.cumsum([len(t) + 1 for t in low]))]
    if not len(start):
        return edges, np.zeros(0, _U64), np.zeros(0, np.int32)
    first, which, _ = distinct(buf, start, end, fast)
    words = [buf[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    known = None if vocab is None else np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int32)[which]
    return edges, strong(words)[which], known


def _windows(edges: np.ndarray, h: np.ndarray, k: int):
    """For each text its windows' hashes, in order: k words each, all if they are fewer."""
    n = len(h)
    whole = np.full(max(0, n - k + 1), k, _U64)
    for i in range(k):
        whole = _mix(whole * _U64(0x2545F4914F6CDD1D) + h[i : n - k + 1 + i]) if n >= k else whole
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= k:
            yield whole[a : b - k + 1]
            continue
        one = np.full(min(1, b - a), b - a, _U64)
        for i in range(a, b):
            one = _mix(one * _U64(0x2545F4914F6CDD1D) + h[i : i + 1])
        yield one


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    edges, h, _ = _word_hashes(texts)
    return [np.unique(x) for x in _windows(edges, h, k)]


def exact_sets(texts: list[bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers that are the same in two texts
    only if the shingles' words are."""
    vocab: dict[bytes, int] = {}
    hashes, numbers, at = [], [], 0
    while at < len(texts):  # in parts of a bounded size
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or b"") <= 2 << 20):
            size += len(texts[upto] or b"")
            upto += 1
        edges, h, w = _word_hashes(texts[at:upto], vocab)
        hashes += list(_windows(edges, h, k))
        # a text's words, and k places of no word behind them
        numbers += [np.r_[x, np.full(k, -1, np.int32)] for x in np.split(w, edges[1:-1])]
        at = upto
    sizes = np.array([len(x) for x in hashes])
    lens = np.array([len(x) for x in numbers])
    every = np.concatenate(hashes) if hashes else np.zeros(0, _U64)
    words = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    place = np.arange(len(every)) + np.repeat((np.cumsum(lens) - lens) - (np.cumsum(sizes) - sizes), sizes)
    order = np.argsort(every)
    a, b = order[:-1], order[1:]
    equal = every[a] == every[b]
    a, b = place[a[equal]], place[b[equal]]
    if any((words[a + i] != words[b + i]).any() for i in range(k)):
        seen: dict[tuple, int] = {}
        every = np.array([seen.setdefault(tuple(words[p : p + k].tolist()), len(seen)) for p in place.tolist()], _U64)
        hashes = np.split(every, np.cumsum(sizes)[:-1])
    return [np.unique(x) for x in hashes]


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Suffix filter: pivots of one sorted set cut both into parts; sets differ in at
    least as many members as the parts' sizes do in all."""
    if len(a) < 2 * PARTS or len(b) < 2 * PARTS:
        return True
    pivots = a[np.arange(1, PARTS) * len(a) // PARTS]
    x = np.diff(np.arange(PARTS + 1) * len(a) // PARTS)
    y = np.diff(np.r_[0, np.searchsorted(b, pivots), len(b)])
    return bool(len(a) + len(b) - np.abs(x - y).sum() >= 2 * needed(len(a), len(b), percent))


def prefix_size(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def needed(a, b, percent: int = PERCENT):
    """The least intersection of sets of a and b members that links them."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=12).digest()


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap of the parities of the numbers of members by hash. Two sets differ in at
    least as many members as their bitmaps in bits; halves xor-ed make the next smaller."""
    m = min(BITS_MOST, max(BITS_LEAST, 1 << max(0, BITS_EACH * len(s) - 1).bit_length()))
    odd = np.bincount((s >> _U64(20)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _differ(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    n = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, n) ^ _folded(y, n)).sum())


ROWS = "key long, doc_id long, n int, sig binary, bits binary, chunk int, sketch binary"


def keyed(docs: DataFrame, row=None) -> tuple[DataFrame, bool]:
    """(key, doc_id, text) rows, and `row` if that column is given: the id where only one
    row has it, else a negative number of the row's id and text; and whether there are
    any of those."""
    row = [] if row is None else [row.alias("row")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *row)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = staged(ids.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "join-repeated")
    few = again.limit(BROADCAST_ROUTES + 1).count()
    row = ["row"] if row else []
    if not few:
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text", *row), False
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    own = -1 - F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")
    again = F.broadcast(again) if few <= BROADCAST_ROUTES else again
    out = docs.join(again, F.col("doc_id") == F.col("_id"), "left")
    key = F.when(F.col("doc_id").isNull() | F.col("_id").isNotNull(), own).otherwise(F.col("doc_id"))
    return out.select(key.alias("key"), "doc_id", "text", *row), True


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """Per row its set's size, signature and parity bitmap; and, with chunk set, each
    task's part of the sketch."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        seen = False
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        names = ["key", "doc_id", "n", "sig", "bits", "chunk", "sketch"]
        for rows, texts in text_chunks(batches, 2):
            every = shingle_sets(texts, k)
            out = [[len(s) for s in every], [_signature(s) for s in every], [parity_bits(s) for s in every]]
            counts += np.bincount((np.concatenate(every) & _U64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
            seen = True
            none = [None] * len(texts)
            yield pa.record_batch([rows.column(0), rows.column(1), *[pa.array(c, t) for c, t in zip([*out, none, none], kinds[2:], strict=True)]], names=names)
        if seen:
            for c in range(16):
                part = np.split(counts, 16)[c].astype("<u4").tobytes()
                yield pa.record_batch([pa.array([v], t) for v, t in zip([None, None, None, None, None, c, zlib.compress(part, 1)], kinds, strict=True)], names=names)

    return docs.mapInArrow(run, ROWS)


def merged_sketch(rows: DataFrame) -> np.ndarray:
    """The whole sketch: 2^SKETCH_BITS counts, whatever the number of documents."""

    def add(batches):
        total = {}
        for b in batches:
            for c, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(z), "<u4").astype(np.int64)
                total[c] = total.get(c, 0) + x
        for c, x in total.items():
            yield pa.record_batch([pa.array([c], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["chunk", "sketch"])

    parts = rows.filter("chunk is not null").select("chunk", "sketch").repartition(16, "chunk").mapInArrow(add, "chunk int, sketch binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in parts:
        x = np.frombuffer(r["sketch"], "<u4")
        out[r["chunk"] * len(x) : (r["chunk"] + 1) * len(x)] = x
    return out


def prefixes(docs: DataFrame, rarity, buckets: int, k: int, percent: int) -> DataFrame:
    """(bucket, payload): the prefixes of all distinct sets, dealt out by hash."""

    def run(batches):
        classes = rarity.value
        held, meta, total, seen = [], [], 0, set()

        def flush():
            size = np.array([m[1] for m in meta], np.uint32)
            sig = np.frombuffer(b"".join(m[0] for m in meta), "V12")
            lens = np.array([len(x) for x in held])
            h = np.concatenate(held)
            doc = np.repeat(np.arange(len(held)), lens)
            pos = np.concatenate([np.arange(n) for n in lens])
            hot = classes[(h & _U64((1 << SKETCH_BITS) - 1)).astype(np.int64)] >= HOT_LOG
            spread = _mix(h ^ np.frombuffer(b"".join(m[0][:8] for m in meta), "<u8")[doc])
            b = (((np.where(hot, spread, h) >> _U64(32)) * _U64(buckets)) >> _U64(32)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cut = np.flatnonzero(np.diff(b[order], prepend=-1))
            out = [[], []]
            for lo, hi in zip(cut, np.r_[cut[1:], len(order)], strict=True):
                at = order[lo:hi]
                docs_, ref = np.unique(doc[at], return_inverse=True)
                out[0].append(int(b[at[0]]))
                out[1].append(
                    np.array([len(docs_), len(at)], "<u4").tobytes()
                    + sig[docs_].tobytes()
                    + size[docs_].astype("<u4").tobytes()
                    + h[at].astype("<u8").tobytes()
                    + ref.astype("<u2").tobytes()
                    + np.minimum(pos[at], 65535).astype("<u2").tobytes()
                    + hot[at].astype(np.uint8).tobytes()
                )
            return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "payload"])

        for _, texts in text_chunks(batches, 0):
            for s in shingle_sets(texts, k):
                if not len(s):
                    continue
                sig = _signature(s)
                if sig in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sig)
                p = prefix_size(len(s), percent)
                rank = classes[(s & _U64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                held.append(s[np.argsort(rank, kind="stable")[:p]])  # s is sorted: ties by hash
                meta.append((sig, len(s)))
                total += p
                if total >= HELD_ROWS or len(held) >= 60_000:
                    yield flush()
                    held, meta, total = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, payload binary")


def _parsed(payloads: list[bytes]):
    """(signatures as two columns, sizes, hashes, document numbers, positions, which
    shingles are dealt out by class)."""
    sig, size, h, ref, pos, hot, n = [], [], [], [], [], [], 0
    for p in payloads:
        d, q = np.frombuffer(p, "<u4", 2).tolist()
        at = 8
        sig.append(np.frombuffer(p, np.dtype([("a", ">u8"), ("b", ">u4")]), d, at))
        at += 12 * d
        size.append(np.frombuffer(p, "<u4", d, at))
        at += 4 * d
        h.append(np.frombuffer(p, "<u8", q, at))
        at += 8 * q
        ref.append(np.frombuffer(p, "<u2", q, at).astype(np.int64) + n)
        at += 2 * q
        pos.append(np.frombuffer(p, "<u2", q, at))
        hot.append(np.frombuffer(p, np.uint8, q, at + 2 * q))
        n += d
    sig = np.concatenate(sig)
    return sig["a"].astype(_U64), sig["b"].astype(np.uint32), *map(np.concatenate, (size, h, ref, pos, hot))


def _passing(size_a, pos_a, size_b, pos_b, percent):
    """Length and positional filter."""
    a, b = size_a.astype(np.int64), size_b.astype(np.int64)
    ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    room = 1 + np.minimum(a - pos_a, b - pos_b) - 1
    return ok & (room >= needed(a, b, percent))


def _sig_bytes(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    out = np.zeros(len(a), np.dtype([("a", ">u8"), ("b", ">u4")]))
    out["a"], out["b"] = a, b
    raw = out.tobytes()
    return [raw[12 * i : 12 * i + 12] for i in range(len(a))]


#: A pair of classes, u < v, and the sizes of their sets.
PAIR = "u long, v long, nu int, nv int"
PAIRS = "a binary, b binary, list long, members binary"
_MEMBER = np.dtype([("a", ">u8"), ("b", ">u4"), ("size", "<u4"), ("pos", "<u4")])


def bucket_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of signatures, a < b; and a row with the members of each list
    that is too long to be paired whole, or a part of them."""

    def run(t: pa.Table) -> pa.Table:
        hi, lo, size, h, ref, pos, hot = _parsed(t.column("payload").to_pylist())
        # one number for each distinct signature, in their order
        order = np.lexsort((lo, hi))
        new = np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])]
        cls = np.empty(len(order), np.int64)
        cls[order] = np.cumsum(new) - 1
        first = order[new]
        # shingles that occur more than once
        by = np.argsort(h, kind="stable")
        g = h[by]
        same = np.r_[False, g[1:] == g[:-1]]
        by = by[same | np.r_[same[1:], False] | (hot[by] > 0)]
        c = cls[ref[by]]
        o = np.lexsort((c, h[by]))
        by, c = by[o], c[o]
        g = h[by]
        keep = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])][: len(by)]
        by, c, g = by[keep], c[keep], g[keep]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
        m = np.diff(np.r_[start, len(g)])
        long = (m > LIST_MAX) | (hot[by[start]] > 0)
        s, p = size[ref[by]].astype(np.int64), pos[by].astype(np.int64)
        found = []
        for k in np.unique(m[(m > 1) & ~long]):
            x, y = np.triu_indices(k, 1)
            lists = start[(m == k) & ~long]
            step = max(1, 2_000_000 // len(x))
            for q in range(0, len(lists), step):
                u = (lists[q : q + step, None] + x).ravel()
                v = (lists[q : q + step, None] + y).ravel()
                ok = _passing(s[u], p[u], s[v], p[v], percent)
                found.append(np.unique(c[u[ok]] * len(first) + c[v[ok]]))
        lists = []
        for at, k in zip(start[long].tolist(), m[long].tolist(), strict=True):
            row = np.zeros(k, _MEMBER)
            of = first[c[at : at + k]]
            row["a"], row["b"], row["size"], row["pos"] = hi[of], lo[of], s[at : at + k], p[at : at + k]
            lists.append((int(g[at].astype(np.int64)), row.tobytes()))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        a, b = first[pairs // max(1, len(first))], first[pairs % max(1, len(first))]
        none = [None] * len(lists)
        return pa.table(
            {
                "a": pa.array(_sig_bytes(hi[a], lo[a]) + none, pa.binary()),
                "b": pa.array(_sig_bytes(hi[b], lo[b]) + none, pa.binary()),
                "list": pa.array([None] * len(a) + [x for x, _ in lists], pa.int64()),
                "members": pa.array([None] * len(a) + [x for _, x in lists], pa.binary()),
            }
        )

    return buckets.groupBy("bucket").applyInArrow(run, PAIRS)


def _only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df's rows whose column is among ids (one column, distinct)."""
    return _with(df, ids.toDF("_id"), F.col(column) == F.col("_id"), "left_semi")


def _with(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """df joined to a table of one row a key. Up to a checked number of rows that table is
    broadcast, so that df is not shuffled and no key of it lands in one task; larger ones
    are joined by shuffle, where AQE splits what is skewed."""
    few = small.limit(BROADCAST_ROUTES + 1).count() <= BROADCAST_ROUTES
    return df.join(F.broadcast(small) if few else small, on, how)


def long_lists(found: DataFrame, classes: DataFrame):
    """(members, bitmaps): (list, node, size, pos) of the long lists, and (node, bits) of
    the classes that are in one. Lists with the same smallest member become one list of
    all their members (each at its least position), because groups of near copies share
    many lists, and a pair should be looked at in few of them."""

    def read(batches):
        for b in batches:
            for x, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = np.frombuffer(raw, _MEMBER)
                yield pa.record_batch([pa.array([x] * len(row), pa.int64()), pa.array(_sig_bytes(row["a"], row["b"]), pa.binary()), pa.array(row["size"].astype(np.int32)), pa.array(row["pos"].astype(np.int32))], names=["list", "sig", "size", "pos"])

    rows = staged(found.filter("list is not null").select("list", "members").mapInArrow(read, "list long, sig binary, size int, pos int"), "join-lists")
    known = staged(_only(classes.select("sig", "node", "bits"), "sig", rows.select("sig").distinct()), "join-list-classes")
    rows = staged(rows.join(known.select("sig", "node"), "sig").drop("sig"), "join-list-members")
    lead = staged(rows.groupBy("list").agg(F.min("node").alias("lead")), "join-list-leads")
    rows = _with(rows, lead, "list").groupBy("lead", "node").agg(F.min("pos").alias("pos"), F.first("size").alias("size"))
    return staged(rows.withColumnRenamed("lead", "list"), "join-list-groups"), known.select("node", "bits")


def rest_pairs(members: DataFrame, bitmaps: DataFrame, comp: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(u, v, nu, nv) of the members of long lists that are in different components so far and
    pass all filters; with forest, in each task only so many as connect the same.
    Lists whose members are all in one go first; the others' members are dealt into
    blocks, and each pair of blocks is a task of its own."""
    rows = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = staged(rows, "join-lists")
    mixed = rows.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("lo < hi").drop("lo", "hi")
    rows = _with(rows, staged(mixed, "join-list-blocks"), "list").withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "x", "node", "component", "size", "pos").join(bitmaps, "node")

    def run(t: pa.Table) -> pa.Table:
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        x, size, pos, node, of = (t.column(k).to_numpy() for k in ("x", "size", "pos", "node", "component"))
        raw = [np.frombuffer(b, "<u8") for b in t.column("bits").to_pylist()]
        words = np.array([len(b) for b in raw])
        level = {}
        for w in np.unique(words):
            level[w] = np.zeros((len(raw), w), np.uint64)
            for i in np.flatnonzero(words >= w):
                level[w][i] = _folded(raw[i], w)
        label = of.copy()
        left, right = np.flatnonzero(x == p), np.flatnonzero(x == q)
        none = np.zeros(0, np.int64)
        u, v, nu, nv = [none], [none], [none], [none]
        for i in left:
            r = right[right > i] if p == q else right
            r = r[label[r] != label[i]]
            r = r[_passing(np.full(len(r), size[i]), np.full(len(r), pos[i]), size[r], pos[r], percent)]
            w = np.minimum(words[i], words[r])
            apart = np.zeros(len(r), np.int64)
            for k in np.unique(w):
                at = np.flatnonzero(w == k)
                apart[at] = np.bitwise_count(level[k][i] ^ level[k][r[at]]).sum(1)
            both = size[i].astype(np.int64) + size[r]
            r = r[(both - apart) >= 2 * needed(size[i].astype(np.int64), size[r].astype(np.int64), percent)]
            if forest and len(r):
                near, first = np.unique(label[r], return_index=True)
                r = r[first]
                label[np.isin(label, near)] = label[i]
            first = node[i] < node[r]
            u.append(np.where(first, node[i], node[r]))
            v.append(np.where(first, node[r], node[i]))
            nu.append(np.where(first, size[i], size[r]))
            nv.append(np.where(first, size[r], size[i]))
        return pa.table({c: pa.array(np.concatenate(z).astype(t)) for c, z, t in (("u", u, "i8"), ("v", v, "i8"), ("nu", nu, "i4"), ("nv", nv, "i4"))})

    return rows.groupBy("list", "p", "q").applyInArrow(run, PAIR).distinct()


def _overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many members each of the first `left` sets shares with each of the others, or
    with each of all sets if there are no others. Members of many sets are counted by
    products of 0/1 matrices, the others pair by pair."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[both]] if left == 1 else [[len(sets[0]), both], [both, len(sets[1])]], np.int32)
    size = np.array([len(x) for x in sets])
    n, right = len(sets), len(sets) - left or left
    base = left if left < n else 0
    out = np.zeros((left, right), np.float32)
    flat, holder = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    m = np.diff(np.r_[start, len(flat)])
    many = np.flatnonzero(m >= DENSE)
    for at in range(0, len(many), DENSE_COLUMNS):
        part = many[at : at + DENSE_COLUMNS]
        cells = np.arange(m[part].sum()) + np.repeat(start[part] - (np.cumsum(m[part]) - m[part]), m[part])
        grid = np.zeros((n, len(part)), np.float32)
        grid[holder[cells], np.repeat(np.arange(len(part)), m[part])] = 1
        out += grid[:left] @ grid[base:].T
    counts = np.zeros(left * right, np.int32)
    for k in range(2, DENSE):
        lists = start[m == k]
        x, y = np.triu_indices(k, 1)
        step = max(1, 2_000_000 // len(x))
        for at in range(0, len(lists), step):
            u, v = (holder[(lists[at : at + step, None] + z).ravel()] for z in (x, y))
            ok = (u < left) & (v >= base)
            np.add.at(counts, u[ok] * right + v[ok] - base, 1)
            if not base:
                np.add.at(counts, v[ok] * right + u[ok], 1)
    return np.rint(out).astype(np.int32) + counts.reshape(left, right)


def counted(docs: DataFrame, comp: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, links): how many rows of other sets each class of a component of several
    links with. A component of up to a block of classes is counted in one task, with
    others beside it; of larger ones each pair of blocks is a task of its own."""
    comp = comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
    known = staged(classes.select("node", "n", "copies").join(comp, "node"), "count-classes")
    load = F.greatest(F.count("*") / COUNT_BLOCK, F.sum("n") / BLOCK_SHINGLES)
    sizes = staged(known.groupBy("component").agg(load.alias("load")).withColumn("blocks", F.ceil("load").cast("int")), "count-components")
    bins = int(sizes.filter("blocks = 1").agg(F.sum("load")).first()[0] or 0) + 1
    rows = _with(known, sizes.filter("blocks > 1").drop("load"), "component", "left")
    none = F.lit(-1)
    alone = rows.filter("blocks is null").select(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("group"), none.alias("p"), none.alias("q"), none.alias("x"), "component", "node", "copies")
    split = rows.filter("blocks is not null").withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    split = split.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(F.col("component").alias("group"), F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "x", "component", "node", "copies")
    rows = staged(alone.unionByName(split), "count-routes")
    few = rows.limit(BROADCAST_ROUTES + 1).count() <= BROADCAST_ROUTES
    texts = docs.select(F.col("key").alias("node"), "text").join(F.broadcast(rows) if few else rows, "node")

    def linked(sets, left, copies):
        """Of the first `left` sets against the others, or each other: the copies of the
        sets that each set links with."""
        base = left if left < len(sets) else 0
        total = np.zeros(len(sets), np.int64)
        if len(sets) < 2 or not left:
            return total
        size = np.array([len(x) for x in sets])
        both = _overlaps(sets, left)
        for at in range(0, left, 256):
            part = both[at : at + 256]
            ok = (part > 0) & (100 * part >= percent * (size[at : at + len(part), None] + size[None, base:] - part))
            if not base:
                ok[np.arange(len(ok)), at + np.arange(len(ok))] = False
            total[at : at + len(ok)] += ok @ copies[base:]
            if base:
                total[base:] += copies[at : at + len(ok)] @ ok
        return total

    def run(t: pa.Table) -> pa.Table:
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        _, first = np.unique(t.column("node").to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        # by component where there are several, the sets of one block before the other's
        side = t.column("component").to_numpy() if p < 0 else t.column("x").to_numpy() != p
        order = np.argsort(side, kind="stable")
        side, t = side[order], t.take(pa.array(order))
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        sets = exact_sets(t.column("text").cast(pa.binary()).to_pylist(), k)
        if p < 0:
            cuts = np.r_[0, np.flatnonzero(side[1:] != side[:-1]) + 1, len(side)].tolist()
            total = np.concatenate([linked(sets[a:b], b - a, copies[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        else:
            left = int((~side).sum())
            # with one side only there is no pair of both
            total = linked(sets, left, copies) if p == q or left < len(sets) else np.zeros(len(sets), np.int64)
        some = np.flatnonzero(total)
        return pa.table({"node": pa.array(node[some]), "links": pa.array(total[some])})

    return texts.groupBy("group", "p", "q").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), component the smallest node that
    they reach: alternating steps that hang larger, then smaller neighbours on the least
    one, until nothing changes. Minima are aggregated before they are joined back."""

    def step(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(least, "u")
        if larger:
            out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    e = staged(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    last = mark(e)
    while True:
        e = staged(step(step(e, True), False), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (u, v) of pairs of classes whose whole sets link. Pairs are dealt into groups
    around the smallest class near them, groups of many texts into pairs of slots, so
    that a text goes to few tasks and no task gets many."""
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("near"))
    p = pairs.join(near, "u").join(near.select(F.col("u").alias("v"), F.col("near").alias("near_v")), "v")
    p = staged(p.select("u", "v", "nu", "nv", F.least("near", "near_v").alias("group")), "pair-near")
    ends = p.select("group", "u", "nu").unionByName(p.select("group", F.col("v").alias("u"), F.col("nv").alias("nu"))).distinct()
    slots = ends.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / GROUP_DOCS, F.sum("nu") / GROUP_SHINGLES)).cast("int").alias("slots"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.col("slots")).cast("int")
    p = _with(p, staged(slots.filter("slots > 1"), "pair-slots"), "group", "left").withColumn("slots", F.coalesce("slots", F.lit(1))).withColumn("su", slot("u")).withColumn("sv", slot("v"))
    p = staged(p.select("u", "v", "group", F.least("su", "sv").alias("p"), F.greatest("su", "sv").alias("q")), "pair-groups")
    route = p.select(F.col("u").alias("key"), "group", "p", "q").unionByName(p.select(F.col("v").alias("key"), "group", "p", "q")).distinct()
    texts = _with(docs.select("key", "text"), staged(route, "pair-routes"), "key")
    key = ["group", "p", "q"]

    def run(text: pa.Table, pair: pa.Table) -> pa.Table:
        keys, first = np.unique(text.column("key").to_numpy(), return_index=True)
        sets = exact_sets(text.column("text").take(pa.array(first)).cast(pa.binary()).to_pylist(), k)
        u, v = pair.column("u").to_numpy(), pair.column("v").to_numpy()
        keep = np.zeros(len(u), bool)
        for i, (x, y) in enumerate(zip(np.searchsorted(keys, u).tolist(), np.searchsorted(keys, v).tolist(), strict=True)):
            a, b = sets[x], sets[y]
            if may_link(a, b, percent):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return pa.table({"u": pa.array(u[keep]), "v": pa.array(v[keep])})

    return texts.groupBy(*key).cogroup(p.groupBy(*key)).applyInArrow(run, "u long, v long")


def _bitmap_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose bitmaps allow enough members in common, with their sizes."""
    ids = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    known = staged(_only(classes.select("node", "n", "bits"), "node", ids), "join-pair-classes")
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    p = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "bits_u", "bits_v")

    def run(batches):
        for b in batches:
            a, c = (np.asarray(b.column(k)).astype(np.int64) for k in (2, 3))
            apart = np.fromiter((_differ(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)), np.int64, len(b))
            keep = pa.array(a + c - apart >= 2 * needed(a, c, percent))
            yield pa.record_batch([b.column(k).filter(keep) for k in range(4)], names=["u", "v", "nu", "nv"])

    return p.mapInArrow(run, PAIR)


def links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT):
    """Of (key, doc_id, text) rows: (rows, classes, links): rows (key, doc_id, n, sig),
    classes of equal sets (sig, node, rep, n, copies) with their least key and id, and
    verified links (u, v) between classes' nodes: all of them but those inside components
    that others already connect."""
    spark = docs.sparkSession
    every = staged(profiles(docs, k), "join-profiles")
    rows = every.filter("chunk is null")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("key").alias("node"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
    classes = staged(classes, "join-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * (100 - percent) // 100) // BUCKET_ROWS + 1)
    counts = merged_sketch(every)
    rarity = spark.sparkContext.broadcast(np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8))
    found = staged(bucket_pairs(prefixes(docs, rarity, buckets, k, percent), percent), "join-candidates")
    side = lambda x: classes.select(F.col("sig").alias(x), F.col("node").alias(f"{x}_node"))
    p = found.filter("list is null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    p = p.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v"))
    tested = staged(_bitmap_filter(staged(p, "join-met"), classes, percent), "join-pairs")
    edges = staged(verified(docs, tested, k, percent), "join-links")
    if found.filter("list is not null").limit(1).count():
        members, bitmaps = long_lists(found, classes)
        for forest in (True, False):
            more = rest_pairs(members, bitmaps, components(edges), percent, forest)
            more = staged(more.join(tested, ["u", "v"], "left_anti"), "join-pairs")
            if more.limit(1).count():
                edges = edges.unionByName(staged(verified(docs, more, k, percent), "join-links"))
                tested = tested.unionByName(more)
    return rows, classes, edges


def join_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, count: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach), n_copies (documents with the same set, itself included); with count,
    n_links (the other documents that it links with, copies among them)."""
    return _joined(*keyed(docs), k, percent, count).drop("key", "component")


def _joined(docs: DataFrame, special: bool, k: int, percent: int, count: bool) -> DataFrame:
    rows, classes, edges = links(docs, k, percent)
    if special:  # the rows of one id are one document
        same = rows.filter("doc_id is not null and key <> doc_id and n > 0").select("doc_id", "sig").distinct().join(classes.select("sig", "node"), "sig")
        least = same.groupBy("doc_id").agg(F.min("node").alias("v"))
        edges = edges.unionByName(same.join(least, "doc_id").select(F.col("node").alias("u"), "v").filter("u <> v"))
    comp = staged(components(edges), "join-components")
    known = classes.select("sig", "node", "rep", "copies").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if special:
        ids = staged(known.groupBy("component").agg(F.min("rep").alias("component_id")), "join-ids")
        known = _with(known, ids, "component")
    else:
        known = known.withColumn("component_id", F.col("component"))
    if count:
        known = known.join(counted(docs, comp, classes, k, percent), "node", "left")
    known = known.select("sig", "component", "component_id", "copies", *(["links"] if count else []))
    some = F.col("n") > 0
    out = rows.select("key", "doc_id", "n", "sig").join(known, "sig", "left").withColumn("component_id", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")))
    if special:  # a row without words goes with its id's other rows
        out = staged(out, "join-rows")
        ids = out.filter("doc_id is not null and key <> doc_id").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_least"))
        out = _with(out, staged(ids, "join-ids"), F.col("doc_id") == F.col("_id"), "left").withColumn("component_id", F.coalesce("_least", "component_id"))
    return out.select(
        "key",
        F.when(some, F.col("component")).otherwise(F.col("key")).alias("component"),
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        "component_id",
        F.when(some, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        *([F.when(some, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")] if count else []),
    )


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs' rows of which one of each component stays: the one with the smallest id. Rows
    that repeat an id count as one document, of which the first row by its columns stays.
    Of components of null ids alone the row with the smallest key stays."""
    held, special = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    out = _joined(held.drop("row"), special, k, percent, False)
    out = staged(out.select("key", "doc_id", "component_id", "component"), "join-kept")
    if special:
        least = out.filter("component_id is null").groupBy("component").agg(F.min("key").alias("least"))
        out = _with(out, staged(least, "join-null-ids"), "component", "left")
        stays = F.when(F.col("component_id").isNull(), F.col("key") == F.col("least")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    else:
        stays = F.col("doc_id") == F.col("component_id")
    gone = out.filter(~stays).select(F.col("key").alias("gone")).distinct()
    kept = _with(held, staged(gone, "join-gone"), F.col("key") == F.col("gone"), "left_anti")
    if not special:
        return kept.select("row.*")
    own = F.coalesce("doc_id", "key")
    again = staged(out.filter(stays).groupBy(own.alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again"), "join-again")
    one = _with(kept, again, own == F.col("again"), "left_semi").groupBy(own.alias("own")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return _with(kept, again, own == F.col("again"), "left_anti").select("row").unionByName(one.select("row")).select("row.*")


def op6_ngram_join(spark, sf_dir) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y, k, nx.n AS nx, ny.n AS ny FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT root, y FROM reach JOIN links ON x = node),
comp AS (SELECT root AS doc_id, min(node) AS component_id FROM reach GROUP BY root),
copies AS (SELECT x AS doc_id, count(*) AS c FROM links WHERE k = nx AND k = ny GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.component_id, (1 + coalesce(c, 0))::BIGINT AS n_copies, coalesce(deg.l, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN copies ON copies.doc_id = d.doc_id
  LEFT JOIN (SELECT x AS doc_id, count(*) AS l FROM links GROUP BY x) deg ON deg.doc_id = d.doc_id
"""
