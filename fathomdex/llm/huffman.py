"""Token ids as canonical length-limited Huffman code.

The code comes from the counts of all ids of the corpus: package-merge gives the best
lengths of at most LIMIT bits, and codes follow canonically from the lengths. The file
format is a folder with three Parquet parts: `code` (id, bits), `shards` (shard, base:
ids of all documents before it) and `blocks`. A block is independent: its documents' ids
and sizes, one bit stream, and the bit offset of every STEP-th id, from which all lanes
of a block are decoded side by side through one table.

Documents are dealt into shards by ranges of doc_id, so shards, and blocks by their
first position, are in ascending doc_id order.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first;
rows that repeat an id stay, ordered by their ids' bytes; an empty table gives empty
parts; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only_columns, staged, table, work_dir
from .ids import WordEncoder, crc_u32, text_chunks

LIMIT = 18
STEP = 64
#: Ids in a block, and bytes of text in a shard, about; shards at most.
BLOCK_IDS = 1 << 17
SHARD_BYTES = 4 << 20
MAX_SHARDS = 20_000
END_ID = 1


# ---- code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id (0 where it never occurs), by package-merge: the least total among
    prefix codes of at most `limit` bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit in {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    items = counts[order].astype(np.int64)
    lists = []  # per level: which of the merged list are items
    merged = items
    lists.append(np.ones(len(items), bool))
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([items, pairs])
        at = np.argsort(both, kind="stable")
        lists.append(at < len(items))
        merged = both[at]
    take = 2 * len(items) - 2
    for is_item in reversed(lists):
        k = int(is_item[:take].sum())
        out[order[:k]] += 1
        take = 2 * (take - k)
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """The codes of given lengths, in order of (length, id)."""
    codes = np.zeros(len(bits), np.uint32)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    code = last = 0
    for n in range(1, int(bits.max(initial=0)) + 1):
        same = order[bits[order] == n]
        code <<= n - last
        codes[same] = code + np.arange(len(same))
        code += len(same)
        last = n
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every string of `width` bits, and the width."""
    width = max(1, int(bits.max(initial=1)))
    codes = canonical(bits)
    ids, lens = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    used = np.flatnonzero(bits)
    if len(used):
        first = codes[used].astype(np.int64) << (width - bits[used].astype(np.int64))
        order = np.argsort(first)
        spans = (1 << (width - bits[used[order]].astype(np.int64)))
        whole = np.repeat(used[order], spans)
        ids[: len(whole)] = whole
        lens[: len(whole)] = bits[whole]
    return ids, lens, width


def pack(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset of every STEP-th id."""
    n = bits[ids].astype(np.int64)
    if (n == 0).any():
        raise ValueError("an id has no code")
    upto = np.cumsum(n)
    at = upto - n
    total = int(upto[-1]) if len(upto) else 0
    words = np.zeros((total + 31) // 32 + 2, np.uint64)
    value = codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
    slot = at >> 5
    for shift, add in ((np.uint64(32), 0), (np.uint64(0), 1)):
        part = (value >> shift) & np.uint64(0xFFFFFFFF)
        words += np.bincount(slot + add, weights=part.astype(np.float64), minlength=len(words)).astype(np.uint64)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::STEP].astype("<u4")


def unpack(stream: bytes, n: int, marks: np.ndarray, tab) -> np.ndarray:
    """The n ids of a stream, its lanes of STEP ids side by side."""
    ids, lens, width = tab
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    lanes = len(marks)
    out = np.zeros((lanes, STEP), np.uint32)
    at = marks.astype(np.int64)
    end = len(stream) * 8
    for k in range(STEP):
        at = np.minimum(at, end)
        b = at >> 3
        window = (raw[b].astype(np.uint64) << np.uint64(24)) | (raw[b + 1] << np.uint32(16)) | (raw[b + 2] << np.uint32(8)) | raw[b + 3]
        key = ((window >> (32 - width - (at & 7)).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
        out[:, k] = ids[key]
        at = at + lens[key]
    return out.reshape(-1)[:n]


# ---- corpus


def encoded(docs: DataFrame, path: str, bounds: list[int], end_id: int) -> DataFrame:
    """(shard, doc_id, n, ids): each whole text's ids and the end id."""
    cuts = np.array(bounds, np.int64)

    def run(batches):
        enc = WordEncoder.of(path)
        end = np.array([end_id], enc.dtype)
        for rows, texts in text_chunks(batches):
            ids = [np.concatenate([x, end]) for x in enc.encode(texts)]
            doc = rows.column(0)
            key = np.asarray(doc.fill_null(np.iinfo(np.int64).min))
            yield pa.record_batch(
                [
                    pa.array(np.where(doc.is_null(), 0, np.searchsorted(cuts, key, "right")).astype(np.int32)),
                    doc,
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() if x.dtype.itemsize != 2 else x.tobytes() for x in ids], pa.binary()),
                ],
                names=["shard", "doc_id", "n", "ids"],
            )

    return docs.mapInArrow(run, "shard int, doc_id long, n long, ids binary")


def placed(rows: DataFrame) -> DataFrame:
    """rows, dealt by shard and sorted by doc_id there, with their start in the shard."""
    before = Window.partitionBy("shard").orderBy("doc_id", "ids").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("start", F.sum("n").over(before) - F.col("n"))


def count_ids(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all rows: counted per task, summed by Spark."""

    kind = "<u2" if size <= 65536 else "<u4"

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            col = b.column(0)
            for k in range(0, len(col), 500):
                total += np.bincount(np.frombuffer(b"".join(col.slice(k, 500).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


BLOCK = "shard int, start long, n_ids long, doc_ids binary, null_ids binary, sizes binary, marks binary, stream binary"


def blocks(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Independent blocks of rows that follow each other in a shard."""
    small = len(bits) <= 65536
    packed = bits.tobytes()

    def run(batches):
        size = np.frombuffer(packed, np.uint8)
        codes = canonical(size)
        held, meta, total = [], [], 0

        def block():
            ids = np.concatenate(held)
            stream, marks = pack(ids, size, codes)
            docs = np.array([m[1] or 0 for m in meta], "<i8")
            return pa.record_batch(
                [[meta[0][0]], [meta[0][3]], [len(ids)], [docs.tobytes()], [np.array([m[1] is None for m in meta], np.uint8).tobytes()], [np.array([m[2] for m in meta], "<u4").tobytes()], [marks.tobytes()], [stream]],
                schema=pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), *[(k, pa.binary()) for k in ("doc_ids", "null_ids", "sizes", "marks", "stream")]]),
            )

        for b in batches:
            for s, d, n, x, at in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if held and (total >= BLOCK_IDS or s != meta[0][0] or at != meta[0][3] + total):
                    yield block()
                    held, meta, total = [], [], 0
                held.append(np.frombuffer(x, "<u2" if small else "<u4"))
                meta.append((s, d, n, at))
                total += n
        if held:
            yield block()

    return rows.select("shard", "doc_id", "n", "ids", "start").mapInArrow(run, BLOCK)


def write_ids(docs: DataFrame, out: str, path: str, end_id: int = END_ID) -> None:
    """Encodes docs' whole texts and writes the three parts below `out`."""
    spark = docs.sparkSession
    docs = only_columns(docs, ("doc_id", "text"))
    got = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    n = int(min(MAX_SHARDS, max(1, (got["bytes"] or 0) // SHARD_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100_000)).first()[0] if n > 1 else []
    rows = encoded(docs, path, sorted(set(cuts or [])), end_id)
    rows = staged(placed(rows), "token-ids")
    size = _vocabulary(path)
    bits = code_lengths(count_ids(rows, size))
    totals = rows.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    base, shards = 0, []
    for r in totals:
        shards.append((r["shard"], base))
        base += r["n"]
    spark.createDataFrame([(int(k), int(b)) for k, b in enumerate(bits) if b], "id int, bits int").coalesce(1).write.parquet(f"{out}/code")
    spark.createDataFrame(shards, "shard int, base long").coalesce(1).write.parquet(f"{out}/shards")
    blocks(rows, bits).write.option("compression", "none").parquet(f"{out}/blocks")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _read(spark, out: str):
    code = spark.read.schema("id int, bits int").parquet(f"{out}/code").collect()
    base = {r["shard"]: r["base"] for r in spark.read.schema("shard int, base long").parquet(f"{out}/shards").collect()}
    bits = np.zeros(max([r["id"] for r in code], default=0) + 1, np.uint8)
    for r in code:
        bits[r["id"]] = r["bits"]
    return spark.read.schema(BLOCK).parquet(f"{out}/blocks"), bits, base


def _decoded(block, tab):
    """(shard, start, doc_id, ids) of each document of the blocks of a record batch."""
    for s, at, n, docs, nulls, sizes, marks, stream in zip(*[block.column(k).to_pylist() for k in range(8)], strict=True):
        ids = unpack(stream, n, np.frombuffer(marks, "<u4"), tab)
        upto = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))
        for d, z, a, b in zip(np.frombuffer(docs, "<i8").tolist(), nulls, np.r_[0, upto[:-1]].tolist(), upto.tolist(), strict=True):
            yield s, at + a, None if z else d, ids[a:b]


def read_ids(spark, out: str) -> DataFrame:
    """(doc_id, start, ids array<int>) from the files."""
    rows, bits, base = _read(spark, out)
    raw = bits.tobytes()

    def run(batches):
        tab = decode_table(np.frombuffer(raw, np.uint8))
        for b in batches:
            for k in range(len(b)):
                got = list(_decoded(b.slice(k, 1), tab))
                yield pa.record_batch([pa.array([x[2] for x in got], pa.int64()), pa.array([base[x[0]] + x[1] for x in got], pa.int64()), pa.array([x[3].astype(np.int32) for x in got], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, decoded block by block."""
    rows, bits, base = _read(spark, out)
    raw = bits.tobytes()

    def run(batches):
        tab = decode_table(np.frombuffer(raw, np.uint8))
        for b in batches:
            for k in range(len(b)):
                got = list(_decoded(b.slice(k, 1), tab))
                cols = [[x[2] for x in got], [base[x[0]] + x[1] for x in got], [len(x[3]) for x in got], [crc_u32(x[3]) for x in got]]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_huffman(spark, sf_dir) -> DataFrame:
    import uuid

    import public_tokenizers

    out = f"{work_dir(spark)}/huffman-{uuid.uuid4().hex[:12]}"
    write_ids(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return digests(spark, out)
