"""Best-fit packing of documents into sequences of fixed capacity by sum of squares.

Pieces are dealt into shards of about SHARD_PIECES by a number drawn when they are written,
and each shard is packed in one task, from long to short pieces: each piece goes where the
squared counts of open bins per residual gap become smallest (ties to the smallest gap),
into a new sequence only where no open one has room. (With new sequences as candidates
everywhere the rule needs 0.4 % more of them: see the README.) A shard leaves a few
sequences unfilled, whatever its size, so no step sees all pieces.

Defined cases: a null or empty text is its end id alone; a very long text is cut into
pieces; repeated rows are packed each, and dealt apart; an empty table gives no rows; a
piece of exactly the capacity fills a sequence alone; pieces of one length go in the order
of their ids, null first; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_columns, staged, table
from .ids import WordEncoder, crc_u32, text_chunks

CAPACITY = 2048
END_ID = 0
#: Pieces of a shard, about.
SHARD_PIECES = 100_000


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
KINDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal) of each whole text's ids and end id;
    only longer documents are cut, at multiples of the capacity. deal is a number that
    deals rows out evenly, equal ones too."""

    def run(batches):
        enc = WordEncoder.of(path)
        end = np.array([end_id], enc.dtype)
        task, n = TaskContext.get().partitionId(), 0
        for rows, texts in text_chunks(batches):
            out = [[], [], [], [], [], []]
            for d, x in zip(rows.column(0).to_pylist(), enc.encode(texts), strict=True):
                x = np.concatenate([x, end])
                for k in range(0, len(x), capacity):
                    part = x[k : k + capacity]
                    n += 1
                    for col, v in zip(out, (d, k // capacity, k, len(part), crc_u32(part), zlib.crc32(b"%d:%d" % (task, n))), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[*COLUMNS, "deal"])

    return only_columns(docs, ("doc_id", "text")).mapInArrow(run, f"{KINDS}, deal long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, pieces taken in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    held = np.zeros(capacity + 1, np.int64)  # how many bins have it
    held_at = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    used = 0
    for i, c in enumerate(lengths.tolist()):
        fits = np.flatnonzero(held[c:]) + c
        if len(fits):
            # how the sum changes: one bin less of a gap, one more of what it leaves
            rest = fits - c
            change = np.where(rest > 0, 2 * held[rest] + 1, 0) + 1 - 2 * held[fits]
            gap = int(fits[np.argmin(change)])
            at = open_bins[gap].pop()
            held[gap] -= 1
        else:
            gap, at = capacity, used
            used += 1
        if gap > c:
            open_bins[gap - c].append(at)
            held[gap - c] += 1
        held_at[i], offset[i] = at, capacity - gap
    return held_at, offset


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (as of `pieces`, written and reread) with sequence_id and offset."""
    shards = rows.count() // SHARD_PIECES + 1

    def run(t: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_start"))
        at, offset = sum_of_squares(t.column("length").to_numpy(), capacity)
        shard = t.column("shard")[0].as_py()
        return t.select(COLUMNS).append_column("sequence_id", pa.array((shard << 40) + at)).append_column("offset", pa.array(offset))

    dealt = rows.withColumn("shard", F.pmod(F.col("deal"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, f"{KINDS}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(staged(pieces(docs, path, capacity, end_id), "pack-pieces"), capacity)


def op9_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
