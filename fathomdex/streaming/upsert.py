"""Indexing a stream: each batch replaces its keys' rows in a bucketed store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import last_wins

BUCKETS = 64


class KeyedStore:
    """Rows by key in a folder, dealt into buckets by the key's hash.

    A batch rewrites the buckets that its keys are in, each into a new folder, and then
    writes a manifest: a small file, named by the batch, that says in which folder each
    bucket is. Readers take the last manifest, so a batch shows whole or not at all. A
    batch that runs again starts from the manifest before its own, so it changes nothing;
    and a store that is opened again goes on where the last one stopped. Folders that no
    manifest of the last KEEP names are deleted after a batch.

    Defined cases: a null key is a key like any other; an empty batch changes nothing; a
    store without batches is empty.
    """

    KEEP = 3

    def __init__(self, spark, path: str, key: str, schema, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    # ---- manifests, through Hadoop's file systems, so that any store will do

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self) -> list[int]:
        """The batches that are complete, in order."""
        jvm, fs = self._files()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, batch: int | None) -> dict[str, str]:
        """Which folder each bucket is in after a batch."""
        if batch is None:
            return {}
        lines = self.spark.read.text(f"{self.path}/manifests/{batch:012d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def _commit(self, batch: int, manifest: dict[str, str]) -> None:
        jvm, fs = self._files()
        place = jvm.org.apache.hadoop.fs.Path
        name = f"{self.path}/manifests/{batch:012d}.json"
        out = fs.create(place(f"{self.path}/manifests/_{batch:012d}.tmp"), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        fs.delete(place(name), False)
        if not fs.rename(place(f"{self.path}/manifests/_{batch:012d}.tmp"), place(name)):
            raise OSError(f"could not write {name}")

    def _tidy(self) -> None:
        jvm, fs = self._files()
        place = jvm.org.apache.hadoop.fs.Path
        batches = self.manifests()
        for old in batches[: -self.KEEP]:
            fs.delete(place(f"{self.path}/manifests/{old:012d}.json"), False)
        named = {folder.split("/")[0] for b in batches[-self.KEEP :] for folder in self._manifest(b).values()}
        for f in fs.listStatus(place(self.path)):
            name = f.getPath().getName()
            if name.startswith("batch-") and name not in named:
                fs.delete(f.getPath(), True)

    # ---- rows

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The rows after the last complete batch."""
        last = self.manifests()
        return self._rows(sorted(self._manifest(last[-1] if last else None).values()))

    def upsert(self, batch: DataFrame, batch_id: int, order: str | None = None) -> DataFrame:
        """Merges one batch; gives its keys. Of a key's rows the one with the largest
        order stays, also against rows that are there; without order the batch's."""
        before = [b for b in self.manifests() if b < batch_id]
        manifest = self._manifest(before[-1] if before else None)
        own = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        new = last_wins(batch.select(*[f.name for f in self.schema]), self.key, order)
        keys = new.select(F.col(self.key).alias("_key")).distinct()
        touched = [str(r[0]) for r in new.select(own.alias("b")).distinct().collect()]
        if touched:
            old = self._rows(sorted(manifest[b] for b in touched if b in manifest))
            same = F.col(self.key).eqNullSafe(F.col("_key"))
            rows = old.join(keys, same, "left_anti")
            if order:
                new = last_wins(new.unionByName(old.join(keys, same, "left_semi")), self.key, order)
            rows = rows.unionByName(new).withColumn("_bucket", own)
            into = f"batch-{batch_id:012d}-{uuid.uuid4().hex[:8]}"
            # a bucket's rows are one task's, and one file
            rows.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{into}")
            manifest = {**manifest, **{b: f"{into}/_bucket={b}" for b in touched}}
        self._commit(batch_id, manifest)
        self._tidy()
        return self._rows(sorted(manifest[b] for b in touched)).join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi").select(self.key)


def index_stream(stream: DataFrame, store: KeyedStore, checkpoint: str, order: str | None = None, listeners: list[Callable[[DataFrame, int], None]] = (), available_now: bool = True):
    """Starts a query that upserts every batch and tells listeners its keys."""

    def each(batch: DataFrame, batch_id: int) -> None:
        keys = store.upsert(batch, batch_id, order)
        for tell in listeners:
            tell(keys, batch_id)

    out = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def latest_per_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, ties by the whole row."""
    others = [c for c in events.columns if c not in (key, order)]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in others])).alias("b")
    return events.groupBy(key).agg(best).select(key, f"b.{order}", *[f"b.{c}" for c in others])
