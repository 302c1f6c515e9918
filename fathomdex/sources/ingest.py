"""Documents one by one, export, metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SimpleIndexer:
    """Gathers documents field by field; `finish` gives their rows and counted terms."""

    def __init__(self, spark: SparkSession, key: str = "key"):
        self.spark, self.key = spark, key
        self.rows: list[dict] = []
        self.terms: list[tuple] = []
        self.doc: dict | None = None

    def start_document(self, key: str) -> None:
        if self.doc is not None:
            raise ValueError("the last document is not ended")
        self.doc = {self.key: key}

    def add_field(self, name: str, value) -> None:
        """A value; values of one name in one document gather in a list."""
        if self.doc is None:
            raise ValueError("no document is open")
        name = name.lower()
        if name in self.doc:
            old = self.doc[name]
            self.doc[name] = [*(old if isinstance(old, list) else [old]), value]
        else:
            self.doc[name] = value

    def add_term(self, term: str, count: int = 1, field: str = "text") -> None:
        self.terms.append((self.doc[self.key], field.lower(), term, count))

    def end_document(self) -> None:
        self.rows.append(self.doc)
        self.doc = None

    def finish(self, schema: str) -> tuple[DataFrame, DataFrame]:
        names = self.spark.createDataFrame([], schema).columns
        rows = [tuple(r.get(n.lower(), r.get(n)) for n in names) for r in self.rows]
        return self.spark.createDataFrame(rows, schema), self.spark.createDataFrame(self.terms, "key string, field string, term string, count long")


def export_json(index, path: str) -> None:
    index.docs.write.json(path)


def xml_rows(index) -> DataFrame:
    """(key, xml): each document as an XML element of its saved fields."""
    enc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = []
    for f in index.fields.values():
        if not f.saved:
            continue
        if f.multiple:
            parts.append(F.array_join(F.transform(F.col(f.name), lambda x, n=f.name: x.cast("string")), "\x1f"))
            parts[-1] = F.when(F.size(f.name) > 0, F.concat(F.lit(f"<{f.name}>"), F.replace(enc(parts[-1]), F.lit("\x1f"), F.lit(f"</{f.name}><{f.name}>")), F.lit(f"</{f.name}>")))
        else:
            parts.append(F.concat(F.lit(f"<{f.name}>"), enc(F.col(f.name).cast("string")), F.lit(f"</{f.name}>")))
    key = F.col(index.key).cast("string")
    return index.docs.select(F.col(index.key).alias("key"), F.concat(F.lit('<document key="'), F.replace(enc(key), F.lit('"'), F.lit("&quot;")), F.lit('">'), F.concat_ws("", *parts), F.lit("</document>")).alias("xml"))


class MetaStore:
    """String properties kept beside an index."""

    def __init__(self, values: dict[str, str] | None = None):
        self.values = dict(values or {})

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.values.get(name, default)

    def set(self, name: str, value: str) -> None:
        self.values[name] = value

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.values),)], "meta string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> MetaStore:
        return MetaStore(json.loads(spark.read.parquet(path).first()["meta"]))
