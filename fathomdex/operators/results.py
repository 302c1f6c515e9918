"""Result sets: lazy (key, score) rows with sorting, filters, set algebra and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import DEFAULTS


def sort_spec(spec: str) -> list[tuple[str, bool]]:
    """[(field, descending)] of a comma list of fields with + or -, ascending by default."""
    out = []
    for part in (p.strip() for p in spec.split(",")):
        if part:
            out.append((part.lstrip("+-").lower(), part.startswith("-")))
    return out or [("score", True)]


class ResultSet:
    def __init__(self, index, df: DataFrame, sort: str = "-score"):
        self.index = index
        self.df = df.select("key", "score")
        self.sort = sort

    def _like(self, df: DataFrame) -> ResultSet:
        return ResultSet(self.index, df, self.sort)

    # ---- rows

    def with_fields(self, *fields: str) -> DataFrame:
        """Results with saved fields of their documents."""
        key = self.index.key
        docs = self.index.docs.select(F.col(key).alias("key"), *[F.col(f) for f in fields if f.lower() != "key"])
        return self.df.join(docs, "key")

    def filter(self, predicate, *fields: str) -> ResultSet:
        """Results for which a column, or a function of the row's columns, holds."""
        rows = self.with_fields(*fields) if fields else self.df
        cond = predicate if isinstance(predicate, Column) else predicate(*[F.col(f) for f in fields])
        return self._like(rows.filter(cond))

    def rescore(self, modify) -> ResultSet:
        """Scores replaced by a function of the score column (or by a column)."""
        new = modify if isinstance(modify, Column) else modify(F.col("score"))
        return self._like(self.df.withColumn("score", new))

    def _order(self, spec: str):
        keys = sort_spec(spec)
        rows = self.df
        names = [f for f, _ in keys if f not in ("score", "key")]
        if names:
            rows = self.with_fields(*names)
        cols = []
        for name, down in keys:
            c = F.col(name)
            f = self.index.fields.get(name)
            if f is not None and not f.multiple and f.type in (*DEFAULTS, "date"):
                c = F.coalesce(c, F.timestamp_seconds(F.lit(0)) if f.type == "date" else F.lit(DEFAULTS[f.type]))
            elif f is not None and f.multiple:
                c = F.element_at(c, 1)
            cols.append(c.desc() if down else c.asc())
        return rows.orderBy(*cols, F.col("key").asc())

    def top(self, n: int, start: int = 0, sort: str | None = None) -> DataFrame:
        """n results from start on, in order, ties by key."""
        return self._order(sort or self.sort).offset(start).limit(n)

    def all(self, sort: str | None = None) -> DataFrame:
        return self._order(sort or self.sort)

    def size(self) -> int:
        return self.df.count()

    def top_by_scored_field(self, field: str, score_field: str, value: str, n: int) -> DataFrame:
        """Ranked by the score that a parallel field holds at a value's place."""
        rows = self.with_fields(field, score_field)
        pairs = F.arrays_zip(F.col(field).alias("v"), F.col(score_field).alias("s"))
        at = F.element_at(F.transform(F.filter(pairs, lambda p: p["v"] == value), lambda p: p["s"]), 1)
        rows = rows.filter(F.array_contains(field, value)).select("key", at.alias("score"))
        return rows.orderBy(F.col("score").desc(), "key").limit(n)

    def observed(self, name: str = "results"):
        """(the same results, an observation of their number and best score, filled when
        an action has run over them)."""
        from pyspark.sql import Observation

        seen = Observation(name)
        return self._like(self.df.observe(seen, F.count(F.lit(1)).alias("size"), F.max("score").alias("best"))), seen

    # ---- algebra

    def weight(self, w: float) -> ResultSet:
        return self.rescore(lambda s: s * w)

    def intersect(self, other: ResultSet) -> ResultSet:
        o = other.df.select(F.col("key"), F.col("score").alias("_s"))
        return self._like(self.df.join(o, "key").select("key", (F.col("score") + F.col("_s")).alias("score")))

    def union(self, other: ResultSet) -> ResultSet:
        return self._like(self.df.unionByName(other.df).groupBy("key").agg(F.sum("score").alias("score")))

    def difference(self, other: ResultSet) -> ResultSet:
        return self._like(self.df.join(other.df.select("key"), "key", "left_anti"))

    # ---- groups

    def group_by(self, field: str, ignore_case: bool = False, keys: bool = False) -> DataFrame:
        """(value, size, best) per value of a field, large groups first; documents without
        a value are in the group Empty. keys: whether members are listed, too."""
        spec = self.index.fields[field.lower()]
        rows = self.with_fields(field)
        v = F.explode_outer(field) if spec.multiple else F.col(field)
        rows = rows.select("key", "score", v.alias("value"))
        c = F.col("value").cast("string")
        rows = rows.withColumn("value", F.coalesce(F.lower(c) if ignore_case else c, F.lit("Empty")))
        extra = [F.sort_array(F.collect_list("key")).alias("keys")] if keys else []
        return rows.groupBy("value").agg(F.count("*").alias("size"), F.max("score").alias("best"), *extra).orderBy(F.col("size").desc(), "value")

    def group_by_scored(self, field: str, score_field: str) -> DataFrame:
        """(value, size, mean_distance) with distance 1 - the parallel field's score."""
        rows = self.with_fields(field, score_field)
        z = F.explode(F.arrays_zip(F.col(field).alias("v"), F.col(score_field).alias("s"))).alias("z")
        return rows.select("key", z).groupBy(F.col("z.v").alias("value")).agg(F.count("*").alias("size"), F.avg(1 - F.col("z.s")).alias("mean_distance"))

    def top_values(self, field: str, n: int = -1) -> DataFrame:
        out = self.group_by(field).filter("value <> 'Empty'")
        return out if n < 0 else out.limit(n)


def results_for(index, keys) -> ResultSet:
    """A result set of given keys (all score 1) or of a key to score mapping."""
    pairs = list(keys.items()) if isinstance(keys, dict) else [(k, 1.0) for k in keys]
    kind = dict(index.docs.dtypes)[index.key]
    df = index.spark.createDataFrame(pairs, f"key {kind}, score double")
    live = index.docs.select(F.col(index.key).alias("key"))
    return ResultSet(index, df.join(live, "key", "left_semi"))


def all_of(parts: list[ResultSet]) -> ResultSet:
    return reduce(lambda a, b: a.union(b), parts)
