"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source, the sources' targets follow from weights that repeat along
the ordered sources, the repetition rate of a source is target / size, and each document
is emitted floor(rate) times plus once more where a hash of its id falls below the
fraction.

Defined cases: a null or empty text has size 0 and may still be emitted (it adds no
words); a null source is a source of its own, ordered last; rows that repeat an id get
equal draws; a very long text is one row like any other; an empty table gives an empty mix;
columns of any name are carried by `mix` and ignored by `allocation`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only_columns, staged, table, word_count

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"
#: Source tables of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) of (source, size) rows.

    A target is min(max_rate * source_size, level * weight) with the one level at which
    the targets sum to all sizes: sorted by cap / weight, a prefix of the sources is
    capped and the rest share what is left by weight. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("w", F.element_at(w, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.lit(max_rate) * F.col("source_size")
    by_ratio = Window.orderBy((cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    upto_end = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("w").over(upto_end)
    per = per.withColumn("cap", cap).withColumn("lvl", level)
    # the first source whose cap is not below its share at its level fixes the level
    fixed = F.min(F.when(F.col("cap") >= F.col("lvl") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("lvl").alias("l")))).over(whole)["l"]
    target = F.least(F.col("cap").cast("double"), fixed * F.col("w"))
    per = per.withColumn("target", F.coalesce(target, F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def copies(doc_id, rate, seed: str = SEED):
    """floor(rate), plus one where the id's hash, uniform on [0, 1), is below the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def with_rates(df: DataFrame, rates: DataFrame) -> DataFrame:
    """df joined to its sources' rows. One row per source is broadcast up to a checked
    number of sources; beyond it, it is an ordinary join that AQE splits where skewed."""
    small = rates.count() <= BROADCAST_SOURCES
    r = rates.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(r) if small else r, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def sizes_of(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def allocation(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sized = sizes_of(only_columns(docs, ("doc_id", "text", "source")))
    rates = staged(targets(sized, weights, max_rate), "mix-rates")
    out = with_rates(sized, rates).withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves, each as often as it is taken, with docs' columns."""
    sized = sizes_of(only_columns(docs, ("doc_id", "text", "source")))
    rates = staged(targets(sized, weights, max_rate).select("source", F.col("rate").alias("_rate")), "mix-rates")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source")
    out = with_rates(held, rates).select("row", F.explode(F.array_repeat(F.lit(0), copies(F.col("doc_id"), F.col("_rate"), seed))))
    return out.select("row.*")


def op3_mixing(spark, sf_dir) -> DataFrame:
    return allocation(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (3 * source_size)::DOUBLE AS cap FROM per),
lvls AS (
  SELECT a.*, ((SELECT sum(source_size)::DOUBLE FROM weighed)
     - coalesce((SELECT sum(cap) FROM weighed b WHERE b.cap / b.w < a.cap / a.w), 0))
     / (SELECT sum(w) FROM weighed b WHERE b.cap / b.w >= a.cap / a.w) AS lvl FROM weighed a),
lvl AS (SELECT min_by(lvl, cap / w) AS l FROM lvls WHERE cap >= lvl * w),
goal AS (
  SELECT source, source_size, coalesce(least(cap, l * w), 0.0) AS target FROM weighed, lvl),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0.0 END AS rate FROM goal)
SELECT doc_id, size, source_size, target,
  (size * copies)::BIGINT AS taken, copies
FROM (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
"""
