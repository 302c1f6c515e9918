"""What the operators share: table access, the shared work folder, column sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, staged, work_dir

__all__ = ["DOCUMENT_COLUMNS", "SPACE", "WORD", "bind", "only_columns", "staged", "table", "word_count", "words_of", "work_dir"]

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: The columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row, whatever the optimizer collapses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the text's words; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def only_columns(df: DataFrame, names) -> DataFrame:
    """The named columns alone, so that extra columns of any name cannot clash; ids of
    any integer type as long."""
    return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if n.endswith("_id") else F.col(f"`{n}`") for n in names])
