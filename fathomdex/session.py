"""Getting this package to the Python workers, and the folder that they share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the session's files, once, unless workers find it anyway: on
    PYTHONPATH, or (one machine) in the working folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    here = sc.master.startswith("local") and not sc.master.startswith("local-") and Path.cwd() == ROOT
    if on_path or here:
        return
    top = Path(tempfile.mkdtemp(prefix="fathomdex-"))
    shutil.copytree(Path(__file__).parent, top / "tree" / "fathomdex", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(top / "fathomdex"), "zip", top / "tree"))
    shutil.rmtree(top / "tree")


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset
    (tests on one machine), a temporary folder is made once and put there."""
    ship_package(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fathomdex-")
        spark.conf.set("spark.checkpoint.dir", base)
        import atexit

        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/fathomdex-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: it cuts the lineage
    and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 500_000


#: Rows of the commonest terms that joined_by_size broadcasts.
COMMON_ROWS = 200_000


def joined(df: DataFrame, small: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """df joined to a table that is small as a rule: up to a checked number of its rows it
    is broadcast, larger ones are joined by shuffle."""
    few = small.limit(most + 1).count() <= most
    return df.join(F.broadcast(small) if few else small, on, how)


def joined_by_size(df: DataFrame, table: DataFrame, on: str, size: str) -> DataFrame:
    """df joined to a table with one row a key and, as size, about how many rows of df have
    it: the COMMON_ROWS keys of the largest sizes are broadcast, so that only the rows of
    the rarer ones, few by nature, are joined by shuffle."""
    level = F.floor(F.log2(size) * 8)
    cut, room = None, COMMON_ROWS
    for r in table.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():  # some hundreds of levels
        room -= r["count"]
        if room < 0:
            break
        cut = r["level"]
    common = F.lit(False) if cut is None else level >= cut
    out = df.join(F.broadcast(table.filter(common)), on)
    if room >= 0:
        return out
    rest = df.join(F.broadcast(table.filter(common).select(on)), on, "left_anti")
    return out.unionByName(rest.join(table.filter(~common), on))


def ranked(df: DataFrame, by: list[Column], sums: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """df with each row's place, from 1, in an order over all rows, and running sums of
    columns ({new: column}) along it. Rows are dealt by ranges of the order and counted
    within them, so no task has more than its range. by has to tell all rows apart."""
    sums = sums or {}
    at = f"_range_{uuid.uuid4().hex[:8]}"
    rows = staged(df.repartitionByRange(*by).withColumn(at, F.spark_partition_id()), "ranked")
    earlier = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = rows.groupBy(at).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    over = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    base = sizes.select(at, over("_n").alias(f"{at}_n"), *[over(f"_s{i}").alias(f"{at}_s{i}") for i in range(len(sums))])
    inside = Window.partitionBy(at).orderBy(*by)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    cols = [(F.row_number().over(inside) + F.col(f"{at}_n")).alias(rank)]
    cols += [(F.sum(c).over(so_far) + F.col(f"{at}_s{i}")).alias(new) for i, (new, c) in enumerate(sums.items())]
    return rows.join(F.broadcast(base), at).select(*[quoted(c) for c in df.columns], *cols)


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")
