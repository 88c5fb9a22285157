"""Written intermediate results, partitioned row numbers and running sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that executors share; in local mode a folder of its own if that is unset."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", d := tempfile.mkdtemp(prefix="tallyloom-"))
    return d


_written: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is deleted as by materialize()."""
    path = f"{shared_dir(spark)}/tallyloom-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(frame: DataFrame) -> DataFrame:
    """frame as a table in the shared folder: computed once, lineage cut, lost executors do no harm.

    It is deleted by release(), else with all others by release_all() or when Python ends.
    """
    frame.write.parquet(path := scratch_path(frame.sparkSession))
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames: DataFrame | None) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for f in frames:
        if f is not None and (path := f.__dict__.pop("_at", None)) and _written.pop(path, None):
            _delete(f.sparkSession, path)


@atexit.register
def release_all() -> None:
    """Deletes all tables of materialize(): results that read them can't be read any more."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its owner clears the shared folder
            return


def _ranged(frame: DataFrame, order: list[Column]) -> tuple[DataFrame, Column]:
    """frame written in this order by ranges, with each row's place within (at_), and the number of its range."""
    x = materialize(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    return x, F.shiftright("at_", 33).alias("part_")


def _bases(x: DataFrame, part: Column, value: Column) -> DataFrame:
    """(part_, base_): the sum of the value over the ranges before; a row for each range."""
    sums = x.groupBy(part).agg(value.alias("in_"))
    base = F.coalesce(F.sum("in_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(sums.select("part_", base.alias("base_")))


def row_numbers(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """frame with the global place of each row in this order, from 1, without one task that holds all rows.

    Rows are sorted by ranges and numbered within their range; the numbers of rows before a range come from one row a range.
    Rows equal in the order are numbered in any order.
    """
    x, part = _ranged(frame, order)
    place = (F.col("base_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return x.withColumn("part_", part).join(_bases(x, part, F.count("*")), "part_").withColumn(name, place).drop("at_", "part_", "base_")


def running_sums(frame: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """frame with the sum of a column over the rows before each in this order, from 0, summed up within ranges of rows."""
    x, part = _ranged(frame, order)
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("part_", part).withColumn(name, inside).join(_bases(x, part, F.sum(value)), "part_")
    return x.withColumn(name, (F.col(name) + F.col("base_")).cast("long")).drop("at_", "part_", "base_")
