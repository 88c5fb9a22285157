"""Item supports, histograms and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.shared import row_numbers

#: Up to so many frequent items, ranks come from one small window; beyond, from ranges.
WINDOW_ITEMS = 100_000


def check_support(min_support: int) -> int:
    if min_support < 1:
        raise ValueError("min_support is an absolute count of at least 1")
    return int(min_support)


def item_support(long: DataFrame, weight: str | None = None) -> DataFrame:
    """(item, support): in how many transactions each item is. long: (tid, item) without repeated rows; weight: how many transactions a tid stands for.

    Counts are summed before the shuffle, so an item in most transactions costs one row a task.
    """
    return long.filter("item is not null").groupBy("item").agg((F.sum(weight) if weight else F.count("*")).alias("support"))


def frequent_items(long: DataFrame, min_support: int, weight: str | None = None) -> DataFrame:
    """Items with at least min_support transactions (inclusive)."""
    return item_support(long, weight).filter(F.col("support") >= check_support(min_support))


def dense_histogram(long: DataFrame, size: int, item: str = "item") -> DataFrame:
    """(item, support) for every id from 0 to size - 1, zeros included, counting every occurrence; ids outside aren't shown."""
    ids = long.sparkSession.range(size).withColumnRenamed("id", "item")
    counts = long.filter(F.col(item).between(0, size - 1)).groupBy(F.col(item).cast("long").alias("item_")).agg(F.count("*").alias("n"))
    return ids.join(counts, F.col("item") == F.col("item_"), "left").select("item", F.coalesce("n", F.lit(0)).alias("support"))


def ranked(items: DataFrame) -> DataFrame:
    """(item, support, rank): by descending support, ties by ascending item, from 1: a strict order."""
    order = [F.desc("support"), F.asc("item")]
    if items.count() <= WINDOW_ITEMS:
        return items.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return row_numbers(items, order, "rank")


def distinct_items(long: DataFrame) -> DataFrame:
    """(n): the number of distinct items."""
    return long.agg(F.count_distinct("item").alias("n"))


def relative_support(min_count: int, n: int) -> float:
    """A share of n transactions that a miner with a rounded-up minimum turns into exactly min_count."""
    return (check_support(min_count) - 0.5) / n
