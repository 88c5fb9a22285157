"""Itemsets: canonical form, views and comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(itemset: Column) -> Column:
    """Distinct items in ascending order of their own type."""
    return F.array_sort(F.array_distinct(F.array_compact(itemset)))


def item_string(itemset: Column) -> Column:
    """Ascending items separated by spaces."""
    return F.array_join(F.array_sort(itemset).cast("array<string>"), " ")


def formatted(itemset: Column) -> Column:
    """`{a, b}`."""
    return F.format_string("{%s}", F.array_join(F.array_sort(itemset).cast("array<string>"), ", "))


def itemset_of(line: Column) -> Column:
    """A line's whole numbers as an itemset (array<bigint>); null if it has another token, one beyond 64 bits or none."""
    tokens = F.when(line.rlike(r"^\s*[+-]?\d+(\s+[+-]?\d+)*\s*$"), F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "))
    ids = F.transform(tokens, lambda x: x.try_cast("bigint"))
    return F.when(~F.exists(ids, F.isnull), canonical(ids))


def parse_itemsets(lines: DataFrame, value: str = "value") -> DataFrame:
    """(itemset): the distinct itemsets of lines."""
    return lines.select(itemset_of(F.col(value)).alias("itemset")).filter(F.size("itemset") > 0).distinct()


def of_size(itemsets: DataFrame, k: int) -> DataFrame:
    return itemsets.filter(F.size("itemset") == k)


def size_histogram(itemsets: DataFrame) -> DataFrame:
    """(size, n)."""
    return itemsets.groupBy(F.size("itemset").alias("size")).agg(F.count("*").alias("n"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("itemset").intersect(b.select("itemset"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("itemset").subtract(b.select("itemset"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, itemset): what only one of both has, `first` or `second`."""
    side = lambda name, x: x.select(F.lit(name).alias("side"), "itemset")
    return side("first", only_in(a, b)).unionAll(side("second", only_in(b, a)))


def equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same): one row, whether both hold the same itemsets."""
    return difference(a, b).agg((F.count("*") == 0).alias("same"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same itemsets."""
    return difference(a, b).isEmpty()


def sample_of(itemsets: DataFrame, n: int = 3) -> DataFrame:
    """The first n itemsets by size and items: a report's excerpt."""
    return itemsets.orderBy(F.size("itemset"), "itemset").limit(n)


def match_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """(matched, total, percent): itemsets that both results have with the same support, of all that either has."""
    x = a.select("itemset", F.col("support").alias("sa")).join(b.select("itemset", F.col("support").alias("sb")), "itemset", "full")
    hit = F.coalesce(F.sum((F.coalesce(F.col("sa") == F.col("sb"), F.lit(False))).cast("long")), F.lit(0))
    return x.agg(hit.alias("matched"), F.count("*").alias("total")).withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("matched") / F.col("total")).otherwise(100.0))


def relabel(itemsets: DataFrame, dictionary: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Itemsets of ids as itemsets of their names."""
    near = F.broadcast(dictionary) if dictionary.count() <= broadcast_rows else dictionary
    x = itemsets.withColumn("set_", F.monotonically_increasing_id()).select("set_", "support", F.explode("itemset").alias("id"))
    return x.join(near, "id").groupBy("set_", "support").agg(F.array_sort(F.collect_list("item")).alias("itemset")).select("itemset", "support")
