"""Text sinks: itemsets, item counts, encoded transactions and dictionaries, one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.itemsets import item_string


def write_itemsets(itemsets: DataFrame, path: str, with_support: bool = False) -> None:
    """An itemset a line, its items ascending and separated by spaces; with_support adds ` (n)`."""
    line = item_string(F.col("itemset"))
    if with_support:
        line = F.concat(line, F.format_string(" (%d)", "support"))
    itemsets.select(line.alias("value")).write.text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """`item count` a line."""
    counts.select(F.concat_ws(" ", F.col("item").cast("string"), F.col("support").cast("string")).alias("value")).write.text(path)


def write_transactions(frame: DataFrame, path: str) -> None:
    """The items of a transaction a line, in their order."""
    frame.select(F.array_join(F.col("items").cast("array<string>"), " ").alias("value")).write.text(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """`name id` a line; names may hold spaces, the id comes last. A name with a line end is an error: it would be two lines."""
    broken = F.raise_error(F.concat(F.lit("a name with a line end, of id "), F.col("id").cast("string"))).cast("string")
    name = F.when(F.col("item").cast("string").rlike(r"[\n\r]"), broken).otherwise(F.col("item").cast("string"))
    dictionary.select(F.concat_ws(" ", name, F.col("id").cast("string")).alias("value")).write.text(path)


def read_dictionary(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract("value", r"^(.*) (\d+)$", 1).alias("item"), F.regexp_extract("value", r"^(.*) (\d+)$", 2).try_cast("bigint").alias("id"))
