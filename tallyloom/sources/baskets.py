"""Baskets from text, CSV and tables: DataFrames (tid, items) and their long form (tid, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_items(line: Column) -> Column:
    """The leading run of whole numbers of a line as array<bigint>; what follows the first other token is left out.

    A number beyond 64 bits is another token. A comment, a blank line or a line that starts with something else gives an empty array.
    """
    run = F.regexp_extract(line, r"^\s*([+-]?\d+(?:\s+[+-]?\d+)*)", 1)
    ids = F.transform(F.split(run, r"\s+"), lambda x: x.try_cast("bigint"))
    end = F.array_position(F.transform(ids, F.isnull), F.lit(True))
    return F.when(end > 0, F.slice(ids, F.lit(1), (end - 1).cast("int"))).otherwise(ids)


def read_transactions(spark: SparkSession, path: str, skip_comments: bool = True) -> DataFrame:
    """(tid, items): one row a line of whitespace-separated whole numbers. tid is unique and ascends within a file split.

    skip_comments leaves out blank lines and lines that start with #; else they are empty transactions. A missing path fails
    at once.
    """
    lines = spark.read.text(path)
    if skip_comments:
        lines = lines.filter(~F.trim("value").rlike("^(#|$)"))
    return lines.select(F.monotonically_increasing_id().alias("tid"), parse_items(F.col("value")).alias("items"))


def read_text_transactions(spark: SparkSession, path: str) -> DataFrame:
    """(tid, items array<string>): as read_transactions, but every token is an item by its text."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(#|$)"))
    return lines.select(F.monotonically_increasing_id().alias("tid"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("items"))


#: A cell after its comma: quoted, with doubled quotes inside and perhaps more after it, or up to the next comma.
_CELL = r',("[^"]*+(?:""[^"]*+)*+(?:"[^,]*+)?|[^,]*+)'
_QUOTED = r'^"([^"]*+(?:""[^"]*+)*+)(?:"(.*))?$'


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line as text: a cell that begins with a quote ends with the next single one, a doubled quote in it is one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    inner = lambda x: F.concat(F.replace(F.regexp_extract(x, _QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, _QUOTED, 2))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(x))


def read_csv_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, item): the trimmed non-empty cells of ragged CSV rows without a header; rows without a cell vanish.

    row ascends in file order within a split, col from 0 among the row's cells that are left. A row is a line, so that files can be split: a quoted cell
    that isn't closed ends with its line.
    """
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    cells = F.filter(F.transform(csv_cells(F.col("value")), trimmed), lambda x: x != "")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("row"), cells.alias("cells"))
    return rows.select("row", F.posexplode("cells").alias("col", "item"))


def baskets(long: DataFrame, tid: str | list[str] = "tid", item: str = "item") -> DataFrame:
    """(tid..., items): the set of items of each transaction, ascending; null items are left out."""
    keys = [tid] if isinstance(tid, str) else tid
    return long.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"))


def explode_items(frame: DataFrame, items: str = "items", tid: str = "tid") -> DataFrame:
    """(tid, item): each distinct non-null item of each transaction once."""
    return frame.select(tid, F.explode(F.array_distinct(F.array_compact(items))).alias("item"))


def split_evenly(frame: DataFrame, n: int) -> DataFrame:
    """The rows dealt round-robin over n partitions, so that equal work goes to each."""
    return frame.repartition(n)


# Baskets of the test tables --------------------------------------------------------------------------------------


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, item): the brands that each order holds."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("tid"), F.col("p_brand").alias("item")).distinct()


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, item): the kinds of event of each user on each day."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type")
    return ev.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("tid"), F.col("event_type").alias("item")).distinct()


_ATTRIBUTES = ("l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_linenumber")


def _line_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """The line items that have an attribute, and their attributes as an array."""
    pct = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    items = F.array(
        F.concat(F.lit("rf="), "l_returnflag"), F.concat(F.lit("ls="), "l_linestatus"), F.concat(F.lit("disc="), pct("l_discount")),
        F.concat(F.lit("tax="), pct("l_tax")), F.concat(F.lit("ln="), F.col("l_linenumber").cast("string")),
    )
    some = " or ".join(f"{c} is not null" for c in _ATTRIBUTES)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_ATTRIBUTES).filter(some), F.array_compact(items).alias("items")


def line_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, items): five attributes of each line item as name=value; a line item without any is none. The rows are transactions as they are."""
    li, items = _line_items(spark, sf_dir)
    return li.select(F.monotonically_increasing_id().alias("tid"), items)


def line_attribute_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(items, w): the transactions of line_attributes, each kind of line item once with their number. Line items are counted by their columns, so that
    items are made for the kinds only."""
    li, items = _line_items(spark, sf_dir)
    return li.groupBy(*_ATTRIBUTES).agg(F.count("*").alias("w")).select(items, "w")
