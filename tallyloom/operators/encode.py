"""Dictionary encoding of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize, row_numbers


def first_seen(cells: DataFrame, place: list[str], item: str = "item") -> DataFrame:
    """(item, id): ids from 1 in the order in which items first appear by the columns `place`."""
    first = cells.groupBy(F.col(item).alias("item")).agg(F.min(F.struct(*place)).alias("first"))
    return row_numbers(first, [F.asc("first"), F.asc("item")], "id").select("item", "id")


def encode(cells: DataFrame, dictionary: DataFrame, tid: str = "row", at: str = "col") -> DataFrame:
    """(tid, items): each transaction's ids in the order of its cells, repeats kept."""
    x = cells.join(dictionary, "item").groupBy(F.col(tid).alias("tid"))
    return x.agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "id"))), lambda s: s["id"]).alias("items"))


def dense_rerank(long: DataFrame, item: str = "item") -> DataFrame:
    """(item, id): the distinct items' places in ascending order, from 1."""
    return row_numbers(long.select(F.col(item).alias("item")).distinct(), [F.asc("item")], "id").select("item", "id")


def rerank_transactions(frame: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(tid, items): items replaced by their dense ids; order and repeats stay, as do empty transactions.

    The transactions are written first, so that a tid made from partitions is the same in each of the scans.
    """
    frame = materialize(frame.select("tid", "items"))
    cells = frame.select("tid", F.posexplode("items").alias("col", "item"))
    ids = dense_rerank(cells) if ids is None else ids
    new = encode(cells, ids, "tid", "col").withColumnRenamed("items", "ids")
    return frame.select("tid").join(new, "tid", "left").select("tid", F.coalesce("ids", F.array().cast("array<bigint>")).alias("items"))


def one_hot(long: DataFrame, vocabulary: list | None = None) -> DataFrame:
    """tid and a boolean column for each item of the vocabulary (default: all, ascending). For small vocabularies; mining doesn't use it."""
    return long.groupBy("tid").pivot("item", vocabulary).agg(F.max(F.lit(True))).na.fill(False)


def one_hot_sparse(long: DataFrame, ids: DataFrame | None = None, item: str = "item") -> DataFrame:
    """(tid, size, indices): one-hot rows in the sparse form: the vocabulary's size and the ascending places, from 0, of a transaction's items.

    ids: (item, id) from 1, by default all items in ascending order. For any number of items, for no column is made of one. Items without an id are
    left out, a transaction of only such has no indices.
    """
    ids = materialize(dense_rerank(long, item) if ids is None else ids)
    size = ids.agg(F.coalesce(F.max("id"), F.lit(0)).alias("size")).first().size
    x = long.join(ids.withColumnRenamed("item", item), item, "left").groupBy("tid")
    return x.agg(F.array_sort(F.collect_set(F.col("id") - 1)).alias("indices")).select("tid", F.lit(size).cast("long").alias("size"), "indices")
