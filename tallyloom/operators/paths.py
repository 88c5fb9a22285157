"""Weighted paths: the relational form of a prefix tree of transactions.

A transaction's frequent items in rank order are its path; equal paths are one row with a weight. A tree node is a
distinct prefix of paths, its count the weight of the paths that begin with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize, release, row_numbers, running_sums
from tallyloom.operators.items import check_support, frequent_items, ranked
from tallyloom.sources.baskets import baskets, explode_items

#: Up to so many frequent items (an item and two numbers each), ranks are broadcast to the filter; beyond, they are joined by a shuffle.
BROADCAST_ITEMS = 1_000_000


def ranked_items(long: DataFrame, min_support: int, weight: str | None = None) -> DataFrame:
    return ranked(frequent_items(long, min_support, weight))


def filtered(long: DataFrame, ranks: DataFrame, weight: str | None = None) -> DataFrame:
    """(tid, path): each transaction's ranked items, most frequent first; transactions without any are dropped. With their weight, if long has one.

    path: array of structs (rank, item). The ranks are counted before they are broadcast.
    """
    near = F.broadcast(ranks) if ranks.count() <= BROADCAST_ITEMS else ranks
    keys = ["tid", weight] if weight else ["tid"]
    kept = long.join(near, "item").select(*keys, F.struct("rank", "item").alias("s"))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("path"))


def weighted(transactions: DataFrame, weight: str | None = None) -> DataFrame:
    """(path, w): distinct paths and the number of their transactions."""
    return transactions.groupBy("path").agg((F.sum(weight) if weight else F.count("*")).alias("w"))


def merged_sets(frame: DataFrame, items: str = "items", tid: str | None = None, weight: str | None = None) -> DataFrame:
    """(items, w): the distinct sets of items, ascending, and the number of their transactions; null arrays and empty sets are none.

    A transaction is a row, or the rows of one tid; weight: how many transactions a row stands for (null, zero and less: none). Equal sets are one row
    before the shuffle.
    """
    if tid is not None:
        if weight is not None:
            raise ValueError("the rows of one tid are one transaction: they have no weight")
        frame, items = baskets(explode_items(frame, items, tid), tid), "items"
    x = frame.select(F.sort_array(F.array_distinct(F.array_compact(items))).alias("items"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    return x.filter((F.size("items") > 0) & (F.col("w") > 0)).groupBy("items").agg(F.sum("w").alias("w"))


def merged_paths(frame: DataFrame, min_support: int, items: str = "items", tid: str | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, w) and ranks (item, support, rank) of the transactions, written. Sets are merged first: what is ranked, joined and written is the distinct ones."""
    sets = materialize(merged_sets(frame, items, tid, weight).withColumn("tid", F.monotonically_increasing_id()))
    long = sets.select("tid", "w", F.explode("items").alias("item"))
    ranks = materialize(ranked_items(long, check_support(min_support), "w"))
    found = materialize(weighted(filtered(long, ranks, "w"), "w"))
    release(sets)
    return found, ranks


def nodes(paths: DataFrame) -> DataFrame:
    """(prefix, item, depth, support): a row for each tree node, whose prefix ends in its item."""
    x = paths.select("w", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("prefix"))
    x = x.groupBy("prefix").agg(F.sum("w").alias("support"))
    return x.select("prefix", F.element_at("prefix", -1)["item"].alias("item"), F.size("prefix").alias("depth"), "support")


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes that are no other's parent."""
    parents = tree.filter("depth > 1").select(F.expr("slice(prefix, 1, depth - 1)").alias("prefix")).distinct()
    return tree.join(parents, "prefix", "left_anti")


def flat(tree: DataFrame) -> DataFrame:
    """The flat form: nodes (pos, parent, item, depth, support, prefix) numbered from 0 in depth-first order; parent: a place, -1 for the root.

    That is the order of the prefixes: one comes before those that it begins. So a parent's place is below its children's.
    """
    x = materialize(row_numbers(tree, [F.asc("prefix")], "pos").withColumn("pos", F.col("pos") - 1))
    up = x.select(F.col("prefix").alias("up"), F.col("pos").alias("parent"))
    shorter = F.when(F.col("depth") > 1, F.expr("slice(prefix, 1, depth - 1)"))
    x = x.withColumn("up", shorter).join(up, "up", "left")
    return x.select("pos", F.coalesce("parent", F.lit(-1)).alias("parent"), "item", "depth", "support", "prefix")


def header(tree: DataFrame) -> DataFrame:
    """(item, support, nodes): an item's support and its number of nodes."""
    return tree.groupBy("item").agg(F.sum("support").alias("support"), F.count("*").alias("nodes"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """(nodes, depth): node count and largest depth."""
    return tree.agg(F.count("*").alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


def tree_lines(tree: DataFrame) -> DataFrame:
    """(place, line): the whole tree as indented text, a line a node, placed from 1 in depth-first order."""
    line = F.concat(F.expr("repeat('  ', depth - 1)"), F.col("item").cast("string"), F.lit(" ("), F.col("support").cast("string"), F.lit(")"))
    return row_numbers(tree, [F.asc("prefix")], "place").select("place", line.alias("line"))


def pattern_base(paths: DataFrame, item) -> DataFrame:
    """(base, w): what precedes the item on the paths that hold it, with their weights; empty prefixes are left out."""
    x = paths.select("w", "path", F.array_position(F.transform("path", lambda s: s["item"]), F.lit(item)).alias("p")).filter("p > 1")
    return x.select(F.expr("slice(path, 1, int(p) - 1)").alias("base"), "w").groupBy("base").agg(F.sum("w").alias("w"))


def _kept_cells(paths: DataFrame, item, min_support: int) -> tuple[DataFrame, DataFrame]:
    """The cells (tid, w, s) of the item's pattern base, and (s, n) of those frequent in it."""
    base = materialize(pattern_base(paths, item).select(F.monotonically_increasing_id().alias("tid"), "base", "w"))
    cells = base.select("tid", "w", F.explode("base").alias("s"))
    return cells, cells.groupBy("s").agg(F.sum("w").alias("n")).filter(F.col("n") >= min_support)


def conditional_paths(paths: DataFrame, item, min_support: int) -> DataFrame:
    """(path, w): the item's pattern base without the items that are infrequent in it: its conditional tree as paths, in the global order."""
    cells, keep = _kept_cells(paths, item, min_support)
    x = cells.join(keep.select("s"), "s").groupBy("tid", "w").agg(F.array_sort(F.collect_list("s")).alias("path"))
    return x.groupBy("path").agg(F.sum("w").alias("w"))


def local_conditional_paths(paths: DataFrame, item, min_support: int) -> DataFrame:
    """As conditional_paths, but items are in the order of their support within the base, ties by ascending item, and ranked by it."""
    cells, keep = _kept_cells(paths, item, min_support)
    local = ranked(keep.select(F.col("s")["item"].alias("item"), F.col("n").alias("support")))
    x = cells.select("tid", "w", F.col("s")["item"].alias("item")).join(local, "item")
    x = x.groupBy("tid", "w").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("path"))
    return x.groupBy("path").agg(F.sum("w").alias("w"))


def states(paths: DataFrame) -> DataFrame:
    """(id, prefix, w): the tree's nodes as states to grow towards the root: the node's item as an itemset (its rank is the itemset's id), the ranks
    before it on its path, and its count."""
    x = paths.select("w", F.transform("path", lambda s: s["rank"]).alias("ranks")).select("w", "ranks", F.posexplode("ranks").alias("p", "id"))
    return x.select("id", F.expr("slice(ranks, 1, p)").alias("prefix"), "w").groupBy("id", "prefix").agg(F.sum("w").alias("w"))


def offsets(tree: DataFrame) -> DataFrame:
    """tree with the running sum of depth - 1 over the nodes before, in the order of item and prefix: where a node's candidates start."""
    x = tree.withColumns({"before": F.col("depth") - 1, "at_path": path_string("prefix")})
    return running_sums(x, [F.asc("item"), F.asc("at_path")], "before", "start").drop("before", "at_path")


def balanced(tree: DataFrame, n: int) -> DataFrame:
    """tree in n partitions of about equal cost: nodes are cut at equal shares of the running sum of depth - 1, what each has to be grown by.

    No partition costs more than its share and one node. Column start: the cost of the nodes before, by item and prefix.
    """
    x = materialize(offsets(tree))
    total = x.agg(F.coalesce(F.sum(F.col("depth") - 1), F.lit(0)).alias("total")).first().total
    return x.repartitionById(n, F.least(F.lit(n - 1), F.floor(F.col("start") * n / max(total, 1))).cast("int"))


def path_string(path):
    """Items of a path, separated by spaces."""
    return F.array_join(F.transform(path, lambda s: s["item"].cast("string")), " ")
