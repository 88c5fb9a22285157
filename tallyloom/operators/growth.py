"""Frequent itemsets by pattern growth: conditional projections, mined alone once they are small.

`growth` projects the weighted paths on every frequent item at once, by a key for the suffix: what precedes the item on its paths. Each
projection is pruned to the items that are frequent in it and merged. One that is a single chain gives its subsets in closed form; one that fits
a task is mined there from a local array tree; the others, which are few, are projected again. So no task holds more than LOCAL_CELLS.

`groups` deals the items to groups of about equal cost and sends each path to a group once, up to the last of the group's items (what
precedes is replicated). A group is mined alone, for the itemsets whose last item is its own; groups that don't fit a task go to `growth`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize, release, running_sums
from tallyloom.operators.items import check_support
from tallyloom.operators.mine import itemsets_of
from tallyloom.operators.paths import merged_paths, states

#: Items in the paths of a projection or a group that one task mines (8 bytes each).
LOCAL_CELLS = 500_000
#: Items of a chain whose subsets are given in closed form (numbered in 62 bits).
MOST_CHAIN = 60
_FOUND = "ranks array<long>, support long"


# In one task -----------------------------------------------------------------------------------------------------


def array_tree(paths: list, weights: list) -> tuple[list, list, list]:
    """(item, parent, count) of a prefix tree's nodes, in depth-first order: a parent's place is before its children's, -1 is the root."""
    item, parent, count, at, last = [], [], [], [], ()
    for path, w in sorted(zip(map(tuple, paths), weights, strict=True)):
        same = 0
        while same < min(len(path), len(last)) and path[same] == last[same]:
            same += 1
        del at[same:]
        for x in path[same:]:
            parent.append(at[-1] if at else -1)
            at.append(len(item))
            item.append(x)
            count.append(0)
        for k in at:
            count[k] += w
        last = path
    return item, parent, count


def grown(tree: tuple[list, list, list], least: int, suffix: tuple = (), wanted=None) -> Iterator[tuple[tuple, int]]:
    """(itemset, support) of an array tree by conditional trees, itemsets from their last item on. wanted: bounds of the last items."""
    item, parent, count = tree
    if wanted is None and all(p == k - 1 for k, p in enumerate(parent)):  # one chain: the deepest item of a subset has its support
        n = next((k for k, c in enumerate(count) if c < least), len(item))
        for last in range(n):
            for k in range(last + 1):
                for some in combinations(item[:last], k):
                    yield (*suffix, item[last], *reversed(some)), count[last]
        return
    places: dict[int, list[int]] = {}
    for k, x in enumerate(item):
        if wanted is None or wanted[0] <= x <= wanted[1]:
            places.setdefault(x, []).append(k)
    for x, at in places.items():
        support = sum(count[k] for k in at)
        if support < least:
            continue
        own = (*suffix, x)
        yield own, support
        bases, within = [], {}
        for k in at:
            base, up = [], parent[k]
            while up >= 0:
                base.append(item[up])
                up = parent[up]
            bases.append(base)
            for y in base:
                within[y] = within.get(y, 0) + count[k]
        kept = [[y for y in reversed(base) if within[y] >= least] for base in bases]
        if any(kept):
            yield from grown(array_tree(kept, [count[k] for k in at]), least, own)


def _table(found) -> pa.Table:
    ranks, supports = zip(*found, strict=True) if (found := list(found)) else ((), ())
    return pa.table({"ranks": pa.array([list(x) for x in ranks], pa.list_(pa.int64())), "support": pa.array(supports, pa.int64())})


# As Spark jobs ---------------------------------------------------------------------------------------------------


def projections(base: DataFrame, min_support: int) -> tuple[DataFrame, DataFrame]:
    """(id, prefix, w) without the items that are infrequent in their projection, equal prefixes merged, and (id, rank, support) of those that
    are frequent. base: (id, prefix, w); its prefixes are ascending ranks."""
    cells = base.select("id", F.explode("prefix").alias("rank"), "w")
    inside = materialize(cells.groupBy("id", "rank").agg(F.sum("w").alias("support")).filter(F.col("support") >= min_support))
    keep = inside.groupBy("id").agg(F.collect_list("rank").alias("keep"))  # a projection's items
    x = base.join(keep, "id").select("id", F.array_intersect("prefix", "keep").alias("prefix"), "w").filter(F.size("prefix") > 0)
    return materialize(x.groupBy("id", "prefix").agg(F.sum("w").alias("w"))), inside


def shapes(pruned: DataFrame) -> DataFrame:
    """(id, cells, chain): the size of each projection and whether it is a single path: all its prefixes begin its longest one."""
    longest = pruned.groupBy("id").agg(F.max_by("prefix", F.size("prefix")).alias("longest"), F.sum(F.size("prefix")).alias("cells"))
    on_it = F.col("prefix") == F.slice("longest", F.lit(1), F.size("prefix"))
    return pruned.join(longest, "id").groupBy("id").agg(F.first("cells").alias("cells"), F.bool_and(on_it & (F.size("longest") <= MOST_CHAIN)).alias("chain"))


def chain_subsets(chains: DataFrame) -> DataFrame:
    """(ranks, support): a suffix with every subset of a chain. chains: (suffix, items, counts), counts descending along the chain.

    The subsets are numbered by the bits of their items, and first dealt out by their deepest item, whose count is their support.
    """
    x = chains.select("suffix", "items", F.posexplode("counts").alias("last", "support"))
    x = x.withColumn("high", F.expr("explode(sequence(0L, shiftleft(1L, last - least(last, 16)) - 1))"))
    x = x.repartition(x.sparkSession.sparkContext.defaultParallelism, "suffix", "last", "high")
    x = x.withColumn("low", F.expr("explode(sequence(0L, shiftleft(1L, least(last, 16)) - 1))"))
    mask = F.expr("shiftleft(high, least(last, 16)) + low")
    some = F.expr("filter(slice(items, 1, last), (v, k) -> bit_get(mask, k) = 1)")
    return x.withColumn("mask", mask).select(F.concat("suffix", F.array(F.element_at("items", F.col("last") + 1)), some).alias("ranks"), "support")


def _grow(base: DataFrame, suffixes: DataFrame, min_support: int, local_cells: int) -> list[DataFrame]:
    """Tables of (ranks, support): all itemsets that extend the suffixes (id, suffix). base: (id, prefix, w)."""
    out = []
    while True:
        pruned, inside = projections(base, min_support)
        release(base)
        shape = materialize(shapes(pruned))
        named = lambda x: x.join(suffixes, "id")
        chained = inside.join(shape.filter("chain").select("id"), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "support"))).alias("c"))
        chained = named(chained).select("suffix", F.col("c.rank").alias("items"), F.col("c.support").alias("counts"))

        def alone(key, rows):
            found = grown(array_tree(rows["prefix"].to_pylist(), rows["w"].to_pylist()), min_support, tuple(key[1].as_py()))
            return _table(found)

        small = pruned.join(shape.filter((F.col("cells") <= local_cells) & ~F.col("chain")).select("id"), "id")
        out.append(materialize(chain_subsets(chained).unionAll(named(small).groupBy("id", "suffix").applyInArrow(alone, _FOUND))))
        large = shape.filter((F.col("cells") > local_cells) & ~F.col("chain")).select("id")
        if large.isEmpty():
            release(pruned, inside, shape, suffixes)
            return out
        longer = materialize(named(inside.join(large, "id")).select("id", "rank", "support", F.concat("suffix", F.array("rank")).alias("suffix"), F.monotonically_increasing_id().alias("new")))
        out.append(materialize(longer.select(F.col("suffix").alias("ranks"), "support")))
        deeper = pruned.join(large, "id").select("id", "prefix", "w", F.posexplode("prefix").alias("p", "rank")).filter("p > 0")
        deeper = deeper.join(longer.select("id", "rank", "new"), ["id", "rank"]).select(F.col("new").alias("id"), F.expr("slice(prefix, 1, p)").alias("prefix"), "w")
        base = materialize(deeper.groupBy("id", "prefix").agg(F.sum("w").alias("w")))
        release(pruned, inside, shape, suffixes)
        suffixes = materialize(longer.select(F.col("new").alias("id"), "suffix"))
        release(longer)


def _named(tables: list[DataFrame], ranks: DataFrame) -> DataFrame:
    """(itemset, support) of (ranks, support)."""
    singles = ranks.select(F.array("rank").alias("ranks"), "support")
    found = reduce(DataFrame.unionByName, tables, singles).withColumnRenamed("ranks", "items")
    out = materialize(itemsets_of(found, ranks))
    release(ranks, *tables)
    return out


def mine_growth(frame: DataFrame, min_support: int, items: str = "items", tid: str | None = None, local_cells: int = LOCAL_CELLS, weight: str | None = None) -> DataFrame:
    """(itemset, support) as mine_mllib, by conditional projections of Spark jobs, each of at most local_cells in one task."""
    paths, ranks = merged_paths(frame, check_support(min_support), items, tid, weight)
    base = materialize(states(paths).filter(F.size("prefix") > 0))
    release(paths)
    suffixes = materialize(ranks.select(F.col("rank").alias("id"), F.array("rank").alias("suffix")))
    return _named(_grow(base, suffixes, min_support, local_cells), ranks)


def item_groups(paths: DataFrame, groups: int) -> DataFrame:
    """(rank, cells, grp): the items dealt to groups by rank, cut at equal shares of their cost: cells, an item with all that precedes it
    on its paths. No group costs more than its share and its last item."""
    cost = paths.select(F.posexplode(F.transform("path", lambda s: s["rank"])).alias("p", "rank")).groupBy("rank").agg(F.sum(F.col("p") + 1).alias("cells"))
    x = running_sums(cost, [F.asc("rank")], "cells", "before")
    total = cost.agg(F.coalesce(F.sum("cells"), F.lit(1)).alias("total")).first().total
    return x.select("rank", "cells", F.floor(F.col("before") * groups / total).cast("int").alias("grp"))


def group_paths(paths: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """(grp, prefix, w): each path once for each group (grp, least rank, largest rank) that has an item on it, up to the last such item.

    Groups are ranges of ranks and paths ascend, so no shuffle is needed but to merge equal prefixes.
    """
    starts = F.array(*[F.lit(lo) for _, lo, _ in bounds])
    numbers = F.array(*[F.lit(g) for g, _, _ in bounds])
    ranks = F.transform("path", lambda s: s["rank"])
    x = paths.select("w", ranks.alias("prefix")).withColumn("of", F.transform("prefix", lambda r: F.size(F.filter(starts, lambda lo: lo <= r))))
    ends = F.expr("filter(sequence(1, size(prefix)), k -> k = size(prefix) or of[k] <> of[k - 1])")
    x = x.select("prefix", "of", "w", F.explode(ends).alias("k"))
    x = x.select(F.get(numbers, F.element_at("of", F.col("k")) - 1).alias("grp"), F.slice("prefix", F.lit(1), F.col("k")).alias("prefix"), "w")
    return x.groupBy("grp", "prefix").agg(F.sum("w").alias("w"))


def _bounds(groups: DataFrame) -> list[tuple[int, int, int]]:
    """(grp, least rank, largest rank), one for each group."""
    return [tuple(r) for r in groups.groupBy("grp").agg(F.min("rank"), F.max("rank")).orderBy("grp").collect()]


def group_sizes(shards: DataFrame) -> DataFrame:
    """(grp, paths, cells): what each group holds."""
    return shards.groupBy("grp").agg(F.count("*").alias("paths"), F.sum(F.size("prefix")).alias("cells"))


def mine_groups(frame: DataFrame, min_support: int, items: str = "items", tid: str | None = None, groups: int = 32, local_cells: int = LOCAL_CELLS, weight: str | None = None) -> DataFrame:
    """(itemset, support) as mine_mllib, from groups of items, each mined alone by one task from its own array tree.

    What a group holds is counted first: one of over local_cells isn't given to a task, but its items' projections go to mine_growth's jobs.
    """
    paths, ranks = merged_paths(frame, check_support(min_support), items, tid, weight)
    bounds = _bounds(item_groups(paths, groups))
    shards = materialize(group_paths(paths, bounds)) if bounds else None
    if shards is None:
        return _named([], ranks)
    small = {r.grp for r in group_sizes(shards).filter(F.col("cells") <= local_cells).select("grp").collect()}
    ranges = {g: (lo, hi) for g, lo, hi in bounds}

    def alone(key, rows):
        tree = array_tree(rows["prefix"].to_pylist(), rows["w"].to_pylist())
        return _table(x for x in grown(tree, min_support, wanted=ranges[key[0].as_py()]) if len(x[0]) > 1)

    tables = [materialize(shards.filter(F.col("grp").isin(sorted(small))).groupBy("grp").applyInArrow(alone, _FOUND))]
    if left := [(lo, hi) for g, (lo, hi) in ranges.items() if g not in small]:
        theirs = reduce(lambda a, b: a | b, [F.col("id").between(lo, hi) for lo, hi in left])
        base = materialize(states(paths).filter(theirs & (F.size("prefix") > 0)))
        tables += _grow(base, materialize(ranks.select(F.col("rank").alias("id"), F.array("rank").alias("suffix")).filter(theirs)), min_support, local_cells)
    release(paths, shards)
    return _named(tables, ranks)
