"""Frequent itemsets: mine(frame, min_support) -> (itemset, support), by one of four engines.

`mllib` is Spark's parallel FP-Growth (Li et al., PFP, 2008), which groups conditional transactions by item in one shuffle.
`levels` grows itemsets level by level on weighted paths with DataFrame operators only; its steps are public here.
`growth` and `groups` (operators/growth.py) project the paths on suffixes, or deal them to groups of items, until a task can mine each part alone.
All give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize, release, running_sums
from tallyloom.operators.itemsets import canonical
from tallyloom.operators.items import check_support, relative_support
from tallyloom.operators.paths import BROADCAST_ITEMS, merged_paths, states

#: Up to so many itemsets of a level (three numbers each) are broadcast to its states.
BROADCAST_ITEMSETS = 200_000
#: Items in the states of a level that are made at once (8 bytes each).
CHUNK_CELLS = 2_000_000_000
#: Items of the transactions in a partition of Spark's miner (some 10 to 20 bytes each in memory), and equal transactions that are dealt out together.
TASK_CELLS, PIECE = 4_000_000, 1_000
#: Items of a single path at most (their subsets are numbered in 60 bits), and of one step.
MOST_CHAIN, CHAIN_STEP = 60, 15


def _empty(frame: DataFrame, items: str) -> DataFrame:
    return frame.select(F.col(items).alias("itemset"), F.lit(0).cast("long").alias("support")).limit(0)


def mine_mllib(frame: DataFrame, min_support: int, items: str = "items", partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Itemsets in at least min_support transactions (sets: repeated items count once; null arrays don't count).

    The miner has no weights and keeps its transactions in memory: it gets each as the ranks of its frequent items, in as many partitions as
    there are TASK_CELLS of them, whatever the partitions of the input. partitions: groups of conditional transactions. weight: a column that says
    how many transactions a row stands for.
    """
    check_support(min_support)
    found, ranks = merged_paths(frame, min_support, items, weight=weight)
    n, cells = found.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("w") * F.size("path")), F.lit(0))).first()
    if not n:
        release(found, ranks)
        return _empty(frame, items)
    least = max(found.sparkSession.sparkContext.defaultParallelism, -(-cells // TASK_CELLS))
    miner = FPGrowth(itemsCol="items", minSupport=relative_support(min_support, n), numPartitions=partitions or least)
    model = miner.fit(repeated(found.select(F.transform("path", lambda s: s["rank"].cast("int")).alias("items"), "w"), least))
    out = materialize(itemsets_of(model.freqItemsets.select("items", F.col("freq").alias("support")), ranks))
    release(found, ranks)
    return out


def repeated(sets: DataFrame, n: int) -> DataFrame:
    """(items): each of (items, w) w times, in n partitions. They are dealt out in pieces of at most PIECE, so a frequent set is in many partitions."""
    x = sets.select("items", "w", F.explode(F.expr(f"sequence(0L, w - 1, {PIECE}L)")).alias("at"))
    x = x.select("items", F.least(F.lit(PIECE), F.col("w") - F.col("at")).alias("k")).repartition(n)
    return x.select("items", F.explode(F.expr("sequence(1L, k)")).alias("_")).select("items")


def candidates(state: DataFrame) -> DataFrame:
    """(parent, rank, p, w): every extension of a state (id, prefix, w) by an item nearer to the root of its path, with the number of items before it.

    Each itemset is made in one order only, as its parent's id and one more rank. The prefixes stay behind until it is known to be frequent.
    """
    return state.select(F.col("id").alias("parent"), F.posexplode("prefix").alias("p", "rank"), "w").select("parent", "rank", "p", "w")


def supported(candidates: DataFrame, min_support: int) -> DataFrame:
    """(parent, rank, support, cells) of the candidates that reach min_support; sums are made before the shuffle.

    cells: how many items the states of the itemset hold, before equal ones are merged.
    """
    x = candidates.groupBy("parent", "rank").agg(F.sum("w").alias("support"), F.sum("p").alias("cells"))
    return x.filter(F.col("support") >= min_support)


def next_states(state: DataFrame, found: DataFrame, n: int | None = None) -> DataFrame:
    """(id, prefix, w): those extensions of the states that can grow and whose itemset was found (id, parent, rank), n of them; equal ones are one."""
    near = found.select("id", "parent", "rank")
    near = F.broadcast(near) if (found.count() if n is None else n) <= BROADCAST_ITEMSETS else near
    x = state.select(F.col("id").alias("parent"), "prefix", "w", F.posexplode("prefix").alias("p", "rank")).filter("p > 0").join(near, ["parent", "rank"])
    return x.select("id", F.expr("slice(prefix, 1, p)").alias("prefix"), "w").groupBy("id", "prefix").agg(F.sum("w").alias("w"))


def decode(found: DataFrame, shorter: DataFrame, ranks: DataFrame, n_ranks: int | None = None) -> DataFrame:
    """(id, items, support): itemsets (id, parent, rank, support) of a level with their items, from those of the level before."""
    near = F.broadcast(ranks) if (ranks.count() if n_ranks is None else n_ranks) <= BROADCAST_ITEMS else ranks
    x = found.join(near.select("rank", "item"), "rank").join(shorter.select(F.col("id").alias("parent"), "items"), "parent")
    return x.select(found["id"], F.concat("items", F.array("item")).alias("items"), "support")


def decode_pointers(pointers: DataFrame, item: str = "item") -> DataFrame:
    """pointers with `items`, those from the root of each row on. pointers: id, parent (an id, null for a root) and an item, of any depths.

    Every round doubles how far each row has come, so the rounds are the logarithm of the greatest depth. An unknown parent and a
    cycle (more steps than there are distinct items) are errors; the items of one row are distinct.
    """
    told = materialize(pointers)
    lost = told.filter("parent is not null").join(told.select(F.col("id").alias("parent")), "parent", "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"a parent that isn't there: {lost.first().parent}")
    most, steps = told.select(item).distinct().count(), 1
    now = told.select("id", F.col("parent").alias("up"), F.array(item).alias("items"))
    while not (open_ := now.filter("up is not null")).isEmpty():
        if steps > most:
            raise ValueError("the parents of some rows go round in a cycle")
        above = now.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("items").alias("before"))
        x = open_.join(above, "up").select("id", F.col("further").alias("up"), F.concat("before", "items").alias("items"))
        last, now = now, materialize(now.filter("up is null").unionByName(x))
        release(last)
        steps *= 2
    out = materialize(told.join(now.select("id", "items"), "id"))
    release(told, now)
    return out


def mine_levels(frame: DataFrame, min_support: int, items: str = "items", tid: str | None = None, max_size: int | None = None, chunk_cells: int = CHUNK_CELLS, weight: str | None = None) -> DataFrame:
    """As mine_mllib, by levels: the states of a level are those extensions whose itemset is frequent.

    A level's candidates are counted before any of its states are made. States are written to the shared folder, so that lineage stays short and
    lost executors do no harm; if a level's would hold over chunk_cells items, its itemsets are cut into chunks of about as many, and each is
    followed to its end before the next one's states are made. So the states on disk are chunk_cells a level at most, but for an itemset that alone has more.
    Itemsets are pointers to their parents, and decoded once at the end. The driver sees counts only.
    """
    check_support(min_support)
    found, ranks = merged_paths(frame, min_support, items, tid, weight)
    named = lambda step, i: F.struct(F.lit(step).alias("step"), i.alias("i"))
    first = materialize(states(found).filter(F.size("prefix") > 0).withColumn("id", named(0, F.col("id"))))
    release(found)
    single = ranks.select(named(0, F.col("rank")).alias("id"), "rank", "support")
    levels = [single.select("id", F.lit(None).cast(single.schema["id"].dataType).alias("parent"), "rank", "support")]

    def follow(state: DataFrame, size: int) -> None:
        if max_size is not None and size >= max_size:
            release(state)
            return
        found = supported(candidates(state), min_support).withColumn("id", named(len(levels), F.monotonically_increasing_id()))
        found = materialize(found)
        n, cells = found.agg(F.count("*"), F.coalesce(F.sum("cells"), F.lit(0))).first()
        levels.append(found)
        chunks = -(-cells // chunk_cells)
        if chunks > 1:
            numbered = materialize(running_sums(found.filter("cells > 0"), [F.asc("id")], "cells", "before").withColumn("chunk", F.floor(F.col("before") / chunk_cells)))
            parts = [(numbered.filter(F.col("chunk") == r.chunk), r.n) for r in numbered.groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]
        else:
            numbered, parts = None, [(found.filter("cells > 0"), n)] if chunks else []
        while parts:
            some, many = parts.pop()
            deeper = materialize(next_states(state, some, many))
            if not parts:
                release(state, numbered)
            follow(deeper, size + 1)
        release(state, numbered)

    follow(first, 1)
    pointers = reduce(DataFrame.unionByName, [x.select("id", "parent", "rank", "support") for x in levels])
    whole = decode_pointers(pointers, "rank")
    out = materialize(itemsets_of(whole.select("items", "support"), ranks))
    release(ranks, whole, *levels)
    return out


def itemsets_of(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """(itemset, support) of (items: ranks, support). Ranks are numbers from 1 without a gap, so their items are an array if they are few."""
    if ranks.count() <= BROADCAST_ITEMS:
        names = ranks.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("names"), F.lit(1).alias("one"))
        x = found.withColumn("one", F.lit(1)).join(F.broadcast(names), "one")  # one row
        x = x.select(F.transform("items", lambda r: F.get("names", (r - 1).cast("int"))).alias("itemset"), "support")
    else:
        x = materialize(found.withColumn("set_", F.monotonically_increasing_id())).select("set_", "support", F.explode("items").alias("rank"))
        x = x.join(ranks.select("rank", "item"), "rank").groupBy("set_", "support").agg(F.collect_list("item").alias("itemset"))
    return x.select(canonical(F.col("itemset")).alias("itemset"), "support")


def mine(frame: DataFrame, min_support: int, items: str = "items", engine: str = "mllib", **options) -> DataFrame:
    """(itemset, support): every non-empty set of items that at least min_support transactions hold. Row order is free.

    engine: mllib (Spark's), levels, growth or groups; all give the same rows. weight, of all engines: a column that says how many transactions a row
    stands for, so that sets merged once serve several of them.
    """
    from tallyloom.operators import growth

    engines = {"mllib": mine_mllib, "levels": mine_levels, "growth": growth.mine_growth, "groups": growth.mine_groups}
    return engines[engine](frame, min_support, items, **options)


def power_set(chain: DataFrame, min_support: int) -> DataFrame:
    """(itemset, support) of a tree that is a single path: every subset of its items, supported by the least count in it.

    chain: rows (items array, counts array), of at most MOST_CHAIN items each, or it is an error: their subsets wouldn't fit anywhere. Subsets are
    dealt to all tasks by their first CHAIN_STEP items, and made by steps of as many.
    """
    n = F.size("items")
    x = chain.select("items", "counts", F.when(n > MOST_CHAIN, F.raise_error(F.lit(f"a single path of over {MOST_CHAIN} items"))).otherwise(F.lit(0)).cast("long").alias("mask"))
    for low in range(0, MOST_CHAIN, CHAIN_STEP):
        bits = F.greatest(F.lit(0), F.least(F.lit(CHAIN_STEP), n - low))
        x = x.select("items", "counts", "mask", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), bits).cast("long") - 1)).alias("part"))
        x = x.select("items", "counts", (F.col("mask") + F.shiftleft("part", low)).alias("mask"))
        x = x if low else x.repartition(x.sparkSession.sparkContext.defaultParallelism)
    pick = lambda c: F.filter(c, lambda v, k: F.col("mask").bitwiseAND(F.pow(F.lit(2), k).cast("long")) > 0)
    x = x.filter("mask > 0").select(canonical(pick("items")).alias("itemset"), F.array_min(pick("counts")).cast("long").alias("support"))
    return x.filter(F.col("support") >= check_support(min_support))


def rules(itemsets: DataFrame, min_confidence: float, n: int | None = None) -> DataFrame:
    """Extension: (antecedent, consequent, support, confidence[, lift]) with one consequent item, from mined itemsets."""
    x = itemsets.filter(F.size("itemset") > 1).select("itemset", "support", F.explode("itemset").alias("consequent"))
    x = x.withColumn("antecedent", F.array_except("itemset", F.array("consequent")))
    sub = itemsets.select(F.col("itemset").alias("antecedent"), F.col("support").alias("base"))
    x = x.join(sub, "antecedent").withColumn("confidence", F.col("support") / F.col("base")).filter(F.col("confidence") >= min_confidence)
    cols = ["antecedent", "consequent", "support", "confidence"]
    if n:
        one = itemsets.filter(F.size("itemset") == 1).select(F.col("itemset")[0].alias("consequent"), F.col("support").alias("own"))
        x, cols = x.join(one, "consequent").withColumn("lift", F.col("confidence") * n / F.col("own")), [*cols, "lift"]
    return x.select(*cols)
