"""The registered queries of the mining engine and their SQL.

Baskets: B1 the brands of an order, B2 the kinds of event of a user on a day, B3 five attributes of a line item. Thresholds are
absolute counts, set as a share of the number of baskets so that they fit every size of the tables.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize, scratch_path
from tallyloom.operators import encode, growth, items, itemsets, mine, paths, stored_tree, validation
from tallyloom.sources import baskets as src
from tallyloom.sources import sinks
from tallyloom.sources.basket_format import register


def _once(basket):
    """The basket's rows, written: thresholds, ranks and mining read them several times."""
    return lambda spark, sf_dir: materialize(basket(spark, sf_dir))


B1, B2, B3 = _once(src.order_brands), _once(src.user_days), _once(src.line_attribute_sets)
L1 = "SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
L2 = "SELECT DISTINCT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS tid, event_type AS item FROM events"
L3 = """SELECT tid, unnest(['rf=' || l_returnflag, 'ls=' || l_linestatus, 'disc=' || round(l_discount * 100)::INT::VARCHAR,
 'tax=' || round(l_tax * 100)::INT::VARCHAR, 'ln=' || l_linenumber::VARCHAR]) AS item FROM (SELECT row_number() OVER () AS tid, * FROM lineitem)"""

#: One in so many baskets must hold an itemset.
SHARE = {"b1": 100, "b1_low": 250, "b2": 20, "b2_low": 200, "b3": 30}


def threshold(basket, share: int) -> int:
    """basket: (tid, item), or (items, w) of one row for w transactions."""
    n = basket.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0] if "w" in basket.columns else basket.select("tid").distinct().count()
    return max(2, n // share)


def sets(basket):
    return basket if "items" in basket.columns else src.baskets(basket)


def shown(found):
    return found.select(itemsets.item_string(F.col("itemset")).alias("itemset"), "support")


def _mined(basket, share, engine):
    def query(spark, sf_dir):
        long = basket(spark, sf_dir)
        return shown(mine.mine(sets(long), threshold(long, share), engine=engine, weight="w" if "w" in long.columns else None))

    return query


def _sql(long: str, share: int, rest: str) -> str:
    return f"WITH RECURSIVE long AS ({long}),\nthr AS (SELECT greatest(2, count(DISTINCT tid) // {share}) AS m FROM long),\n{rest}"


def _eclat(long: str, share: int, tail: str = "SELECT array_to_string(items, ' ') AS itemset, len(tids)::BIGINT AS support FROM r") -> str:
    return _sql(long, share, f"""f AS (SELECT item, list(DISTINCT tid) AS tids FROM long GROUP BY item HAVING count(DISTINCT tid) >= (SELECT m FROM thr)),
r AS (SELECT [item] AS items, item AS last, tids FROM f
 UNION ALL SELECT list_append(r.items, f.item), f.item, list_intersect(r.tids, f.tids) FROM r JOIN f ON f.item > r.last
 WHERE len(list_intersect(r.tids, f.tids)) >= (SELECT m FROM thr))
{tail}""")  # fmt: skip


_RANKS = """fi AS (SELECT item, count(*) AS support FROM long GROUP BY item HAVING count(*) >= (SELECT m FROM thr)),
rk AS (SELECT item, support, row_number() OVER (ORDER BY support DESC, item) AS rank FROM fi),
tx AS (SELECT tid, list(item ORDER BY rank) AS path FROM long JOIN rk USING (item) GROUP BY tid),
wp AS (SELECT path, count(*) AS w FROM tx GROUP BY path),
"""
_NODES = _RANKS + """nd AS (SELECT path[1:k] AS prefix, path[k] AS item, k AS depth, sum(w)::BIGINT AS support FROM (SELECT path, w, unnest(range(1, len(path) + 1)) AS k FROM wp) GROUP BY ALL),
"""  # fmt: skip


#: Baskets of the tree queries, by the end of their names: rows, share, item whose conditional tree is shown (None: the last by rank).
TREES = {"": (B2, SHARE["b2"], "purchase"), "_brands": (B1, SHARE["b1"], None)}


class _Tree:
    """A basket's weighted paths and tree nodes, its threshold and its item."""

    def __init__(self, spark, sf_dir, of):
        basket, share, item = TREES[of]
        self.long = basket(spark, sf_dir)
        self.least = threshold(self.long, share)
        ranks = materialize(paths.ranked_items(self.long, self.least))
        self.item = item if item is not None else ranks.orderBy(F.desc("rank")).first()["item"]
        self.paths = materialize(paths.weighted(paths.filtered(self.long, ranks)))
        self.nodes = paths.nodes(self.paths)


def item_support(spark, sf_dir):
    return items.item_support(src.order_brands(spark, sf_dir))


def frequent_items(spark, sf_dir):
    long = B1(spark, sf_dir)
    return items.frequent_items(long, threshold(long, 25))


def dense_histogram(spark, sf_dir):
    return items.dense_histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber"), 16, "l_linenumber")


def item_rank(spark, sf_dir):
    long = B1(spark, sf_dir)
    return items.ranked(items.frequent_items(long, threshold(long, 25)))


def distinct_item_count(spark, sf_dir):
    return items.distinct_items(src.order_brands(spark, sf_dir))


def _part_cells(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row"), F.lit(0).alias("col"), F.col("p_brand").alias("item"))


def dictionary_first_seen(spark, sf_dir):
    return encode.first_seen(_part_cells(spark, sf_dir), ["row", "col"])


def _encoded(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    cells = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("p_brand").alias("item"))
    return encode.encode(cells, encode.first_seen(cells, ["row", "col"]))


def dictionary_encoded(spark, sf_dir):
    return _encoded(spark, sf_dir).select("tid", F.array_join(F.col("items").cast("array<string>"), " ").alias("items"))


def dense_rerank(spark, sf_dir):
    return encode.dense_rerank(_part_cells(spark, sf_dir))


def one_hot(spark, sf_dir):
    """A column for each kind of event that the table holds."""
    return encode.one_hot(B2(spark, sf_dir))


def one_hot_sparse(spark, sf_dir):
    """The brands of each order as places in the ascending list of all."""
    x = encode.one_hot_sparse(B1(spark, sf_dir))
    return x.select("tid", "size", F.array_join(F.col("indices").cast("array<string>"), " ").alias("indices"))


def inserted_tree(spark, sf_dir):
    """The tree of the orders' brands, in three batches of orders merged one after the other, with its leaves."""
    long = B1(spark, sf_dir)
    ranks = materialize(paths.ranked_items(long, threshold(long, SHARE["b1"])))
    path = scratch_path(spark)
    for k in range(3):
        stored_tree.insert(spark, path, paths.weighted(paths.filtered(long.filter(F.col("tid") % 3 == k), ranks)))
    return stored_tree.stored(spark, path).select(paths.path_string("prefix").alias("prefix"), "item", "depth", "support", "leaf")


def filtered_transactions(spark, sf_dir):
    long = B1(spark, sf_dir)
    got = paths.filtered(long, paths.ranked_items(long, threshold(long, 25)))
    return got.select("tid", paths.path_string("path").alias("path"))


def weighted_paths(spark, sf_dir, of=""):
    return _Tree(spark, sf_dir, of).paths.select(paths.path_string("path").alias("path"), "w")


def tree_nodes(spark, sf_dir, of=""):
    return _Tree(spark, sf_dir, of).nodes.select(paths.path_string("prefix").alias("prefix"), "item", "depth", "support")


def leaf_nodes(spark, sf_dir, of=""):
    return paths.leaves(_Tree(spark, sf_dir, of).nodes).select(paths.path_string("prefix").alias("prefix"), "support")


def flat_tree(spark, sf_dir, of=""):
    """The nodes by their places in depth-first order, with their parents' places."""
    return paths.flat(_Tree(spark, sf_dir, of).nodes).drop("prefix")


def decoded_tree(spark, sf_dir, of=""):
    """The flat tree's nodes with the items from the root on, found by their parents' places."""
    x = paths.flat(_Tree(spark, sf_dir, of).nodes).select(F.col("pos").alias("id"), F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"), "item")
    return mine.decode_pointers(x).select(F.col("id").alias("pos"), F.array_join("items", " ").alias("prefix"))


def header_table(spark, sf_dir, of=""):
    return paths.header(_Tree(spark, sf_dir, of).nodes)


def tree_stats(spark, sf_dir, of=""):
    return paths.tree_stats(_Tree(spark, sf_dir, of).nodes)


def tree_print(spark, sf_dir, of=""):
    """The whole tree as text, a line a node."""
    return paths.tree_lines(_Tree(spark, sf_dir, of).nodes)


def conditional_pattern_base(spark, sf_dir, of=""):
    tree = _Tree(spark, sf_dir, of)
    return paths.pattern_base(tree.paths, tree.item).select(paths.path_string("base").alias("base"), "w")


def conditional_tree(spark, sf_dir, of=""):
    tree = _Tree(spark, sf_dir, of)
    return paths.conditional_paths(tree.paths, tree.item, tree.least).select(paths.path_string("path").alias("path"), "w")


def conditional_tree_local(spark, sf_dir, of=""):
    tree = _Tree(spark, sf_dir, of)
    return paths.local_conditional_paths(tree.paths, tree.item, tree.least).select(paths.path_string("path").alias("path"), "w")


def candidate_offsets(spark, sf_dir, of=""):
    return paths.offsets(_Tree(spark, sf_dir, of).nodes).select(paths.path_string("prefix").alias("prefix"), F.col("start").cast("long").alias("start"))


def balanced_work(spark, sf_dir, of=""):
    """Nodes dealt to eight partitions of equal cost: how many each has, and what they cost."""
    x = paths.balanced(_Tree(spark, sf_dir, of).nodes, 8).groupBy(F.spark_partition_id().cast("long").alias("part"))
    return x.agg(F.count("*").alias("nodes"), F.sum(F.col("depth") - 1).alias("cost"))


def item_groups(spark, sf_dir, of=""):
    """Items dealt to eight groups: each one's rank, cost and group."""
    return growth.item_groups(_Tree(spark, sf_dir, of).paths, 8).select("rank", "cells", F.col("grp").cast("long").alias("grp"))


def group_sizes(spark, sf_dir, of=""):
    """What each of eight groups holds: distinct paths, with what precedes its items, and their items."""
    found = _Tree(spark, sf_dir, of).paths
    bounds = growth._bounds(growth.item_groups(found, 8))
    return growth.group_sizes(growth.group_paths(found, bounds)).select(F.col("grp").cast("long").alias("grp"), "paths", "cells")


_TREE_QUERIES = (
    weighted_paths, tree_nodes, leaf_nodes, flat_tree, decoded_tree, header_table, tree_stats, tree_print, conditional_pattern_base,
    conditional_tree, conditional_tree_local, candidate_offsets, balanced_work, item_groups, group_sizes,
)


def candidate_pairs(spark, sf_dir):
    long = B1(spark, sf_dir)
    m = threshold(long, SHARE["b1"])
    ranks = materialize(paths.ranked_items(long, m))
    return shown(_level(long, ranks, m, 2)[2].select(itemsets.canonical(F.col("items")).alias("itemset"), "support"))


def _level(long, ranks, m, size):
    """(itemsets of the level before, those of the level by their parents, the same with their items)."""
    state = materialize(paths.states(paths.weighted(paths.filtered(long, ranks))))
    found, decoded = None, ranks.select(F.col("rank").alias("id"), F.array("item").alias("items"), "support")
    for k in range(2, size + 1):
        found = materialize(mine.supported(mine.candidates(state), m).withColumn("id", F.monotonically_increasing_id()))
        shorter, decoded = decoded, mine.decode(found, decoded, ranks)
        state = materialize(mine.next_states(state, found)) if k < size else None
    return shorter, found, decoded


def parent_pointers(spark, sf_dir):
    """Itemsets of three as their parent and one more item."""
    long = B2(spark, sf_dir)
    m = threshold(long, SHARE["b2_low"])
    ranks = materialize(paths.ranked_items(long, m))
    shorter, found, _ = _level(long, ranks, m, 3)
    up = shorter.select(F.col("id").alias("parent"), itemsets.item_string(F.col("items")).alias("parent_items"))
    return found.join(up, "parent").join(ranks.select("rank", "item"), "rank").select("parent_items", "item", "support")


def decoded_itemsets(spark, sf_dir):
    """The same, decoded."""
    long = B2(spark, sf_dir)
    m = threshold(long, SHARE["b2_low"])
    got = _level(long, materialize(paths.ranked_items(long, m)), m, 3)[2]
    return shown(got.select(F.col("items").alias("itemset"), "support"))


def event_itemsets_grouped(spark, sf_dir):
    """Mined in eight groups of conditional transactions."""
    long = B2(spark, sf_dir)
    return shown(mine.mine(src.split_evenly(sets(long), 8), threshold(long, SHARE["b2_low"]), partitions=8))


def dealt_transactions(spark, sf_dir):
    """Transactions dealt evenly over eight partitions: how many there are, and whether none has over a hundredth more than its share."""
    dealt = src.split_evenly(sets(B2(spark, sf_dir)), 8).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    x = dealt.agg(F.count("*").alias("parts"), F.sum("n").alias("transactions"), F.max("n").alias("most"))
    return x.select("parts", "transactions", (F.col("most") <= F.col("transactions") / 8 * 1.01 + 8).alias("even"))


#: Lines of text made from the orders: the suppliers of an order's lines, in one of eight forms by the order's number.
_A = "array_join(a, ' ')"
LINE = f"""CASE l_orderkey % 8 WHEN 0 THEN '# ' || {_A} WHEN 1 THEN '  ' WHEN 2 THEN '  ' || array_join(a, '\\t ')
 WHEN 3 THEN array_join(slice(a, 1, 2), ' ') || ' x ' || {_A} WHEN 4 THEN {_A} || ' 99999999999999999999 7' WHEN 5 THEN '+' || array_join(a, ' -')
 WHEN 6 THEN {_A} || 'abc 4' ELSE {_A} END"""


def _written(lines):
    lines.write.text(path := scratch_path(lines.sparkSession))
    return path


def _order_lines(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    by_place = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    found = line.groupBy("l_orderkey").agg(F.transform(by_place, lambda s: s["l_suppkey"].cast("string")).alias("a"))
    return found.select("l_orderkey", F.expr(LINE).alias("value"))


def _joined(items_):
    return F.array_join(F.col(items_).cast("array<string>"), " ").alias("items")


def _how_often(transactions):
    return transactions.select(_joined("items")).groupBy("items").agg(F.count("*").alias("n"))


def transaction_scan(spark, sf_dir):
    return _how_often(src.read_transactions(spark, _written(_order_lines(spark, sf_dir).select("value"))))


def transaction_scan_all_lines(spark, sf_dir):
    return _how_often(src.read_transactions(spark, _written(_order_lines(spark, sf_dir).select("value")), skip_comments=False))


def token_scan(spark, sf_dir):
    return _how_often(src.read_text_transactions(spark, _written(_order_lines(spark, sf_dir).select("value"))))


def basket_format(spark, sf_dir):
    """Orders written and read by the data source `baskets`, in splits of 10,000 bytes: every line once."""
    register(spark)
    path = scratch_path(spark).removeprefix("file:")
    orders = _order_lines(spark, sf_dir).select(src.parse_items(F.col("value")).alias("items"))
    orders.write.format("baskets").mode("append").save(path)
    return _how_often(spark.read.format("baskets").option("splitBytes", 10_000).load(path))


def csv_baskets(spark, sf_dir):
    """The cells of a CSV line made of each part, some of them quoted, blank or with quotes inside; rows by their first cell, the part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(' ,"'), "p_name", F.lit(', a ""'), "p_brand", F.lit('""" ,,  '), "p_type", F.lit(' ,"'), "p_type", F.lit('"x,"open, '), "p_brand")
    cells = src.read_csv_baskets(spark, _written(part.select(line.alias("value"))))
    own = cells.filter("col = 0").select("row", F.col("item").cast("long").alias("part"))
    return cells.join(own, "row").select("part", "col", "item")


def distinct_itemsets(spark, sf_dir):
    """The itemsets of the orders' lines, whatever the order and repeats of their items; lines with another token have none."""
    lines = spark.read.text(_written(_order_lines(spark, sf_dir).select("value")))
    return itemsets.parse_itemsets(lines).select(itemsets.item_string(F.col("itemset")).alias("itemset"))


def itemset_sink(spark, sf_dir):
    """Dense ids of the kinds of event, mined, written as text with their support and read again."""
    long = B2(spark, sf_dir)
    ids = encode.dense_rerank(long)
    path = scratch_path(spark)
    sinks.write_itemsets(mine.mine(sets(long.join(ids, "item").select("tid", F.col("id").alias("item"))), threshold(long, SHARE["b2_low"])), path, with_support=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


def itemset_sink_parsed(spark, sf_dir):
    long = B2(spark, sf_dir)
    ids = encode.dense_rerank(long)
    path = scratch_path(spark)
    sinks.write_itemsets(mine.mine(sets(long.join(ids, "item").select("tid", F.col("id").alias("item"))), threshold(long, SHARE["b2_low"])), path)
    return itemsets.parse_itemsets(spark.read.text(path)).select(itemsets.item_string(F.col("itemset")).alias("itemset"))


def relabelled_itemsets(spark, sf_dir):
    """Mined as dense ids, shown by their names."""
    long = B2(spark, sf_dir)
    ids = materialize(encode.dense_rerank(long))
    found = mine.mine(sets(long.join(ids, "item").select("tid", F.col("id").alias("item"))), threshold(long, SHARE["b2_low"]), engine="growth")
    return shown(itemsets.relabel(found, ids))


def count_sink(spark, sf_dir):
    path = scratch_path(spark)
    sinks.write_counts(dense_histogram(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def dictionary_sink(spark, sf_dir):
    path = scratch_path(spark)
    sinks.write_dictionary(dictionary_first_seen(spark, sf_dir), path)
    return sinks.read_dictionary(spark, path)


def encoded_sink(spark, sf_dir):
    """Encoded transactions written as text and read again as transactions; how often each occurs."""
    path = scratch_path(spark)
    sinks.write_transactions(_encoded(spark, sf_dir), path)
    return src.read_transactions(spark, path).select(_joined("items")).groupBy("items").agg(F.count("*").alias("n"))


def reranked_transactions(spark, sf_dir):
    """The suppliers of each order's lines, repeats kept, by their place among all suppliers that occur."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    frame = line.groupBy(F.col("l_orderkey").alias("tid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"]).alias("items"))
    return encode.rerank_transactions(frame).select("tid", _joined("items"))


def single_path_subsets(spark, sf_dir):
    """The chain of the line numbers with their counts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber")
    one = li.groupBy("l_linenumber").agg(F.count("*").alias("n"))
    chain = one.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))).alias("c")).select(F.transform("c", lambda s: s["l_linenumber"]).alias("items"), F.transform("c", lambda s: s["n"]).alias("counts"))
    return shown(mine.power_set(chain.filter(F.size("items") > 0), 2))


def itemsets_of_size_2(spark, sf_dir):
    long = B1(spark, sf_dir)
    return shown(itemsets.of_size(mine.mine(sets(long), threshold(long, SHARE["b1"])), 2))


def itemset_size_histogram(spark, sf_dir):
    long = B2(spark, sf_dir)
    return itemsets.size_histogram(mine.mine(sets(long), threshold(long, SHARE["b2_low"])))


def _two(spark, sf_dir):
    long = B2(spark, sf_dir)
    return [mine.mine(sets(long), threshold(long, SHARE[k])) for k in ("b2_low", "b2")]


def threshold_intersect(spark, sf_dir):
    return itemsets.common(*_two(spark, sf_dir)).select(itemsets.item_string(F.col("itemset")).alias("itemset"))


def threshold_except(spark, sf_dir):
    return itemsets.only_in(*_two(spark, sf_dir)).select(itemsets.formatted(F.col("itemset")).alias("itemset"))


def difference_sample(spark, sf_dir):
    return itemsets.sample_of(itemsets.only_in(*_two(spark, sf_dir))).select(itemsets.item_string(F.col("itemset")).alias("itemset"))


def match_score(spark, sf_dir):
    long = B2(spark, sf_dir)
    m, tx = threshold(long, SHARE["b2"]), sets(long)
    return itemsets.match_score(mine.mine(tx, m), mine.mine(tx, m, engine="levels"))


def difference_both_ways(spark, sf_dir):
    """Of itemsets of two and more at a low threshold and all at a high one: what only one of both has."""
    low, high = _two(spark, sf_dir)
    return itemsets.difference(low.filter(F.size("itemset") > 1), high).select("side", itemsets.formatted(F.col("itemset")).alias("itemset"))


def engines_equal(spark, sf_dir):
    """How many itemsets each engine has in common with Spark's miner, by size."""
    tx = B3(spark, sf_dir)
    m = threshold(tx, SHARE["b3"])
    base = mine.mine(tx, m, weight="w")
    each = [itemsets.common(base, mine.mine(tx, m, engine=e, weight="w")).select(F.lit(e).alias("engine"), F.size("itemset").alias("size")) for e in ("levels", "growth", "groups")]
    return reduce(DataFrame.unionAll, each).groupBy("engine", "size").agg(F.count("*").alias("n"))


def thresholds_equal(spark, sf_dir):
    return itemsets.equality(*_two(spark, sf_dir))


def match_score_thresholds(spark, sf_dir):
    """A low threshold's itemsets against a high one's, which has a part of them."""
    return itemsets.match_score(*_two(spark, sf_dir))


def _results(spark, sf_dir):
    """A folder of results: two engines on two thresholds, one engine of which took the wrong threshold once, and an empty result."""
    long = B2(spark, sf_dir)
    ids = encode.dense_rerank(long)
    tx = materialize(sets(long.join(ids, "item").select("tid", F.col("id").alias("item"))))
    low, high = (mine.mine(tx, threshold(long, SHARE[k])) for k in ("b2_low", "b2"))
    folder = scratch_path(spark)
    for name, found in (("low_mllib", low), ("low_levels", mine.mine(tx, threshold(long, SHARE["b2_low"]), engine="levels")), ("high_mllib", high), ("high_levels", low), ("low_none", low.limit(0))):
        sinks.write_itemsets(found, f"{folder}/{name}.txt")
    return validation.compared(validation.read_results(spark, folder), validation.listed(spark, folder), "mllib")


def validation_comparison(spark, sf_dir):
    return _results(spark, sf_dir)


def validation_scores(spark, sf_dir):
    return validation.scores(_results(spark, sf_dir))


def association_rules(spark, sf_dir):
    long = B2(spark, sf_dir)
    got = mine.rules(mine.mine(sets(long), threshold(long, SHARE["b2"])), 0.3)
    return got.select(itemsets.item_string(F.col("antecedent")).alias("antecedent"), "consequent", "support")


ENGINES = ("mllib", "levels", "growth", "groups")
MINED = {
    "frequent_itemsets": (B1, L1, "b1"), "frequent_itemsets_low": (B1, L1, "b1_low"), "event_itemsets": (B2, L2, "b2_low"), "attribute_itemsets": (B3, L3, "b3"),
}
QUERIES = {f"{name}_{engine}": _mined(basket, SHARE[share], engine) for name, (basket, _, share) in MINED.items() for engine in ENGINES}
_OTHERS = (
    item_support, frequent_items, dense_histogram, item_rank, distinct_item_count, dictionary_first_seen, dictionary_encoded, dense_rerank, one_hot,
    one_hot_sparse, inserted_tree,
    filtered_transactions, candidate_pairs, single_path_subsets, itemsets_of_size_2, itemset_size_histogram, threshold_intersect, threshold_except,
    difference_sample, match_score, association_rules, parent_pointers, decoded_itemsets, event_itemsets_grouped, dealt_transactions, transaction_scan,
    transaction_scan_all_lines, token_scan, basket_format, csv_baskets, distinct_itemsets, itemset_sink, itemset_sink_parsed, relabelled_itemsets, count_sink, dictionary_sink,
    encoded_sink, reranked_transactions, difference_both_ways, engines_equal, thresholds_equal, match_score_thresholds, validation_comparison, validation_scores,
)
QUERIES |= {f.__name__: f for f in _OTHERS}
QUERIES |= {f"{f.__name__}{of}": partial(f, of=of) for f in _TREE_QUERIES for of in TREES}

_LOW_NOT_HIGH = _eclat(L2, SHARE["b2_low"], f"""SELECT {{}} FROM r WHERE len(tids) < (SELECT greatest(2, count(DISTINCT tid) // {SHARE['b2']}) FROM long)""")
SQL = {
    **{f"{name}_{engine}": _eclat(long, SHARE[share]) for name, (_, long, share) in MINED.items() for engine in ENGINES},
    "item_support": f"SELECT item, count(*) AS support FROM ({L1}) GROUP BY item",
    "frequent_items": _sql(L1, 25, "x AS (SELECT item, count(*) AS support FROM long GROUP BY item)\nSELECT item, support FROM x WHERE support >= (SELECT m FROM thr)"),
    "dense_histogram": "SELECT r.range::BIGINT AS item, count(l_linenumber) AS support FROM range(16) r LEFT JOIN lineitem ON l_linenumber = r.range GROUP BY 1",
    "item_rank": _sql(L1, 25, _RANKS + "z AS (SELECT 1)\nSELECT item, support, rank FROM rk"),
    "distinct_item_count": f"SELECT count(DISTINCT item) AS n FROM ({L1})",
    "dictionary_first_seen": "SELECT p_brand AS item, row_number() OVER (ORDER BY min(p_partkey)) AS id FROM part GROUP BY p_brand",
    "dictionary_encoded": """WITH c AS (SELECT l_orderkey AS tid, l_linenumber AS col, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT item, row_number() OVER (ORDER BY min((tid, col)), item) AS id FROM c GROUP BY item)
SELECT tid, string_agg(id::VARCHAR, ' ' ORDER BY col, id) AS items FROM c JOIN d USING (item) GROUP BY tid""",
    "dense_rerank": "SELECT item, row_number() OVER (ORDER BY item) AS id FROM (SELECT DISTINCT p_brand AS item FROM part)",
    "one_hot": f"SELECT tid, {', '.join(f'''bool_or(item = '{k}') AS {k}''' for k in ('click', 'error', 'purchase', 'signup', 'view'))} FROM ({L2}) GROUP BY tid",
    "one_hot_sparse": f"""WITH long AS ({L1}), d AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS place FROM (SELECT DISTINCT item FROM long))
SELECT tid, (SELECT count(*) FROM d) AS size, string_agg(place::VARCHAR, ' ' ORDER BY place) AS indices FROM long JOIN d USING (item) GROUP BY tid""",
    "inserted_tree": _sql(L1, SHARE["b1"], _NODES + """z AS (SELECT DISTINCT prefix[1:depth - 1] AS up FROM nd WHERE depth > 1)
SELECT array_to_string(prefix, ' ') AS prefix, item, depth::INT AS depth, support, z.up IS NULL AS leaf FROM nd LEFT JOIN z ON z.up = nd.prefix"""),
    "filtered_transactions": _sql(L1, 25, _RANKS + "z AS (SELECT 1)\nSELECT tid, array_to_string(path, ' ') AS path FROM tx"),
    "candidate_pairs": _sql(L1, SHARE["b1"], "z AS (SELECT 1)\nSELECT a.item || ' ' || b.item AS itemset, count(*) AS support FROM long a JOIN long b ON a.tid = b.tid AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= (SELECT m FROM thr)"),
    "single_path_subsets": """WITH c AS (SELECT l_linenumber AS i, count(*) AS n, row_number() OVER (ORDER BY l_linenumber) - 1 AS k FROM lineitem GROUP BY 1),
m AS (SELECT unnest(range(1, (1 << (SELECT count(*) FROM c)))) AS mask)
SELECT string_agg(i::VARCHAR, ' ' ORDER BY i) AS itemset, min(n) AS support FROM m JOIN c ON (mask >> k) & 1 = 1 GROUP BY mask HAVING min(n) >= 2""",
    "itemsets_of_size_2": _eclat(L1, SHARE["b1"], "SELECT array_to_string(items, ' ') AS itemset, len(tids)::BIGINT AS support FROM r WHERE len(items) = 2"),
    "itemset_size_histogram": _eclat(L2, SHARE["b2_low"], "SELECT len(items)::INT AS size, count(*) AS n FROM r GROUP BY 1"),
    "threshold_intersect": _eclat(L2, SHARE["b2"], "SELECT array_to_string(items, ' ') AS itemset FROM r"),
    "threshold_except": _LOW_NOT_HIGH.replace("{}", "'{' || array_to_string(items, ', ') || '}' AS itemset"),
    "difference_sample": _LOW_NOT_HIGH.replace("{}", "array_to_string(items, ' ') AS itemset") + " ORDER BY len(items), items LIMIT 3",
    "match_score": _eclat(L2, SHARE["b2"], "SELECT count(*) AS matched, count(*) AS total, (100.0::DOUBLE * count(*) / count(*)) AS percent FROM r"),
    "association_rules": _eclat(L2, SHARE["b2"], """, e AS (SELECT items, len(tids) AS n, unnest(items) AS c FROM r WHERE len(items) > 1)
SELECT array_to_string(list_filter(e.items, lambda x: x <> e.c), ' ') AS antecedent, e.c AS consequent, e.n::BIGINT AS support FROM e JOIN r ON r.items = list_filter(e.items, lambda x: x <> e.c) WHERE e.n / len(r.tids) >= 0.3"""),
}


SQL |= {
    # a set's items are added from the deepest to the one nearest to the root: the item of least rank comes last
    "parent_pointers": _eclat(L2, SHARE["b2_low"], """, ranks AS (SELECT item, row_number() OVER (ORDER BY len(tids) DESC, item) AS rank FROM f),
three AS (SELECT items, len(tids) AS n, unnest(items) AS item FROM r WHERE len(items) = 3),
root AS (SELECT items, n, arg_min(item, rank) AS item FROM three JOIN ranks USING (item) GROUP BY items, n)
SELECT array_to_string(list_filter(items, lambda x: x <> item), ' ') AS parent_items, item, n::BIGINT AS support FROM root"""),
    "decoded_itemsets": _eclat(L2, SHARE["b2_low"], "SELECT array_to_string(items, ' ') AS itemset, len(tids)::BIGINT AS support FROM r WHERE len(items) = 3"),
    "event_itemsets_grouped": _eclat(L2, SHARE["b2_low"]),
    "relabelled_itemsets": _eclat(L2, SHARE["b2_low"]),
    "dealt_transactions": f"SELECT least(8, count(DISTINCT tid)) AS parts, count(DISTINCT tid) AS transactions, count(DISTINCT tid) > 0 AS even FROM ({L2})",
    "itemset_sink": _eclat(L2, SHARE["b2_low"], """, d AS (SELECT item, row_number() OVER (ORDER BY item) AS id FROM (SELECT DISTINCT item FROM long)),
e AS (SELECT items, len(tids) AS n, unnest(items) AS item FROM r)
SELECT string_agg(id::VARCHAR, ' ' ORDER BY id) || ' (' || n || ')' AS line FROM e JOIN d USING (item) GROUP BY items, n"""),
    "itemset_sink_parsed": _eclat(L2, SHARE["b2_low"], """, d AS (SELECT item, row_number() OVER (ORDER BY item) AS id FROM (SELECT DISTINCT item FROM long)),
e AS (SELECT items, unnest(items) AS item FROM r)
SELECT string_agg(id::VARCHAR, ' ' ORDER BY id) AS itemset FROM e JOIN d USING (item) GROUP BY items"""),
    "count_sink": f"SELECT item || ' ' || support AS line FROM ({SQL['dense_histogram']})",
    "dictionary_sink": SQL["dictionary_first_seen"],
    "encoded_sink": f"SELECT items, count(*) AS n FROM ({SQL['dictionary_encoded']}) GROUP BY items",
    "reranked_transactions": """WITH d AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) AS id FROM (SELECT DISTINCT l_suppkey FROM lineitem))
SELECT l_orderkey AS tid, string_agg(id::VARCHAR, ' ' ORDER BY l_linenumber, l_suppkey) AS items FROM lineitem JOIN d USING (l_suppkey) GROUP BY l_orderkey""",
    "difference_both_ways": _eclat(L2, SHARE["b2_low"], f""", x AS (SELECT items, len(tids) >= (SELECT greatest(2, count(DISTINCT tid) // {SHARE['b2']}) FROM long) AS high FROM r)
SELECT 'first' AS side, '{{' || array_to_string(items, ', ') || '}}' AS itemset FROM x WHERE len(items) > 1 AND NOT high
UNION ALL SELECT 'second', '{{' || array_to_string(items, ', ') || '}}' FROM x WHERE len(items) = 1 AND high"""),
    "engines_equal": _eclat(L3, SHARE["b3"], "SELECT e.engine, len(items)::INT AS size, count(*) AS n FROM r, (VALUES ('levels'), ('growth'), ('groups')) AS e(engine) GROUP BY ALL"),
    "thresholds_equal": _eclat(L2, SHARE["b2_low"], f"SELECT count(*) = 0 AS same FROM r WHERE len(tids) < (SELECT greatest(2, count(DISTINCT tid) // {SHARE['b2']}) FROM long)"),
    "validation_comparison": (_sizes := _eclat(L2, SHARE["b2_low"], f""", x AS (SELECT count(*) AS low, count(*) FILTER (WHERE len(tids) >= (SELECT greatest(2, count(DISTINCT tid) // {SHARE['b2']}) FROM long)) AS high FROM r),
v AS (SELECT 'low' AS dataset, 'levels' AS engine, low AS common, 0::BIGINT AS only_baseline, 0::BIGINT AS only_engine FROM x
 UNION ALL SELECT 'high', 'levels', high, 0, low - high FROM x UNION ALL SELECT 'low', 'none', 0, low, 0 FROM x)
SELECT *, only_baseline = 0 AND only_engine = 0 AS same FROM v""")),
    "validation_scores": f"SELECT engine, count(*) FILTER (WHERE same) AS matched, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (WHERE same) / count(*) AS percent FROM ({_sizes}) GROUP BY engine",
    "match_score_thresholds": _eclat(L2, SHARE["b2_low"], f""", x AS (SELECT count(*) FILTER (WHERE len(tids) >= (SELECT greatest(2, count(DISTINCT tid) // {SHARE['b2']}) FROM long)) AS matched, count(*) AS total FROM r)
SELECT matched, total, (100.0::DOUBLE * matched / total) AS percent FROM x"""),
}


def _tree_sql(long: str, share: int, item: str) -> dict[str, str]:
    """SQL of the tree queries over a basket."""
    nodes = lambda rest: _sql(long, share, _NODES + rest)
    base = f"""z AS (SELECT row_number() OVER () AS k, path[1:list_position(path, c.item) - 1] AS base, w FROM wp, (SELECT {item} AS item) c WHERE list_position(path, c.item) > 1)"""
    # depth-first order: by the ranks of the prefix
    placed = """pl AS (SELECT prefix, list(rk.rank ORDER BY k) AS place FROM (SELECT prefix, unnest(prefix) AS item, unnest(range(len(prefix))) AS k FROM nd) JOIN rk USING (item) GROUP BY prefix),
ps AS (SELECT nd.*, row_number() OVER (ORDER BY place) - 1 AS pos FROM nd JOIN pl USING (prefix))
"""
    cost = "cl AS (SELECT rank, sum(w * 0 + k)::BIGINT AS cells FROM (SELECT w, unnest(path) AS item, unnest(range(1, len(path) + 1)) AS k FROM wp) JOIN rk USING (item) GROUP BY rank)"
    group = cost + ",\ngr AS (SELECT rank, cells, floor(coalesce(sum(cells) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / (SELECT sum(cells) FROM cl))::BIGINT AS grp FROM cl)"
    start = "z AS (SELECT array_to_string(prefix, ' ') AS prefix, item, depth FROM nd), st AS (SELECT *, coalesce(sum(depth - 1) OVER (ORDER BY item, prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM z)\n"
    return {
        "weighted_paths": _sql(long, share, _RANKS + "z AS (SELECT 1)\nSELECT array_to_string(path, ' ') AS path, w FROM wp"),
        "tree_nodes": nodes("z AS (SELECT 1)\nSELECT array_to_string(prefix, ' ') AS prefix, item, depth::INT AS depth, support FROM nd"),
        "leaf_nodes": nodes("z AS (SELECT 1)\nSELECT array_to_string(prefix, ' ') AS prefix, support FROM nd ANTI JOIN (SELECT DISTINCT prefix[1:depth - 1] AS prefix FROM nd WHERE depth > 1) USING (prefix)"),
        "flat_tree": nodes(placed + "SELECT a.pos, coalesce(b.pos, -1) AS parent, a.item, a.depth::INT AS depth, a.support FROM ps a LEFT JOIN ps b ON b.prefix = a.prefix[1:a.depth - 1]"),
        "decoded_tree": nodes(placed + "SELECT pos, array_to_string(prefix, ' ') AS prefix FROM ps"),
        "header_table": nodes("z AS (SELECT 1)\nSELECT item, sum(support)::BIGINT AS support, count(*) AS nodes FROM nd GROUP BY item"),
        "tree_stats": nodes("z AS (SELECT 1)\nSELECT count(*) AS nodes, coalesce(max(depth), 0)::INT AS depth FROM nd"),
        "tree_print": nodes(placed + "SELECT pos + 1 AS place, repeat('  ', (depth - 1)::INT) || item || ' (' || support || ')' AS line FROM ps"),
        "conditional_pattern_base": _sql(long, share, _RANKS + base + "\nSELECT array_to_string(base, ' ') AS base, sum(w)::BIGINT AS w FROM z GROUP BY base"),
        "conditional_tree": _sql(long, share, _RANKS + base + """,
e AS (SELECT k, w, unnest(base) AS item, unnest(range(len(base))) AS pos FROM z), ok AS (SELECT item FROM e GROUP BY item HAVING sum(w) >= (SELECT m FROM thr)),
y AS (SELECT k, w, string_agg(item, ' ' ORDER BY pos) AS path FROM e WHERE item IN (SELECT item FROM ok) GROUP BY k, w)
SELECT path, sum(w)::BIGINT AS w FROM y GROUP BY path"""),
        "conditional_tree_local": _sql(long, share, _RANKS + base + """,
e AS (SELECT k, w, unnest(base) AS item FROM z), lr AS (SELECT item, row_number() OVER (ORDER BY sum(w) DESC, item) AS place FROM e GROUP BY item HAVING sum(w) >= (SELECT m FROM thr)),
y AS (SELECT k, w, string_agg(item, ' ' ORDER BY place) AS path FROM e JOIN lr USING (item) GROUP BY k, w)
SELECT path, sum(w)::BIGINT AS w FROM y GROUP BY path"""),
        "candidate_offsets": nodes(start + "SELECT prefix, start FROM st"),
        "balanced_work": nodes(start + "SELECT least(7, floor(start * 8 / greatest(1, (SELECT sum(depth - 1) FROM st))))::BIGINT AS part, count(*) AS nodes, sum(depth - 1)::BIGINT AS cost FROM st GROUP BY 1"),
        "item_groups": _sql(long, share, _RANKS + group + "\nSELECT rank, cells, grp FROM gr"),
        "group_sizes": _sql(long, share, _RANKS + group + """,
e AS (SELECT path, unnest(path) AS item, unnest(range(1, len(path) + 1)) AS k FROM wp), h AS (SELECT grp, path, max(k) AS k FROM e JOIN rk USING (item) JOIN gr USING (rank) GROUP BY grp, path)
SELECT grp, count(*) AS paths, sum(len(p))::BIGINT AS cells FROM (SELECT DISTINCT grp, path[1:k] AS p FROM h) GROUP BY grp"""),
    }


for _of, (_long, _share, _item) in {"": (L2, SHARE["b2"], "'purchase'"), "_brands": (L1, SHARE["b1"], "(SELECT item FROM rk ORDER BY rank DESC LIMIT 1)")}.items():
    SQL |= {f"{name}{_of}": sql for name, sql in _tree_sql(_long, _share, _item).items()}

_ORDERS = "SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey"
_S = "array_to_string(a, ' ')"
_COUNTED = lambda items, only: f"SELECT {items} AS items, count(*) AS n FROM ({_ORDERS}) WHERE {only} GROUP BY 1"
_NEGATED = "a[1]::VARCHAR || array_to_string(list_transform(a[2:], lambda x: ' ' || -x), '')"
_PARSED = f"CASE l_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 3 THEN array_to_string(a[1:2], ' ') WHEN 5 THEN {_NEGATED} ELSE {_S} END"
_TOKENS = f"""CASE l_orderkey % 8 WHEN 3 THEN array_to_string(a[1:2], ' ') || ' x ' || {_S} WHEN 4 THEN {_S} || ' 99999999999999999999 7' WHEN 5 THEN '+' || array_to_string(a, ' -')
 WHEN 6 THEN {_S} || 'abc 4' ELSE {_S} END"""
SQL |= {
    "transaction_scan": _COUNTED(_PARSED, "l_orderkey % 8 > 1"),
    "transaction_scan_all_lines": _COUNTED(_PARSED, "true"),
    "basket_format": _COUNTED(_PARSED, "true"),
    "token_scan": _COUNTED(_TOKENS, "l_orderkey % 8 > 1"),
    "csv_baskets": """SELECT p_partkey AS part, c.col, CASE c.col WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_name || ', a "' || p_brand || '"' WHEN 2 THEN p_type WHEN 3 THEN p_type || 'x'
 ELSE 'open, ' || p_brand END AS item FROM part, (SELECT unnest(range(5))::INT AS col) c""",
    "distinct_itemsets": f"""WITH o AS ({_ORDERS}), x AS (SELECT CASE WHEN l_orderkey % 8 = 5 THEN list_prepend(a[1], list_transform(a[2:], lambda x: -x)) ELSE a END AS a FROM o WHERE l_orderkey % 8 IN (2, 5, 7))
SELECT DISTINCT array_to_string(list_sort(list_distinct(a)), ' ') AS itemset FROM x""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
