"""What the miners write, and what one task of them gets, doesn't grow with equal transactions or with the input's partitions."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import growth, mine, paths
from tallyloom.plans import catalog
from tallyloom.sources import baskets


def copies(spark, n):
    """n transactions of three kinds, in one partition, with repeats, nulls and empty ones among them."""
    kinds = "array(array('b', 'a', 'b'), array('a', cast(null as string), 'c'), array('c', 'a', 'b'))"
    x = spark.range(0, n, 1, 1).selectExpr(f"{kinds}[int(id % 3)] AS items")
    return x.unionByName(spark.sql("SELECT cast(null as array<string>) AS items UNION ALL SELECT array() UNION ALL SELECT array(cast(null as string))")).coalesce(1)


WANT = {("a",): 3000, ("b",): 2000, ("c",): 2000, ("a", "b"): 2000, ("a", "c"): 2000, ("b", "c"): 1000, ("a", "b", "c"): 1000}


def test_task_of_sparks_miner_is_bounded(spark, monkeypatch):
    seen = []
    fit = mine.FPGrowth.fit
    monkeypatch.setattr(mine, "TASK_CELLS", 500, raising=False)
    monkeypatch.setattr(mine, "PIECE", 10, raising=False)
    monkeypatch.setattr(mine.FPGrowth, "fit", lambda self, df: seen.append(df.groupBy(F.spark_partition_id()).agg(F.sum(F.size("items")).alias("n")).agg(F.max("n")).first()[0]) or fit(self, df))
    found = {tuple(r.itemset): r.support for r in mine.mine(copies(spark, 3000), 1000).collect()}
    assert found == WANT and max(seen) < 800


@pytest.mark.parametrize("engine", ["mllib", "levels", "growth", "groups"])
def test_equal_transactions_are_written_once(spark, monkeypatch, engine):
    rows = []
    for module in (mine, growth, paths):
        one = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, one=one: [out := one(df), rows.append(out.count())][0])
    found = {tuple(r.itemset): r.support for r in mine.mine(copies(spark, 3000), 1000, engine=engine).collect()}
    assert found == WANT and max(rows) < 30


def test_merged_sets_by_row_and_by_tid(spark):
    x = spark.createDataFrame([(1, ["b", "a"]), (1, ["c"]), (2, ["a", "b", "a"]), (3, None), (4, [])], "tid int, items array<string>")
    assert {(tuple(r["items"]), r.w) for r in paths.merged_sets(x).collect()} == {(("a", "b"), 2), (("c",), 1)}
    assert {(tuple(r["items"]), r.w) for r in paths.merged_sets(x, tid="tid").collect()} == {(("a", "b", "c"), 1), (("a", "b"), 1)}


def test_repeated(spark):
    x = mine.repeated(spark.createDataFrame([([1, 2], 2500), ([3], 1), ([4], 1000)], "items array<int>, w bigint"), 5)
    assert x.rdd.getNumPartitions() == 5
    assert {tuple(r["items"]): r["count"] for r in x.groupBy("items").count().collect()} == {(1, 2): 2500, (3,): 1, (4,): 1000}


def test_line_attributes_need_no_shuffle(spark, tmp_path):
    rows = [(1, 1, "A", "F", 0.05, 0.02), (1, 2, None, "O", None, 0.0), (2, None, None, None, None, None)]
    spark.createDataFrame(rows, "l_orderkey int, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    x = baskets.line_attributes(spark, str(tmp_path))
    assert sorted(sorted(r["items"]) for r in x.collect()) == [["disc=5", "ln=1", "ls=F", "rf=A", "tax=2"], ["ln=2", "ls=O", "tax=0"]]
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("engine", ["mllib", "levels", "growth", "groups"])
def test_weighted_rows_are_as_many_transactions(spark, engine):
    rows = [(["b", "a", "b"], 600), (["a", "b"], 400), (["a", None, "c"], 1000), (["c", "a", "b"], 1000), (["c"], 0), (["c"], None), ([], 9), (None, 9), ([None], 9)]
    x = spark.createDataFrame(rows, "items array<string>, n int")
    assert {tuple(r.itemset): r.support for r in mine.mine(x, 1000, engine=engine, weight="n").collect()} == WANT


def test_weights_are_of_rows(spark):
    x = spark.createDataFrame([(1, ["a"], 2)], "tid int, items array<string>, n int")
    with pytest.raises(ValueError, match="no weight"):
        paths.merged_sets(x, tid="tid", weight="n")


def test_engines_equal_writes_each_set_once(spark, monkeypatch, tmp_path):
    """Four engines on 3,000 line items of six kinds: no table holds more rows than there are itemsets."""
    x = spark.range(3000).selectExpr("id AS l_orderkey", "int(id % 3) AS l_linenumber", "'A' AS l_returnflag", "if(id % 2 = 0, 'F', 'O') AS l_linestatus", "0.05D AS l_discount", "0.02D AS l_tax")
    x.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = []
    for module in (catalog, mine, growth, paths):
        one = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, one=one: [out := one(df), rows.append(out.count())][0])
    found = {(r.engine, r["size"]): r.n for r in catalog.engines_equal(spark, str(tmp_path)).collect()}
    kinds = [["rf=A", "disc=5", "tax=2", f"ls={a}", f"ln={b}"] for a in "FO" for b in range(3)]
    want = Counter(len(x) for x in {frozenset(x) for kind in kinds for k in range(1, 6) for x in combinations(kind, k)})
    assert found == {(e, k): n for e in ("levels", "growth", "groups") for k, n in want.items()}
    assert max(rows) < 100


def test_line_attribute_sets_are_the_kinds(spark, tmp_path):
    rows = [(1, 1, "A", "F", 0.05, 0.02), (1, 1, "A", "F", 0.05, 0.02), (2, 1, "A", "F", 0.05, 0.02), (1, 2, None, "O", None, 0.0), (2, 2, None, "O", None, -0.0), (2, None, None, None, None, None)]
    spark.createDataFrame(rows, "l_orderkey int, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    x = baskets.line_attribute_sets(spark, str(tmp_path))
    assert {tuple(sorted(r["items"])): r.w for r in x.collect()} == {("disc=5", "ln=1", "ls=F", "rf=A", "tax=2"): 3, ("ln=2", "ls=O", "tax=0"): 2} and x.count() == 2
    assert {(tuple(r["items"]), r.w) for r in paths.merged_sets(x, weight="w").collect()} == {(tuple(r["items"]), r.w) for r in paths.merged_sets(baskets.line_attributes(spark, str(tmp_path))).collect()}
    assert catalog.threshold(x, 1) == 5 and catalog.threshold(x.limit(0), 1) == 2
