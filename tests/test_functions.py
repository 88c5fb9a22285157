"""Stored trees, sparse one-hot rows, counters and event logs."""

import itertools
import random
import subprocess
import sys

from pyspark.sql import functions as F

from tallyloom.functions import event_log
from tallyloom.functions.timing import StageCounters
from tallyloom.operators import encode, paths, stored_tree
from tallyloom.sources import baskets


def test_batches_in_any_order_equal_the_whole_tree(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.sample(range(9), rng.randint(0, 6))) for i in range(80)]
    long = baskets.explode_items(spark.createDataFrame(rows, "tid bigint, items array<int>"))
    ranks = paths.ranked_items(long, 3)
    shown = lambda df: {tuple(s["item"] for s in r.prefix): (r["item"], r.depth, r.support) for r in df.collect()}
    whole = paths.nodes(paths.weighted(paths.filtered(long, ranks)))
    leaves = set(shown(paths.leaves(whole)))
    parts = [long.filter(F.col("tid") < 5), long.filter("tid between 5 and 40"), long.filter("tid > 40"), long.filter("tid < 0")]
    for k, order in enumerate(itertools.islice(itertools.permutations(range(4)), 0, 24, 9)):
        at = f"{tmp_path}/tree{k}"
        for i in order:
            stored_tree.insert(spark, at, paths.weighted(paths.filtered(parts[i], ranks)))
        got = stored_tree.stored(spark, at)
        assert shown(got) == shown(whole) and set(shown(got.filter("leaf"))) == leaves


def test_sparse_one_hot_of_many_items(spark):
    rows = [(i, f"item{(i * 37) % 12_000:05d}") for i in range(12_000)] + [(3, "item00000"), (3, "item00000")]
    got = encode.one_hot_sparse(spark.createDataFrame(rows, "tid bigint, item string"))
    assert {tuple(r.indices) for r in got.filter("tid in (1, 3)").collect()} == {(37,), (0, 111)} and got.first()["size"] == 12_000
    ids = spark.createDataFrame([("b", 2), ("a", 1)], "item string, id bigint")
    few = encode.one_hot_sparse(spark.createDataFrame([(1, "b"), (1, "a"), (2, "z")], "tid bigint, item string"), ids)
    assert {r.tid: (r["size"], list(r.indices)) for r in few.collect()} == {1: (2, [0, 1]), 2: (2, [])}


def test_counters_count_while_a_query_runs(spark):
    c = StageCounters()
    df = c.counted(spark.range(100), "read", total=F.sum("id"))
    df = c.counted(df.filter("id % 2 = 0"), "even", "first")
    assert df.collect() and c.numbers() == {("read", ""): {"rows": 100, "total": 4950}, ("even", "first"): {"rows": 50}}
    c.counted(spark.range(7), "even", "first").collect()
    assert c.numbers()["even", "first"] == {"rows": 57}


def test_event_logs_by_group_and_stage(spark, tmp_path):
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '3').config('spark.eventLog.enabled', 'true').config('spark.eventLog.dir', 'file://{tmp_path}').getOrCreate()
s.sparkContext.setJobGroup('summed', '')
s.range(100000).selectExpr('id % 1000 k', 'id v').groupBy('k').sum('v').write.format('noop').mode('overwrite').save()
s.sparkContext.setJobGroup('plain', '')
s.range(10).repartition(4).write.format('noop').mode('overwrite').save()
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=200)
    stages = event_log.stage_metrics(spark, str(tmp_path)).collect()
    groups = {r.job_group: r for r in event_log.group_metrics(spark, str(tmp_path)).collect()}
    assert set(groups) == {"summed", "plain"} and sum(r.tasks for r in stages) == sum(g.tasks for g in groups.values())
    assert groups["summed"].stages >= 2 and groups["summed"].written_mb > 0 and groups["summed"].read_mb > 0 and groups["summed"].cpu_s > 0
    assert groups["plain"].spilled_mb == 0 and all(r.name for r in stages)
