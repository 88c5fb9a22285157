"""A stored prefix tree that grows by batches: nodes with their counts and whether they are leaves, kept without a rebuild.

The table has a partition for each first item. A batch touches the partitions of its own first items only; these are merged with the batch's
nodes by prefix and replaced, the others aren't read. The order of the items is fixed by the ranks in the paths: all batches have to use the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize, release
from tallyloom.operators.paths import nodes


def _with_leaves(tree: DataFrame) -> DataFrame:
    """A batch's nodes with whether another one of the batch is below."""
    up = tree.filter("depth > 1").select(F.expr("slice(prefix, 1, depth - 1)").alias("prefix")).distinct().withColumn("inner", F.lit(True))
    return tree.join(up, "prefix", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))


def insert(spark: SparkSession, path: str, paths: DataFrame) -> None:
    """Merges weighted paths (path, w) into the tree stored at path, or begins it. A batch without paths changes nothing.

    A node stays a leaf if nothing comes below it; what is new is one if the batch has nothing below it.
    """
    new = materialize(_with_leaves(nodes(paths.filter(F.size("path") > 0))).withColumn("root", F.col("prefix")[0]["rank"]))
    roots = new.select("root").distinct()
    if roots.isEmpty():
        release(new)
        return
    fresh = new.select("prefix", "item", "depth", "support", (~F.col("inner")).alias("leaf"), "root")
    if not _there(spark, path):
        fresh.write.partitionBy("root").parquet(path)
        release(new)
        return
    # the batch's first items prune the partitions that are read
    old = stored(spark, path).join(F.broadcast(roots), "root") if roots.count() <= 100_000 else stored(spark, path).join(roots, "root")
    own = new.select("prefix", F.col("item").alias("new_item"), F.col("depth").alias("new_depth"), F.col("support").alias("more"), "inner", F.col("root").alias("new_root"))
    x = old.join(own, "prefix", "full")
    merged = x.select(
        "prefix", F.coalesce("item", "new_item").alias("item"), F.coalesce("depth", "new_depth").alias("depth"),
        (F.coalesce("support", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("support"),
        (F.coalesce("leaf", F.lit(True)) & ~F.coalesce("inner", F.lit(False))).alias("leaf"), F.coalesce("root", "new_root").alias("root"),
    )
    merged = materialize(merged)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root").parquet(path)
    spark.catalog.refreshByPath(path)
    release(new, merged)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, item, depth, support, leaf, root) of the tree stored at path."""
    return spark.read.parquet(path).withColumn("root", F.col("root").cast("long"))
