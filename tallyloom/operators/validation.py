"""Validation of miners' result files against those of one miner, over a folder of them.

A result is a text file, or a folder of parts, named DATASET_ENGINE.txt, with an itemset a line. All results of a
folder are read, compared and scored as tables, however many and large they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.itemsets import itemset_of

_NAME = r"([^/]+)_([^/_]+)\.txt(?:/[^/]*)?$"


def _named(path) -> list:
    return [F.regexp_extract(path, _NAME, k).alias(c) for k, c in ((1, "dataset"), (2, "engine"))]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, engine) of each result in the folder, empty ones too, which a scan doesn't see. The driver lists names only."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [(str(f.getPath()),) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.createDataFrame(names, "path string").select(*_named("path")).filter("engine != ''")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, engine, itemset): the distinct itemsets of each result."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", *_named(F.input_file_name()))
    return lines.filter("engine != ''").select("dataset", "engine", itemset_of(F.col("value")).alias("itemset")).filter(F.size("itemset") > 0).distinct()


def compared(results: DataFrame, names: DataFrame, baseline: str) -> DataFrame:
    """(dataset, engine, common, only_baseline, only_engine, same) for each result of another engine; a missing result of the baseline is empty."""
    base = results.filter(F.col("engine") == baseline).select("dataset", "itemset", F.lit(True).alias("in_base"))
    mine = results.filter(F.col("engine") != baseline).join(base, ["dataset", "itemset"], "left")
    mine = mine.groupBy("dataset", "engine").agg(F.count_if("in_base").alias("hit"), F.count("*").alias("own"))
    sizes = base.groupBy("dataset").agg(F.count("*").alias("base"))
    x = names.filter(F.col("engine") != baseline).join(mine, ["dataset", "engine"], "left").join(sizes, "dataset", "left").na.fill(0, ["hit", "own", "base"])
    out = x.select("dataset", "engine", F.col("hit").alias("common"), (F.col("base") - F.col("hit")).alias("only_baseline"), (F.col("own") - F.col("hit")).alias("only_engine"))
    return out.withColumn("same", (F.col("only_baseline") == 0) & (F.col("only_engine") == 0))


def scores(comparison: DataFrame) -> DataFrame:
    """(engine, matched, total, percent): how many of an engine's results are the baseline's."""
    x = comparison.groupBy("engine").agg(F.count_if("same").alias("matched"), F.count("*").alias("total"))
    return x.withColumn("percent", F.lit(100.0) * F.col("matched") / F.col("total"))
