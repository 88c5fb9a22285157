"""Metrics of a run from Spark's event logs: a log is read as a nested table and summed up by job group and stage.

A session writes logs with spark.eventLog.enabled; sparkContext.setJobGroup(name, ...) names what follows, a query for instance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = "`Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT"
_READ = "`Shuffle Read Metrics`: STRUCT<`Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>"
_WRITE = "`Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>"
_METRICS = f"STRUCT<`Executor Run Time`: BIGINT, `Executor CPU Time`: BIGINT, `JVM GC Time`: BIGINT, {_SIZES}, {_READ}, {_WRITE}>"
#: The fields of events that are summed up.
SCHEMA = f"""Event STRING, `Stage ID` INT, `Job ID` INT, `Stage IDs` ARRAY<INT>, Properties STRUCT<`spark.jobGroup.id`: STRING>,
 `Stage Info` STRUCT<`Stage ID`: INT, `Stage Name`: STRING>, `Task Metrics` {_METRICS}"""


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log file or a folder of logs, an event a row."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(path)


def stage_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(job_group, stage, name, tasks, run_s, cpu_s, gc_s, read_mb, written_mb, spilled_mb), a row for each stage that ran a task.

    A stage belongs to the first job that names it, jobs without a group to none. Attempts of a stage are summed up.
    """
    x = events(spark, path)
    jobs = x.filter("Event = 'SparkListenerJobStart'").select("Job ID", F.col("Properties.`spark.jobGroup.id`").alias("job_group"), F.explode("Stage IDs").alias("stage"))
    jobs = jobs.groupBy("stage").agg(F.min_by("job_group", "Job ID").alias("job_group"))
    names = x.filter("Event = 'SparkListenerStageCompleted'").select(F.col("Stage Info.`Stage ID`").alias("stage"), F.col("Stage Info.`Stage Name`").alias("name"))
    names = names.groupBy("stage").agg(F.min("name").alias("name"))
    m = lambda field: F.coalesce(F.col(f"Task Metrics.{field}"), F.lit(0))
    mb = lambda c: F.sum(c) / 1e6
    read, spilled = "`Shuffle Read Metrics`", [m("`Memory Bytes Spilled`"), m("`Disk Bytes Spilled`")]
    tasks = x.filter("Event = 'SparkListenerTaskEnd'").groupBy(F.col("Stage ID").alias("stage")).agg(
        F.count("*").alias("tasks"), (F.sum(m("`Executor Run Time`")) / 1e3).alias("run_s"), (F.sum(m("`Executor CPU Time`")) / 1e9).alias("cpu_s"),
        (F.sum(m("`JVM GC Time`")) / 1e3).alias("gc_s"), mb(m(f"{read}.`Remote Bytes Read`") + m(f"{read}.`Local Bytes Read`")).alias("read_mb"),
        mb(m("`Shuffle Write Metrics`.`Shuffle Bytes Written`")).alias("written_mb"), mb(spilled[0] + spilled[1]).alias("spilled_mb"),
    )
    return tasks.join(jobs, "stage", "left").join(names, "stage", "left").select("job_group", "stage", "name", *tasks.columns[1:])


def group_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(job_group, stages, tasks, run_s, cpu_s, gc_s, read_mb, written_mb, spilled_mb) of each job group."""
    sums = [F.sum(c).alias(c) for c in ("tasks", "run_s", "cpu_s", "gc_s", "read_mb", "written_mb", "spilled_mb")]
    return stage_metrics(spark, path).groupBy("job_group").agg(F.count("*").alias("stages"), *sums)
