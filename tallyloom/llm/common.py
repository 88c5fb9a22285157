"""Helpers shared by the llm operators: tables, written intermediate results, partitioned row numbers."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize, release

#: White space that separates words: space and \x09-\x0D; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


written, drop_written = materialize, release


#: Rows and bytes of an Arrow batch that are worked on and given out at once, about; Spark's own bound for what comes in is
#: spark.sql.execution.arrow.maxBytesPerBatch.
PART_ROWS, PART_BYTES = 500, 8_000_000


def slices(batches):
    """The batches in parts of a bounded size: what is made of a part is given out before the next one is begun."""
    for batch in batches:
        step = max(1, min(PART_ROWS, PART_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Rows in an Arrow batch of the registered queries and the pipeline.
JOB_ROWS = 500


def job(run):
    """run(spark, ...) as a job that sets up its session for long texts: Arrow batches of JOB_ROWS rows at most.

    At Spark's 10,000 a batch of texts is tens of MB, which a task holds several times outside the heap. Operators by themselves leave the session's
    settings alone; a smaller setting stays.
    """

    @functools.wraps(run)
    def with_small_batches(spark, *args):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= JOB_ROWS:
            spark.conf.set(key, str(JOB_ROWS))
        return run(spark, *args)

    return with_small_batches


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


#: Rows of one key that a task of a join takes at most, about, and how many keys with more are told to all tasks.
HOT_ROWS, HOT_KEYS = 5_000, 1_000_000


def join_spread(many: DataFrame, one: DataFrame, keys: list[str], weight: str, spread: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key and in `weight` the number of rows that many has of it.

    Keys of more than HOT_ROWS rows are dealt out by a hash of the column `spread` to as many parts as they need. They
    are at most the rows of many divided by HOT_ROWS, and counted; above HOT_KEYS of them, only hotter ones are dealt out.
    """
    least, part = HOT_ROWS, spare(many, "part_of_key")
    while (n := (hot := one.filter(F.col(weight) > least)).count()) > HOT_KEYS:
        least *= 4
    if not n:
        return many.join(one, keys, how)
    parts = F.when(F.col(weight) > least, F.ceil(F.col(weight) / HOT_ROWS)).otherwise(1).cast("int")
    told = hot.select(*keys, parts.alias(part))
    x = many.join(F.broadcast(told), keys, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(spread), F.col(part)).cast("int"), F.lit(0)))
    return x.join(one.withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, part], how).drop(part)


#: Rows that one row is repeated to at once.
REPEAT_ROWS = 10_000


def repeated(df: DataFrame, times: str, at: str, deal: bool) -> DataFrame:
    """Each row `times` times, with the number of the copy, from 0, in the column `at`. deal: first to all tasks, for rows of very many copies."""
    x = df.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1, F.lit(REPEAT_ROWS).cast("long"))))
    x = x.repartition(shuffle_partitions(df.sparkSession)) if deal else x
    return x.withColumn(at, F.explode(F.sequence(F.col(at), F.least(F.col(at) + (REPEAT_ROWS - 1), F.col(times) - 1))))
