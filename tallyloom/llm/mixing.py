"""Mixing sources to target weights.

Within a source, documents are put in the order of a hash-random key and taken until the source's budget of words is
met; a budget above the source's size repeats it by whole epochs first. The order is never held in one task: keys are
uniform, so their leading digits cut each source into ranges of like size, and the words before a range come from a
prefix sum over range totals, in two steps. Rows of one id, source and size are counted and are one row until the end, so
that a repeated or missing id, which has one key, makes no large range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import common
from tallyloom.llm.common import WORD, drop_written, join_spread, repeated, written

SEED = "mix-1"
#: Documents in a range of keys, about, and ranges that are summed up in one window.
RANGE_ROWS, RANGES = 2_000, 10_000
#: Up to so many sources, their totals are broadcast (some 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def key_of(doc_id, seed: str = SEED):
    """A hash-random 60-bit key of an id, as SQL engines with md5 can make it too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def numbered(sources: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the place of each row in the ascending order of a distinct column, null last, from 0, by ranges."""
    x = written(sources.repartitionByRange(F.asc_nulls_last(column)).sortWithinPartitions(F.asc_nulls_last(column)).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = x.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return x.join(F.broadcast(parts.withColumnRenamed("part", "part_")), part == F.col("part_")).withColumn(out, F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part_", "n", "base")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources (source, words, ...) with target: shares by repeating weights of the total, none above most * words.

    What a cap cuts off is reshared by weight among the others until none is above. Each round is one aggregate over
    the sources; a round only lowers the set that still shares, so it ends.
    """
    x = numbered(sources, "source", "place")
    x = written(x.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))))
    total = x.agg(F.sum("words")).first()[0] or 0
    rest, shared, n = total, -1, 0
    free = F.lit(True)
    while True:
        capped = ~free
        got = x.agg(F.coalesce(F.sum(F.when(capped, F.col("words") * most)), F.lit(0)).alias("cut"), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)).alias("w"), F.count(F.when(free, 1)).alias("n")).first()
        rest, shared = total - got["cut"], got["w"]
        if got["n"] == n or not shared:
            break
        n = got["n"]
        # above its cap: weight * rest / shared > most * words, in whole numbers
        free = free & (F.col("weight").cast("decimal(38,0)") * F.lit(rest).cast("decimal(20,0)") <= F.col("words").cast("decimal(38,0)") * F.lit(most * shared).cast("decimal(18,0)"))
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(shared or 1))
    return x.withColumn("target", F.when(free & F.lit(bool(shared)), share).otherwise((F.col("words") * most).cast("double"))).select(*sources.columns, "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes of each document.

    Size is the number of words (null: 0). A source's documents are taken in key order: each once for every whole
    epoch in the target, once more while the remaining budget (rounded down) lasts, and of the one that crosses it
    the first words only. So a source's taken words are its target rounded down. Documents of equal key are ordered by
    id and size; rows equal in these too get the same words in any order. A null source is one source, a null id an id of its own.
    Null and empty texts take 0, long ones are counted whole; other columns don't matter; an empty table gives no rows.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    sources = sized.groupBy("source").agg(F.sum("copies").alias("docs"), F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("rows"))
    sources = targets(sources, weights, most).withColumn("ranges", F.greatest(F.ceil(F.col("rows") / RANGE_ROWS), F.lit(1)))
    name = {"source_key": F.coalesce(F.col("source").cast("string"), F.lit("")), "no_source": F.col("source").isNull()}
    sources = written(sources.withColumns(name).drop("source"))
    x = sized.withColumn("key", key_of("doc_id", seed)).withColumns(name)
    on = ["source_key", "no_source"]
    x = x.join(F.broadcast(sources), on) if sources.count() <= BROADCAST_SOURCES else join_spread(x, sources, on, "rows", "key")
    x = x.withColumn("part", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges")))
    own = F.col("size") * F.col("copies")
    cut = written(x.groupBy(*on, "part").agg(F.sum(own).alias("in_part")).withColumn("parts", F.floor(F.col("part") / RANGES)))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = cut.groupBy(*on, "parts").agg(F.sum("in_part").alias("in_parts"))
    high = high.select(*on, "parts", before(Window.partitionBy(*on).orderBy("parts"), "in_parts").alias("high"))
    base = cut.withColumn("low", before(Window.partitionBy(*on, "parts").orderBy("part"), "in_part")).join(high, [*on, "parts"])
    base = written(base.select(*on, "part", (F.col("high") + F.col("low")).alias("base")))
    drop_written(cut)
    inside = Window.partitionBy(*on, "part").orderBy("key", F.asc_nulls_first("doc_id"), "size")
    x = x.withColumn("before", before(inside, own))
    x = x.join(F.broadcast(base) if base.count() <= BROADCAST_SOURCES else base, [*on, "part"])
    most_alike = sized.agg(F.max("copies")).first()[0] or 0
    x = repeated(x, "copies", "copy", most_alike > common.REPEAT_ROWS) if most_alike > 1 else x.withColumn("copy", F.lit(0))
    epochs = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    left = F.floor(F.col("target") - epochs * F.col("words"))
    start = F.col("base") + F.col("before") + F.col("copy") * F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - start))
    return x.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", taken.cast("long").alias("taken"))


#: The same mix in DuckDB's SQL.
SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
-- capped sources are those with the lowest words to weight: cutting by that order reaches the same end as resharing
r AS (SELECT *, coalesce(sum(3 * words) OVER o, 0) AS cut, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS shared, sum(words) OVER () AS total
      FROM s WINDOW o AS (ORDER BY words::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (total - cut)::BIGINT AS rest, shared::BIGINT AS shared, words::DOUBLE / weight AS level FROM r
      WHERE weight * (total - cut) <= 3 * words * shared ORDER BY words::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (SELECT s.source, s.words, CASE WHEN f.shared IS NULL OR s.words::DOUBLE / s.weight < f.level THEN (3 * s.words)::DOUBLE ELSE f.rest::DOUBLE * s.weight / f.shared::DOUBLE END AS target FROM s LEFT JOIN f ON true),
p AS (SELECT d.doc_id, d.size, t.words, t.target, CASE WHEN t.words > 0 THEN floor(t.target / t.words) ELSE 0 END AS epochs,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 15), d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target, (epochs * size + greatest(0, least(size, floor(target - epochs * words) - before)))::BIGINT AS taken FROM p
"""
