"""Document fingerprints: bottom-k sketches of word-shingle hashes (Broder 1997; Cohen and Kaplan 2007).

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge to the sketch
of the whole, and two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import drop_written, repeated, shuffle_partitions, slices, written
from tallyloom.llm.shingles import WordHashes, shingle_set

K, WIDTH = 128, 5
#: Range buckets for each shuffle partition, when documents are put in order.
BUCKETS = 4
#: More rows of one id and text are worked on as one.
HOT_ROWS = 5_000


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of sorted distinct hashes."""
    return hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def encode(sketch: np.ndarray) -> str:
    """Base64 of the hashes, 8 bytes each, the smallest first; empty for an empty sketch."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union's shingles that both have; 1 for two empty sketches."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * 2.0**64 / (float(sketch[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / max(distinct(a, k), 1.0))


def sketches(docs: DataFrame, keep: list[str], text: str = "text", k: int = K, width: int = WIDTH, out: str = "sketch") -> DataFrame:
    """Columns `keep` and the sketch as an array of signed 64-bit values in unsigned order. Null text: empty."""
    last = "_".join(["text_of", *keep])
    docs = docs.select(*keep, F.col(text).cast("binary").alias(last))
    schema = T.StructType([*docs.drop(last).schema.fields, T.StructField(out, T.ArrayType(T.LongType(), False), False)])

    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            found = [bottom(shingle_set(words.of(t.as_py()), width), k).view(np.int64) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*keep, out])

    return docs.mapInArrow(run, schema)


def merged(parts: DataFrame, by: list[str], k: int = K, sketch: str = "sketch", salts: int = 64) -> DataFrame:
    """One sketch for each value of `by`, from the sketches of its parts; groups of any size.

    The k smallest are kept within salted parts of a group first, so one large group doesn't meet in one task.
    """
    h = F.explode(sketch).alias("h")
    # signed values in unsigned order: flip the sign bit
    order = F.expr("h ^ -9223372036854775808")
    x = parts.select(*by, h).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts))).distinct()
    x = x.withColumn("r", F.row_number().over(Window.partitionBy(*by, "salt").orderBy(order))).filter(F.col("r") <= k).drop("r", "salt")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("r") <= k)
    return x.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda s: s["h"]).alias(sketch))


def cuts_of(marks: DataFrame, n: int) -> list[tuple[int | None, int]]:
    """About n places (id, text hash) that cut the rows of marks (doc_id, h) into ranges of like size, in order; the driver gets n ids.

    An id of many rows, or the lack of one, is cut by the hashes of the texts, which are uniform.
    """
    rows, null = marks.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    with_id = marks.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 50 * n)).first()[0] if n > 1 else None
    times = {None: null * n // max(rows, 1)}
    for v in with_id or []:
        times[v] = times.get(v, 0) + 1
    return [(v, -(2**63) + (2**64 * k // m)) for v, m in sorted(times.items(), key=lambda x: (x[0] is not None, x[0] or 0)) for k in range(m)]


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """Rows (bucket, halo, doc_id, text as binary, copies): each bucket is a range of ids in one partition, sorted, and then,
    with halo true, the first of the next bucket's rows (after the last bucket: the first's).

    Texts are shuffled once. The driver gets one place for each bucket; they are told to all tasks as a table of one row. Null ids come
    first; rows with one id are ordered by a hash of the text, by which many of them are several buckets. More than HOT_ROWS rows
    of one id and text are one row; the second result says whether there are such.
    """
    spark = docs.sparkSession
    n = BUCKETS * shuffle_partitions(spark)
    x = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    x = x.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(b""))))
    marks = written(x.select("doc_id", "h"))
    cuts = cuts_of(marks, n)
    step = max(1, int(len(cuts) ** 0.5))
    place = F.struct(F.col("doc_id").isNotNull().alias("t"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"), "h")
    rows = [(v is not None, v or 0, h) for v, h in cuts]
    told = spark.createDataFrame([(0, rows[::step], rows)], "one int, coarse array<struct<t:boolean,i:bigint,h:bigint>>, fine array<struct<t:boolean,i:bigint,h:bigint>>")

    def placed(frame):
        coarse = F.size(F.filter("coarse", lambda c: c <= F.col("place")))
        fine = F.size(F.filter(F.slice("fine", F.greatest(F.col("at") - 1, F.lit(0)) * step + 1, F.lit(step)), lambda c: c <= F.col("place")))
        y = frame.withColumns({"place": place, "one": F.pmod("h", F.lit(1)).cast("int")}).join(F.broadcast(told), "one").withColumn("at", coarse)
        return y.withColumn("bucket", F.when(F.col("at") == 0, 0).otherwise((F.col("at") - 1) * step + fine).cast("int")).drop("one", "coarse", "fine", "at")

    firsts = sorted((r[0], tuple(r[1])) for r in placed(marks).groupBy("bucket").agg(F.min("place")).collect())
    heads = [(b, (b, *head), firsts[k - 1][0]) for k, (b, head) in enumerate(firsts)]
    heads = spark.createDataFrame([(b, head[1:], before) for b, head, before in heads], "bucket int, head struct<t:boolean,i:bigint,h:bigint>, before int")
    many = written(marks.groupBy("doc_id", "h").agg(F.count("*").alias("copies")).filter(F.col("copies") > HOT_ROWS))
    drop_written(marks)
    x = x.withColumn("copies", F.lit(1).cast("long"))
    if alike := many.count() > 0:
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))
        hot = F.broadcast(many.select(F.col("doc_id").alias("i"), F.col("h").alias("k"), F.col("copies").alias("n")))  # the rows / HOT_ROWS at most
        one = x.join(hot, same).groupBy("doc_id", "h", "n").agg(F.first("text").alias("text")).select("doc_id", "text", "h", F.col("n").alias("copies"))
        x = x.join(hot, same, "left_anti").union(one)
    x = placed(x).join(F.broadcast(heads), "bucket")
    own = F.struct("bucket", F.lit(False).alias("halo"))
    spots = F.when(F.col("place") == F.col("head"), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array(own))
    x = x.select(F.explode(spots).alias("spot"), "doc_id", "text", "h", "copies").select("spot.bucket", "spot.halo", "doc_id", "text", "copies", "h")
    return x.repartition(n // BUCKETS, "bucket").sortWithinPartitions("bucket", "halo", F.asc_nulls_first("doc_id"), "h").drop("h"), alike


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """For each document its fingerprint and that of its edited text, with their likeness and that to the next document.

    The edited text has the last quarter of the code points replaced by as many from the start of the next document in
    ascending id (after the last: the first, which may be the document itself). Null and empty texts have empty fingerprints, alike to each other
    with 1 and to others with 0. Null ids come first. Repeated rows are documents of their own; those of one id are ordered by a hash of the text.
    Empty tables give none; other columns don't matter. Texts stream in order; a task holds two of them at a time.
    """

    def run(batches):
        words = WordHashes()

        def sketch(t: bytes) -> np.ndarray:
            return bottom(shingle_set(words.of(t), width), k)

        def row(a, b, copies):
            i, t, raw, own, _ = a
            _, nxt, _, other, _ = b
            n = len(t) // 4
            edited = (t[: len(t) - n] + nxt[:n]).encode() if n else raw
            new = sketch(edited) if n else own
            return i, len(t), hashlib.sha256(edited).hexdigest(), encode(own), encode(new), resemblance(own, new, k), resemblance(own, other, k), copies

        at = last = None
        done = False
        for batch in slices(batches):
            out = []
            for b, halo, i, copies, t in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(4).to_pylist(), batch.column(3), strict=True):
                if halo and (done or b != at):
                    continue
                if b != at:
                    at, last, done = b, None, False
                raw = t.as_py() or b""
                new = (i, raw.decode("utf-8", "replace"), raw, sketch(raw), copies)
                if last is not None:
                    out.append(row(last, new, 1))
                    if last[4] > 1:  # the others of its copies have their like next
                        out.append(row(last, last, last[4] - 1))
                last, done = new, halo
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    rows, alike = in_order(docs, doc_id, text)
    out = rows.mapInArrow(run, SCHEMA)
    return (repeated(out, "copies", "copy", True).drop("copy") if alike else out).drop("copies")
