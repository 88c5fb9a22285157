"""Benchmark decontamination by size-partitioned MinHash containment search (after Zhu et al., LSH Ensemble, 2016).

Items are indexed, partitioned by the size of their shingle set in powers of two. An item's signature is a bottom-k MinHash: its SKETCH
smallest shingle hashes, or all of them if it has no more. These are a random sample of the item's set, so the share of
them that a document holds estimates the item's containment in it, whatever the document's length. Each partition has its own bound,
above which none of its signatures has a hash; a document's signature for the partition is what its own set has below
that: the larger the items, the smaller it is. An item is a candidate if the estimate is at most MARGIN standard deviations
below the threshold; where the signature is the whole set, the estimate is exact and so is the rule. Since that many of its hashes must
be there, only as many of them are looked up as leave too few others; those that the fewest items have, so a
phrase that all items share finds none of them. Candidates are verified by exact shingle containment.

Shingles are runs of five words of folded case; an item of fewer words is one run of all its words, looked
for among the documents' runs of that width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import drop_written, slices, spare, written
from tallyloom.llm.shingles import WordHashes, runs

WIDTH, THRESHOLD = 5, 0.8
#: Hashes of an item's signature, and standard deviations of the estimate below the threshold that still make a candidate: an item
#: at the threshold is missed with a probability under 1e-3.
SKETCH, MARGIN = 12, 3.5
#: Up to so many shingles of items (16 bytes each), these are broadcast; beyond, signatures meet them by a shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Up to so many contaminated texts (32 bytes each) are broadcast to the filter.
BROADCAST_TEXTS = 500_000
_NULL = -(2**63)
_FOUND = ("item_id", "item_shingles", "shared")


def least_found(size: int, threshold: float) -> int:
    """How many hashes of the signature of an item of `size` shingles a document must hold to be a candidate."""
    k = min(size, SKETCH)
    share = threshold if k == size else threshold - MARGIN * (threshold * (1 - threshold) / k) ** 0.5
    return max(1, int(np.ceil(share * k - 1e-9)))


class Items:
    """The sorted sets of hashes of all items, and by size class the index of their signatures."""

    def __init__(self, shingles: np.ndarray, items: np.ndarray, widths: np.ndarray, n: int, threshold: float):
        order = np.lexsort((shingles, items))
        shingles, items = shingles[order], items[order]
        self.widths, self.threshold = sorted(set(widths.tolist())), threshold
        self.sizes = np.bincount(items, minlength=n)
        ends = np.cumsum(self.sizes)
        self.sets = np.split(shingles, ends[:-1]) if n else []
        self.least = [least_found(s, threshold) for s in self.sizes.tolist()]
        _, place, count = np.unique(shingles, return_inverse=True, return_counts=True)
        common = count[place]
        classes: dict[int, list] = {}
        for i, (size, end) in enumerate(zip(self.sizes.tolist(), ends.tolist(), strict=True)):
            sketch = np.arange(end - size, end - size + min(size, SKETCH))
            rare = sketch[np.argsort(common[sketch], kind="stable")][: len(sketch) - self.least[i] + 1]
            classes.setdefault((size - 1).bit_length(), []).append((np.full(len(rare), i), shingles[rare]))
        self.parts = []
        for _, found in sorted(classes.items()):
            who, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")
            self.parts.append((keys[order], who[order]))

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items of which a document's sorted set may hold enough, by the estimates."""
        found = [np.empty(0, np.int64)]
        for keys, who in self.parts:
            signature = hashes[: np.searchsorted(hashes, keys[-1], "right")]
            low, high = np.searchsorted(keys, signature, "left"), np.searchsorted(keys, signature, "right")
            hit = high > low
            found += [who[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist(), strict=True)]
        return [i for i in np.unique(np.concatenate(found)).tolist() if held(self.sets[i][:SKETCH], hashes) >= self.least[i]]

    def search(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the document contains."""
        found = [runs(words, w) for w in self.widths if len(words) >= w]
        if not found:
            return []
        hashes = np.unique(np.concatenate(found))
        both = ((i, held(self.sets[i], hashes)) for i in self.candidates(hashes))
        return [(i, n) for i, n in both if n >= self.threshold * self.sizes[i]]


def held(some: np.ndarray, hashes: np.ndarray) -> int:
    """How many of some hashes are in a sorted set."""
    return int(np.count_nonzero(hashes[np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)] == some)) if len(hashes) else 0


def item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, width, shingle): the distinct shingles of every item with words."""

    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words.of(t.as_py(), fold=True)
                s = np.unique(runs(w, WIDTH))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int64()), pa.array([min(WIDTH, len(w))] * len(s), pa.int32()), pa.array(s.view(np.int64))], names=["item", "width", "shingle"])

    return items.select(F.col(item_id).cast("long"), F.col(text).cast("binary")).mapInArrow(run, "item long, width int, shingle long")


def search(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, threshold: float, broadcast_shingles: int) -> DataFrame:
    """(key, item_id, item_shingles, shared) for each row of docs (key of any type, text binary) and item that it contains."""
    spark = docs.sparkSession
    shingles = written(item_shingles(items.repartition(spark.sparkContext.defaultParallelism), item_id, item_text).distinct())
    if shingles.count() > broadcast_shingles:
        return _by_shuffle(docs, shingles, threshold)
    t = shingles.toArrow()
    drop_written(shingles)
    ids, place = np.unique(t["item"].fill_null(_NULL).to_numpy(), return_inverse=True)
    known = Items(t["shingle"].to_numpy().view(np.uint64), place, t["width"].to_numpy(), len(ids), threshold)
    shared = spark.sparkContext.broadcast((known, ids))

    def run(batches):
        (known, ids), words = shared.value, WordHashes()
        for batch in slices(batches):
            out = [(row, i, n) for row, t in enumerate(batch.column(1)) for i, n in known.search(words.of(t.as_py(), fold=True))]
            row, item, n = zip(*out, strict=True) if out else ((), (), ())
            names = [None if ids[i] == _NULL else int(ids[i]) for i in item]
            key = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *(pa.array(c, pa.int64()) for c in (names, [int(known.sizes[i]) for i in item], n))], names=["key", *_FOUND])

    return docs.select("key", "text").mapInArrow(run, T.StructType([docs.schema["key"], *(T.StructField(c, T.LongType()) for c in _FOUND)]))


def _by_shuffle(docs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The same search with the items' shingles in a table: their signatures' rarest hashes find candidates, which are counted."""
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # five values at most
    rows = written(docs.withColumn("row_at", F.monotonically_increasing_id()))
    item, hash_order = F.coalesce("item", F.lit(_NULL)).alias("item"), F.expr("shingle ^ -9223372036854775808")
    x = shingles.select(item, "shingle").distinct()
    common = x.groupBy("shingle").agg(F.count("*").alias("common"))
    size = F.count("*").over(Window.partitionBy("item"))
    x = x.join(common, "shingle").withColumns({"size": size, "place": F.row_number().over(Window.partitionBy("item").orderBy(hash_order))})
    least = F.when(F.col("size") <= SKETCH, F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("size") - 1e-9))).otherwise(least_found(SKETCH + 1, threshold))
    marked = written(x.select("item", "shingle", "size", "common", (F.col("place") <= SKETCH).alias("drawn"), least.cast("int").alias("least")))
    rare = F.row_number().over(Window.partitionBy("item").orderBy("common", hash_order))
    keys = marked.filter("drawn").withColumn("rare", rare).filter(F.col("rare") <= F.least("size", F.lit(SKETCH)) - F.col("least") + 1)
    keys = written(keys.select("item", "shingle"))
    bound = keys.agg(F.max(hash_order)).first()[0]  # above it no signature has a hash
    bound = np.uint64(0 if bound is None else int(bound) + 2**63)

    def hashed(most):
        def run(batches):
            words = WordHashes()
            for batch in slices(batches):
                for at, t in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                    w = words.of(t.as_py(), fold=True)
                    s = np.unique(np.concatenate([np.empty(0, np.uint64), *(runs(w, k) for k in widths if len(w) >= k)]))
                    s = s if most is None else s[: np.searchsorted(s, most, "right")]
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(s), pa.int64()), pa.array(s.view(np.int64))], names=["row_at", "shingle"])

        return run

    schema = "row_at long, shingle long"
    pairs = written(rows.select("text", "row_at").mapInArrow(hashed(bound), schema).join(keys, "shingle").select("row_at", "item").distinct())
    near = rows.join(pairs.select("row_at").distinct(), "row_at", "left_semi").select("text", "row_at").mapInArrow(hashed(None), schema)
    both = pairs.join(marked, "item").join(near, ["row_at", "shingle"])
    n = both.groupBy("row_at", "item").agg(F.count("*").alias("shared"), F.count_if("drawn").alias("found"), F.first("size").alias("item_shingles"), F.first("least").alias("least"))
    n = n.filter((F.col("found") >= F.col("least")) & (F.col("shared") >= F.lit(threshold) * F.col("item_shingles")))
    out = rows.select("key", "row_at").join(n, "row_at").select("key", F.nullif("item", F.lit(_NULL)).alias("item_id"), "item_shingles", "shared")
    drop_written(shingles)
    return out


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each document that holds `threshold` of an item's shingles.

    Null ids are kept as such; null and empty texts and items without words match nothing. Rows with one document id and
    text give their matches once each; items of one id (or of none) are one item with all their shingles. Other columns don't matter; empty
    tables give no rows. The shingles of the items are counted before they are broadcast; above broadcast_shingles, signatures are
    joined by hash, which takes any number, with the same result.
    """
    x = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    found = search(x, items, item_id, item_text, threshold, broadcast_shingles).withColumnRenamed("key", "doc_id")
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay.

    A row is judged by its text alone (its 128-bit hash): rows of one id, of a null id or repeated ones each go or stay by
    what they hold. Null texts stay.
    """
    same = spare(docs, "text_hash")
    key = F.md5(F.col(text).cast("binary"))
    x = docs.select(key.alias("key"), F.col(text).cast("binary").alias("text"))
    found = written(search(x, items, item_id, item_text, threshold, broadcast_shingles).select(F.col("key").alias(same)).distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
    return docs.join(found, key == F.col(same), "left_anti")


#: contaminated of documents and benchmark in DuckDB's SQL, by all shingles; it lower-cases where the operator folds case.
SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
 UNION ALL SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') FROM benchmark),
i AS (SELECT DISTINCT id AS item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda x: w[x:x + 4])) AS g FROM t WHERE kind = 1 AND len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
d AS (SELECT DISTINCT t.id AS doc_id, x.k, unnest(list_transform(range(1, len(t.w) - x.k + 2), lambda j: t.w[j:j + x.k - 1])) AS g FROM t, (SELECT DISTINCT k FROM i) x WHERE t.kind = 0 AND len(t.w) >= x.k),
b AS (SELECT d.doc_id, i.item_id, count(*) AS shared FROM d JOIN i ON i.g = d.g AND i.k = d.k GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment FROM b JOIN n USING (item_id) WHERE shared >= 0.8::DOUBLE * item_shingles
"""
