"""Hard negatives by dual-tree search: exact inner products, pruned by nodes of a tree over anchors and one over candidates.

1. Vectors become whole numbers. Rows are dealt to cells around a few pivots, cells to blocks of a bounded number of rows, and each block
   becomes a ball tree: split by label first, then at medians of the widest direction; its leaves are runs of rows.
2. Anchors' and candidates' blocks meet in pairs of bounded size; a task goes through those of one block of anchors, the most promising first,
   and keeps the best rows of each anchor so far. For a pair of nodes the inner products lie in an interval, by the nodes' centres and radii: if no
   anchor of the node can use a product from it, the whole pair of nodes is left out. Pairs of leaves that are left are scored exactly.
3. The same search finds positives (same label, the highest scores) and then negatives (another label, the highest scores within a
   range by the positive's score). Tasks of one block of anchors are merged by anchor, a few rows each.

All rows are candidates for all anchors; nothing is capped. What a task holds are two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, shuffle_partitions, written

POSITIVES, NEGATIVES = 5, 10
#: Negatives score from LOW to HIGH hundredths of the positive.
LOW, HIGH = 30, 90
#: Anchors are rows whose id is divisible by ANCHOR; labels of ids divisible by SHIFT become the next of LABELS.
ANCHOR, SHIFT, LABELS, SCALE = 100, 7, 10, 256
#: Rows of a block of candidates and of anchors, of a leaf, and candidates scored at once.
BLOCK, ANCHOR_BLOCK, LEAF, AT_ONCE = 8_192, 4_096, 64, 1_024
#: Pivots at most: rows of least hash, from as many rows as that.
PIVOTS = 256
_NONE, _LAST = -(1 << 62), 1 << 62
_BLOBS = ("ids", "labels", "vecs", "ends", "scores")


def quantized(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vec): whole-number vectors of the rows that take part. Rows of one id are one row, that of least label and vector.

    Rows with a null id, label or vector, or with a null or non-finite component are left out.
    """
    v = F.col(vector).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(fine)
    own = F.col(label).cast("long")
    moved = F.when(F.col(vec_id) % SHIFT == 0, (own + 1) % LABELS).otherwise(own)
    x = x.select(F.col(vec_id).cast("long").alias("id"), F.struct(moved.alias("label"), F.transform(v, lambda c: F.floor(c * SCALE)).alias("vec")).alias("of"))
    return x.groupBy("id").agg(F.min("of").alias("of")).select("id", "of.label", "of.vec")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows with their block: a cell's rows go to as many blocks as they fill. Vectors of other lengths are other cells.

    The pivots are rows of least hash, one for as many rows as a block has, PIVOTS at most; which they are has no part in the result.
    """
    few = min(PIVOTS, rows.count() // block)
    taken = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(few).collect() if few > 1 else []
    pivots = [np.array(r.vec, np.float64) for r in taken]

    def cells(batches):
        for batch in batches:
            vecs = batch.column(batch.schema.get_field_index("vec"))
            size = np.diff(vecs.offsets.to_numpy())
            cell = np.zeros(len(batch), np.int32)
            for d in np.unique(size):
                near = [p for p in pivots if len(p) == d]
                if d and near:
                    at, p = np.flatnonzero(size == d), np.array(near)
                    x = vecs.take(pa.array(at)).flatten().to_numpy().reshape(-1, d).astype(np.float64)
                    cell[at] = (x @ p.T - (p * p).sum(1) / 2).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size.astype(np.int32)), pa.array(cell)], names=[*batch.schema.names, "dims", "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    x = rows.mapInArrow(cells, f"{kinds}, dims int, cell int")
    sizes = x.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    x = x.join(F.broadcast(sizes), ["dims", "cell"])  # PIVOTS rows for a length
    return x.withColumn("block", F.xxhash64("dims", "cell", F.pmod(F.xxhash64("id"), F.col("parts")))).drop("cell", "parts")


def tree(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and the ends of the leaves (runs of LEAF rows at most) in it.

    Rows are cut where labels change, as near to the middle as that is; of one label at the median of the widest component.
    """
    order, sizes, stack = [], [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        own = labels[at]
        if len(at) <= LEAF:
            order.append(at)
            sizes.append(len(at))
        elif own.min() != own.max():
            at = at[np.argsort(own, kind="stable")]
            edges = np.flatnonzero(np.diff(labels[at])) + 1
            stack += np.split(at, [edges[np.abs(edges - len(at) // 2).argmin()]])[::-1]
        else:
            by = x[at, x[at].var(0).argmax()] if x.shape[1] else own
            stack += np.split(at[np.argsort(by, kind="stable")], [len(at) // 2])[::-1]
    return np.concatenate(order), np.cumsum(sizes)


class Block:
    """A block's rows in the order of its tree, with the nodes: leaves first, then level by level two neighbours as one, the root last."""

    def __init__(self, row: dict):
        self.ids, self.labels, self.ends, self.scores = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "ends", "scores"))
        self.x = np.frombuffer(row["vecs"], np.int16 if row["small"] else np.int64).reshape(len(self.ids), row["dims"])
        self.f = self.x.astype(np.float64)
        self.largest = float(np.abs(self.f).max(initial=0))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        first, last = list(range(len(self.ends))), list(range(1, len(self.ends) + 1))
        kids, level = [(-1, -1)] * len(first), list(first)
        while len(level) > 1:
            up = []
            for i in range(0, len(level) - 1, 2):
                a, b = level[i : i + 2]
                first.append(first[a])
                last.append(last[b])
                kids.append((a, b))
                up.append(len(first) - 1)
            level = up + level[len(level) // 2 * 2 :]
        self.root, self.kids = level[0], np.array(kids)
        self.runs = [slice(self.starts[a], self.ends[b - 1]) for a, b in zip(first, last, strict=True)]
        self.rows = np.array([r.stop - r.start for r in self.runs])
        self.centre = np.array([self.f[r].mean(0) for r in self.runs])
        self.radius = np.array([np.sqrt(((self.f[r] - c) ** 2).sum(1).max()) for r, c in zip(self.runs, self.centre, strict=True)])
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.low, self.high = (np.array([f(self.labels[r]) for r in self.runs]) for f in (np.min, np.max))


def products(a: Block, rows: slice, c: Block, at: np.ndarray) -> np.ndarray:
    """Exact inner products, in 64-bit floats if they are exact there, else in 64-bit numbers."""
    if a.largest * c.largest * max(a.x.shape[1], 1) < 2.0**53:
        return (a.f[rows] @ c.f[at].T).astype(np.int64)
    return a.x[rows].astype(np.int64) @ c.x[at].astype(np.int64).T


class Search:
    """The best rows so far for each anchor of a block and each of its ranges of scores: the highest scores, ties by the least id."""

    def __init__(self, anchors: Block, k: int, same: bool):
        self.a, self.same, n = anchors, same, len(anchors.ids)
        if same:
            self.least, self.most = np.full((n, 1), _NONE + 1), np.full((n, 1), _LAST)
        else:
            p = anchors.scores.reshape(n, -1)
            whole, rest = np.divmod(p, 100)  # hundredths of each, so that nothing overflows
            self.least = np.where(p > _NONE, LOW * whole - (-LOW * rest) // 100, _LAST)
            self.most = np.where(p > _NONE, HIGH * whole + HIGH * rest // 100, _NONE)
        self.score = np.full((*self.least.shape, k), _NONE)
        self.id = np.full(self.score.shape, _LAST)

    def floor(self) -> np.ndarray:
        """The least score that an anchor can still use, by range."""
        return np.maximum(self.least, self.score[:, :, -1])

    def leaves(self, c: Block) -> tuple[np.ndarray, ...]:
        """Pairs of leaves (anchors', candidates') that may hold something of use, with the highest score possible."""
        a, need, most = self.a, self.floor().min(1), self.most.max(1)
        low = np.array([need[r].min() for r in a.runs], np.float64)
        high = np.array([most[r].max() for r in a.runs], np.float64)
        i, j, found = np.array([a.root]), np.array([c.root]), []
        while len(i):
            mid = (a.centre[i] * c.centre[j]).sum(1)
            reach = a.norm[i] * c.radius[j] + c.norm[j] * a.radius[i] + a.radius[i] * c.radius[j]
            reach += 1 + 1e-9 * (np.abs(mid) + reach)
            if self.same:
                fit = (a.low[i] <= c.high[j]) & (c.low[j] <= a.high[i])
            else:
                fit = (a.low[i] != a.high[i]) | (c.low[j] != c.high[j]) | (a.low[i] != c.low[j])
            fit &= (mid + reach >= low[i]) & (mid - reach <= high[i])
            i, j, top = i[fit], j[fit], (mid + reach)[fit]
            ends_a, ends_c = a.kids[i, 0] < 0, c.kids[j, 0] < 0
            done = ends_a & ends_c
            found.append((i[done], j[done], top[done]))
            open_c = ~done & (ends_a | ~ends_c & (c.rows[j] >= a.rows[i]))
            open_a = ~done & ~open_c
            i, j = np.concatenate([np.repeat(i[open_c], 2), a.kids[i[open_a]].ravel()]), np.concatenate([c.kids[j[open_c]].ravel(), np.repeat(j[open_a], 2)])
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def see(self, c: Block) -> None:
        """Takes in a block of candidates. Products that may be beyond 62 bits are an error."""
        if self.a.largest * c.largest * max(c.x.shape[1], 1) >= 2.0**62:
            raise ValueError("an inner product may be beyond 62 bits")
        la, lc, top = self.leaves(c)
        for leaf in np.unique(la):
            mine = np.flatnonzero(la == leaf)
            mine = mine[np.argsort(-top[mine], kind="stable")]
            rows, at = self.a.runs[leaf], 0
            while at < len(mine):
                need = self.floor()[rows].min()
                if top[mine[at]] < need:
                    break
                upto = at + max(1, int(np.searchsorted(np.cumsum(c.rows[lc[mine[at:]]]), AT_ONCE, "right")))
                got = [k for k in mine[at:upto] if top[k] >= need]
                self.score_leaf(rows, c, np.concatenate([np.arange(c.starts[k], c.ends[k]) for k in lc[got]]))
                at = upto

    def score_leaf(self, rows: slice, c: Block, at: np.ndarray) -> None:
        s = products(self.a, rows, c, at)
        equal = self.a.labels[rows][:, None] == c.labels[at][None, :]
        may = equal & (self.a.ids[rows][:, None] != c.ids[at][None, :]) if self.same else ~equal
        for p in range(self.least.shape[1]):
            ok = may & (s <= self.most[rows, p][:, None]) & (s >= self.floor()[rows, p][:, None])
            r, k = np.nonzero(ok)
            if len(r):
                self.keep(r + rows.start, p, s[r, k], c.ids[at[k]])

    def keep(self, r: np.ndarray, p: int, score: np.ndarray, ids: np.ndarray) -> None:
        own, k = np.unique(r), self.score.shape[2]
        r = np.concatenate([r, np.repeat(own, k)])
        score, ids = np.concatenate([score, self.score[own, p].ravel()]), np.concatenate([ids, self.id[own, p].ravel()])
        order = np.lexsort((ids, -score, r))
        r, score, ids = r[order], score[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        top = place < k
        self.score[r[top], p, place[top]], self.id[r[top], p, place[top]] = score[top], ids[top]

    def found(self) -> pa.RecordBatch:
        i, p, k = np.nonzero(self.score > _NONE)
        cols = (self.a.ids[i], p.astype(np.int32), self.id[i, p, k], self.score[i, p, k])
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["anchor", "p", "id", "score"])


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block of rows (id, label, vec[, scores]), in the order of its tree, with its ball."""

    def pack(key, part):
        d = key[1].as_py()
        part = part.sort_by("id")
        ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
        x = part["vec"].combine_chunks().flatten().to_numpy().reshape(len(part), d)
        order, ends = tree(x, labels)
        f = x.astype(np.float64)
        centre = f.mean(0)
        small = bool(np.abs(f).max(initial=0) < 1 << 15)
        scores = part["scores"].combine_chunks().take(pa.array(order)).flatten().to_numpy() if "scores" in part.column_names else np.empty(0, np.int64)
        blobs = (ids[order], labels[order], x[order].astype(np.int16 if small else np.int64), ends.astype(np.int64), scores)
        out = {c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(_BLOBS, blobs, strict=True)}
        ball = {"centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([float(np.sqrt(((f - centre) ** 2).sum(1).max()))])}
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "dims": pa.array([d], pa.int32()), "small": pa.array([small]), **out, **ball})

    cols = ["block", "dims", *rows.columns]
    shown = "block long, dims int, small boolean, " + ", ".join(f"{c} binary" for c in _BLOBS) + ", centre array<double>, radius double"
    return _dealt(rows, block).select(*cols).groupBy("block", "dims").applyInArrow(pack, shown)


def _searched(anchors: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, p, place, id, score): the k best candidates for each range p of each anchor. Both are packed blocks.

    Of each block of anchors the candidates' blocks go to a few tasks as a stream, in the order of the highest score possible. A pair of blocks
    meets in one task only.
    """
    spark = anchors.sparkSession
    names = [(r.block, r.dims, i) for i, r in enumerate(anchors.select("block", "dims").orderBy("dims", "block").collect())]  # one for ANCHOR_BLOCK anchors
    told = spark.createDataFrame(names, "block long, dims int, a int")
    chunks = max(1, -(-2 * shuffle_partitions(spark) // max(len(names), 1)))
    a = anchors.join(F.broadcast(told), ["block", "dims"])
    ball = a.select("a", "dims", F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    top = dot("ca", "centre") + norm("ca") * F.col("radius") + norm("centre") * F.col("ra") + F.col("ra") * F.col("radius")
    c = candidates.join(ball, "dims").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    c = c.select("a", "chunk", F.lit(1).alias("kind"), (-top).alias("turn"), "dims", "small", *_BLOBS)
    first = a.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("a", "chunk", F.lit(0).alias("kind"), F.lit(0.0).alias("turn"), "dims", "small", *_BLOBS)
    stream = first.union(c).repartition(F.col("a"), F.col("chunk")).sortWithinPartitions("a", "chunk", "kind", "turn")

    def run(batches):
        search = None
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in ("kind", "dims", "small")}
                row = {n: v.as_py() for n, v in row.items()} | {n: batch.column(n)[i].as_buffer() for n in _BLOBS}
                if row["kind"]:
                    search.see(Block(row))
                    continue
                if search is not None:
                    yield search.found()
                search = Search(Block(row), k, same)
        if search is not None:
            yield search.found()

    got = stream.mapInArrow(run, "anchor long, p int, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "id")).alias("place")
    return got.select("anchor", "p", place, "id", "score").filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ANCHOR, their positives the first other rows of the same label by the whole-number inner product, ties
    by the least id; the negatives of each the first rows of another label that score from LOW to HIGH hundredths of the positive. With fewer such rows
    all are taken; an anchor without a positive, or a positive without a negative, has no row. See quantized for nulls and repeated ids. Vectors of
    unequal lengths never meet. An inner product that may be beyond 62 bits is an error.
    """
    x = written(quantized(rows, vec_id, vector, label))
    all_rows = written(_packed(x, BLOCK))
    some = x.filter(F.col("id") % ANCHOR == 0)
    anchors = written(_packed(some, ANCHOR_BLOCK))
    first = written(_searched(anchors, all_rows, positives, True).select("anchor", (F.col("place") - 1).alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    drop_written(anchors)
    by_place = first.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("p", "positive_score"))).alias("of"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(_NONE)))
    with_scores = some.join(by_place, F.col("id") == F.col("anchor")).select("id", "label", "vec", scores.alias("scores"))
    anchors = written(_packed(with_scores, ANCHOR_BLOCK))
    found = written(_searched(anchors, all_rows, negatives, False))
    drop_written(anchors, all_rows, x)
    out = found.join(first, ["anchor", "p"])
    return out.select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: hard_negatives of embeddings in DuckDB's SQL, by all pairs of anchors and rows.
SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, c.id, a.label = c.label AS same, list_inner_product(a.vec, c.vec)::BIGINT AS score FROM v a JOIN v c ON a.id % 100 = 0 AND a.id <> c.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS positive, p.score AS ps, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS place
 FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, place::INT AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE place <= 10
"""
