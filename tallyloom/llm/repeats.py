"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier in the corpus go.

The corpus is too large for one suffix array, so windows of LENGTH bytes are dealt out by content: a window belongs to the least
hash among its K-byte strings. Equal windows have equal least hashes, so they meet; neighbouring windows mostly share theirs, so
a document gives a few per cent of its bytes as hashes.

1. Hashes that occur once in the corpus go; nothing else of their windows is ever moved.
2. For the others, each run of windows moves with its bytes to its hash; of equal runs in a task only the earliest moves, since
   the others go whole. Under a hash of very many runs (a passage that a great part of the corpus shares, each time beside other
   text), a run is first trimmed to those windows that are repeated, so that what moves is the shared text and not its surroundings.
3. At the hash, equal runs become one with its earliest place. A suffix array of the different strings that may be repeated is
   built by linear grouping. Windows that are neighbours in it and equal in all bytes form a class, whose earliest place stays.
4. The removed spans go back to their documents.

A document whose whole text occurs in an earlier one needs none of this and is left out of steps 1 and 2. Texts are
hashed by pieces of SEGMENT windows, so a very long text takes no more memory than its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, slices, written
from tallyloom.llm.shingles import mix
from tallyloom.llm.suffix_array import suffix_array

LENGTH, K = 100, 32
#: Up to so many repeated hashes or ids (8 bytes each) are broadcast; beyond, they meet the documents by a shuffle.
BROADCAST_HASHES = 3_000_000
#: Up to so many texts that have copies (some 100 bytes each) are broadcast.
BROADCAST_COPIES = 300_000
#: Bytes of different runs that are worked on at once; a hash with more is worked on alone.
CHUNK = 250_000
#: Windows of a text that are hashed at once, and bytes of runs that a task holds to merge equal ones.
SEGMENT, HELD = 65_536, 4_000_000
#: A hash that occurs more often has its runs trimmed first.
HOT = 10_000

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_NULL = -(2**63)


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of `length` bytes, made of those of its parts, whose lengths are powers of two."""
    n, out, at, step = max(0, len(data) - length + 1), None, 0, 1
    h = _TABLE[data]
    while step <= length:
        if step & length:
            part = h[at : at + n]
            out = part.copy() if out is None else out * np.uint64(0xD1342543DE82EF95 + 2 * step) + part
            at += step
        if step * 2 <= length:
            h = h[:-step] * np.uint64(0x2545F4914F6CDD1D + 2 * step) + h[step:] if len(h) > step else h[:0]
        step *= 2
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, twice) of each run of windows of equal least K-byte string.

    twice: whether the run may hold this string at several places, so that its own windows may be equal; true of all that do.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h, width = string_hashes(data, k), length - k + 1
    least = sliding_min(h, width)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:] - 1, len(least) - 1]
    # a string is the least of some window if its hash is the largest of the least ones of all windows that hold it
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(~sliding_min(~np.concatenate([edge, least, edge]), width) == h)
    # a run's next place of the same string follows without another string's place between
    pair = np.flatnonzero(h[places[1:]] == h[places[:-1]])
    twice = np.searchsorted(places[pair + 1], last + width) > np.searchsorted(places[pair], first)
    return least[first], first, last, twice


def segments(text: bytes, length: int = LENGTH):
    """(start, bytes) of the parts of a text, each with SEGMENT windows at most; each window is in one part."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - length + 1, SEGMENT):
        yield at, data[at : at + SEGMENT + length - 1]


def _cut(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the stretches of ascending numbers without a gap."""
    new = np.r_[True, marked[1:] != marked[:-1] + 1] if len(marked) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return marked[first], marked[np.r_[first[1:] - 1, len(marked) - 1]] if len(marked) else marked


def classes(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, class) of all windows of the texts, in the order of their suffix array: equal windows are one class, and neighbours."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    joined = np.zeros(offsets[-1], np.uint16)  # 0 ends a text
    for t, at in zip(texts, offsets[:-1].tolist(), strict=True):
        joined[at : at + len(t)] = np.frombuffer(t, np.uint8)
        joined[at : at + len(t)] += 1
    rank = np.frombuffer(suffix_array(joined.tolist()), np.int32).astype(np.int64)
    owner = np.searchsorted(offsets, rank, "right") - 1
    whole = rank + length < offsets[owner + 1]  # whole windows only
    rank, owner = rank[whole], owner[whole]
    view = np.lib.stride_tricks.sliding_window_view(joined, length)
    new = np.ones(len(rank), bool)
    for at in range(1, len(rank), 5_000):
        x = view[rank[at - 1 : at + 5_000]]
        new[at : at + 5_000] = (x[1:] != x[:-1]).any(axis=1)
    return owner, rank - offsets[owner], np.cumsum(new)


def repeated_runs(runs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Spans (id, text key, start, end) to remove, from different runs (hash, id, text key, start, bytes) that hold all of their hashes.

    Places are ordered by id, text key and start.
    """
    data = b"".join(r[4] for r in runs)
    sizes = np.fromiter((len(r[4]) for r in runs), np.int64, len(runs))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    hashes = string_hashes(np.frombuffer(data, np.uint8), length)
    owner = np.repeat(np.arange(len(runs), dtype=np.int32), sizes)[: len(hashes)]
    where = np.flatnonzero(np.arange(len(hashes)) + length <= ends[owner])
    hashes = hashes[where]
    order = np.argsort(hashes)
    again = hashes[order[1:]] == hashes[order[:-1]]
    marked = np.zeros(len(where), bool)
    marked[order[1:][again]] = marked[order[:-1][again]] = True
    # the strings whose windows may be repeated, each once with its earliest place; whole windows of two runs are no neighbours
    first, last = stretches(where[marked])
    out: list[tuple] = []
    earliest: dict[bytes, tuple] = {}
    for a, b, r in zip(first.tolist(), last.tolist(), owner[first].tolist(), strict=True):
        spot, text = (*runs[r][1:3], runs[r][3] + a - int(begins[r])), data[a : b + length]
        other = earliest.setdefault(text, spot)
        if other != spot:
            if spot < other:
                earliest[text], spot = spot, other
            out.append((*spot, spot[2] + len(text)))
    if not earliest:
        return out
    texts = list(earliest)
    owner, offset, group = classes(texts, length)
    docs = sorted({s[:2] for s in earliest.values()})
    number = {d: i for i, d in enumerate(docs)}
    doc = np.array([number[s[:2]] for s in earliest.values()])[owner]
    start = np.array([s[2] for s in earliest.values()])[owner] + offset
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    gone = np.r_[False, group[1:] == group[:-1]] if len(group) else np.empty(0, bool)
    doc, start = doc[gone], start[gone]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)]) if len(doc) else np.empty(0, np.int64)
    stop = start[np.r_[new[1:] - 1, len(doc) - 1]] + length if len(doc) else start
    return out + [(*docs[d], a, b) for d, a, b in zip(doc[new].tolist(), start[new].tolist(), stop.tolist(), strict=True)]


class Merged:
    """Runs of a task of which equal ones become one: rows (hash, id, key, start, end, run) of the earliest, and spans (no run) of the others."""

    def __init__(self, length: int):
        self.length, self.held, self.size, self.rows, self.spans = length, {}, 0, [], []

    def add(self, h: int, spot: tuple, text: bytes) -> None:
        other = self.held.setdefault(text, (h, spot))[1]
        if other is spot:
            self.size += len(text)
        else:
            if spot < other:
                self.held[text], spot = (h, spot), other
            self.spans.append((*spot, spot[2] + len(text)))

    def batch(self, last: bool = False) -> pa.RecordBatch:
        """What is settled; the runs too, if they are many."""
        by: dict[tuple, list] = {}
        for i, key, a, b in self.spans:
            by.setdefault((i, key), []).append((a, b))
        # a span needs no hash: its document's key spreads it
        rows = [(key, i, key, a, b, None) for (i, key), s in by.items() for a, b in _cut(s)]
        self.spans = []
        if last or self.size > HELD:
            rows += [(h, *spot, 0, text) for text, (h, spot) in self.held.items()]
            self.held, self.size = {}, 0
        cols = list(zip(*rows, strict=True)) or [()] * 6
        ids = [None if i == _NULL else i for i in cols[1]]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((cols[0], ids, *cols[2:]), kinds, strict=True)], names=["h", "id", "key", "start", "end", "run"])


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _sorted(table: DataFrame, column: str) -> np.ndarray:
    return np.sort(table.select(column).toArrow()[column].to_numpy())


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(id, key, start, end) of spans to remove, for docs (id, key, text) of different (id, key)."""
    spark = docs.sparkSession

    def counted(found):
        h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    def texts(batch):
        return (t.as_py() for t in batch.column(2) if t.is_valid)

    def hashed(batches):
        for batch in slices(batches):
            found = [anchors(x, length, k) for t in texts(batch) for _, x in segments(t, length)]
            yield counted([x for h, _, _, again in found for x in (h, h[again])])

    twice = written(docs.mapInArrow(hashed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    hot = twice.filter(F.col("n") > HOT).select("h")
    trim = spark.sparkContext.broadcast((np.empty(0, np.int64), np.empty(0, np.int64)))
    if 0 < hot.count() <= BROADCAST_HASHES:
        names = spark.sparkContext.broadcast(_sorted(hot, "h"))

        def hot_windows(batches):
            for batch in slices(batches):
                found = []
                for t in texts(batch):
                    for _, x in segments(t, length):
                        h, first, last, _ = anchors(x, length, k)
                        hit = np.flatnonzero(_among(names.value, h.view(np.int64)))
                        if len(hit):
                            w = string_hashes(x, length)
                            found += [w[a : b + 1] for a, b in zip(first[hit].tolist(), last[hit].tolist(), strict=True)]
                yield counted(found)

        # repeated windows under hot hashes: as many as the shared texts have, however many documents share them
        windows = written(docs.mapInArrow(hot_windows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
        if windows.count() <= BROADCAST_HASHES:
            trim = spark.sparkContext.broadcast((names.value, _sorted(windows, "h")))
        drop_written(windows)
    if twice.count() <= BROADCAST_HASHES:
        held = spark.sparkContext.broadcast(_sorted(twice, "h"))
        drop_written(twice)
        source = docs.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        held = None

        def listed(batches):
            for batch in slices(batches):
                for i, key, t in zip(*(batch.column(c) for c in range(3)), strict=True):
                    h = np.unique(np.concatenate([np.empty(0, np.uint64), *(anchors(x, length, k)[0] for _, x in segments(t.as_py() or b"", length))]))
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(h), pa.int64()), pa.array([key.as_py()] * len(h), pa.int64()), pa.array(h.view(np.int64))], names=["i", "k", "h"])

        own = docs.mapInArrow(listed, "i long, k long, h long").join(twice, "h", "left_semi").groupBy("i", "k").agg(F.collect_list("h").alias("own"))
        source = docs.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select("id", "key", "text", "own")

    def cut(batches):
        (hot, repeated), merged = trim.value, Merged(length)
        for batch in slices(batches):
            for i, key, t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                t, i = t.as_py() or b"", _NULL if i is None else i
                known = held.value if held is not None else np.sort(np.array(own.as_py(), np.int64))
                for at, x in segments(t, length):
                    h, first, last, _ = anchors(x, length, k)
                    h = h.view(np.int64)
                    hit = np.flatnonzero(_among(known, h))
                    many = _among(hot, h[hit])
                    for name, a, b in zip(h[hit[~many]].tolist(), first[hit[~many]].tolist(), last[hit[~many]].tolist(), strict=True):
                        merged.add(name, (i, key, at + a), t[at + a : at + b + length])
                    if many.any():
                        again = _among(repeated, string_hashes(x, length).view(np.int64))
                        for name, a, b in zip(h[hit[many]].tolist(), first[hit[many]].tolist(), last[hit[many]].tolist(), strict=True):
                            for lo, hi in zip(*(s.tolist() for s in stretches(a + np.flatnonzero(again[a : b + 1]))), strict=True):
                                merged.add(name, (i, key, at + lo), t[at + lo : at + hi + length])
                    if merged.size > HELD:
                        yield merged.batch()
            if merged.spans:
                yield merged.batch()
        yield merged.batch(last=True)

    def grouped(batches):
        waiting, size, at, run = [], 0, None, None
        spans: list[tuple] = []
        for batch in slices(batches):
            for h, i, key, start, end, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = _NULL if i is None else i
                if text is None:
                    spans.append((i, key, start, end))
                elif h == at and text == run:  # rows come by place
                    spans.append((i, key, start, start + len(text)))
                else:
                    if size >= CHUNK and h != at:
                        yield done(repeated_runs(waiting, length))
                        waiting, size = [], 0
                    at, run = h, text
                    waiting.append((h, i, key, start, text))
                    size += len(text)
            if spans:
                yield done(spans)
                spans = []
        if waiting:
            yield done(repeated_runs(waiting, length))

    def done(found):
        spans: dict[tuple, list] = {}
        for i, key, a, b in found:
            spans.setdefault((i, key), []).append((a, b))
        rows = [(None if i == _NULL else i, key, a, b) for (i, key), s in spans.items() for a, b in _cut(s)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "key", "start", "end"])

    schema = "h long, id long, key long, start long, end long, run binary"
    runs = source.mapInArrow(cut, schema).repartition("h").sortWithinPartitions("h", "run", "id", "key", "start")
    return runs.mapInArrow(grouped, "id long, key long, start long, end long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as text) for every row.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a document of smaller id, or before in
    the same one. Strings are judged on the input. Null texts are empty. Rows with one id and one text are one document and get the
    same result; rows with one id and different texts are ordered by a hash of the text; null ids come first.
    Texts of any length and periodic ones are taken by parts. Other columns of docs don't matter; an empty table gives none.
    """
    x = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    x = x.withColumns({"key": F.xxhash64("text"), "size": F.length("text")})
    marks = written(x.filter(F.col("size") >= length).select("id", "key", "size", F.md5("text").alias("same")).distinct())
    place = F.struct(F.coalesce("id", F.lit(_NULL)).alias("i"), F.col("key").alias("k"))
    firsts = written(marks.groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first"))
    near = F.broadcast(firsts) if firsts.count() <= BROADCAST_COPIES else firsts  # a row for each text with copies, however many these are
    copies = written(marks.join(near, "same").filter(place != F.col("first")).select("id", "key", "size"))
    n = copies.count()
    whole = x.filter(F.col("size") >= length)
    gone = F.broadcast(copies.select(F.col("id").alias("i"), F.col("key").alias("k"))) if n <= BROADCAST_HASHES else copies.select(F.col("id").alias("i"), F.col("key").alias("k"))
    rest = whole.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_anti") if n else whole
    rest = rest.select("id", "key", "text")
    spans = repeated_spans(rest, length, k).union(copies.select("id", "key", F.lit(0).cast("long"), F.col("size").cast("long")))
    spans = written(spans.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).withColumnsRenamed({"id": "i", "key": "k"}))
    drop_written(marks, firsts, copies)

    def kept(batches):
        for batch in slices(batches):
            out = [[], [], [], [], []]
            for t, s in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = t.as_py()
                cut = _cut([(p["start"], p["end"]) for p in s or ()])
                if cut:
                    left, at = [], 0
                    for a, b in cut:
                        left.append(t[at:a])
                        at = b
                    left = b"".join([*left, t[at:]])
                else:
                    left = t
                for c, v in zip(out, (len(t), len(t) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = x.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").select("id", "text", "spans")
    out = joined.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary")
    return out if with_text else out.drop("text")


#: remove_repeats of documents in DuckDB's SQL, by all windows at once.
SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(1, n - 98)) AS pos, b FROM d WHERE n >= 100),
x AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY b[pos:pos + 99] ORDER BY doc_id, pos) AS place FROM w),
-- runs of repeated windows that touch or overlap are one span
r AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER o + 100, true) AS new FROM x WHERE place > 1 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, pos, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM r),
t AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS z FROM s GROUP BY doc_id, span),
-- what is left stands before each span and after the last one
k AS (SELECT t.doc_id, a, coalesce(lag(z) OVER o, 1) AS f, a - 1 AS l, z FROM t WINDOW o AS (PARTITION BY t.doc_id ORDER BY a)),
e AS (SELECT doc_id, f, l FROM k UNION ALL SELECT doc_id, max(z), NULL FROM k GROUP BY doc_id),
h AS (SELECT e.doc_id, string_agg(hex(d.b[e.f:coalesce(e.l, d.n)]), '' ORDER BY e.f) AS kept FROM e JOIN d USING (doc_id) WHERE e.f <= coalesce(e.l, d.n) GROUP BY e.doc_id),
c AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS gone FROM t GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
 CASE WHEN c.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept, ''))) END AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id)
"""
