"""Near-duplicate documents by HyperMinHash (Yu and Weber, 2017).

A document's set of shingle hashes is cut into buckets by the leading bits; each bucket keeps of its least hash the number of
leading zeros and the next mantissa bits: 16 bits. Empty buckets borrow from others in an order fixed for each bucket
(optimal densification, Shrivastava 2017), so short documents have whole sketches too. Bands of four registers find candidates,
all registers estimate their resemblance (corrected for chance collisions), and what isn't clearly below the threshold
is compared on the full sets.

Work is kept in proportion:
1. Documents of equal sets become one representative.
2. In every band bucket, each member is compared with the least only (a star).
3. Links so far give components. Only buckets that still hold several go on. There, pairs of different components are estimated, each
   pair in the first band that it shares. What passes is verified: in small buckets as pairs, in large ones in place, with the members' sets, by
   blocks bounded in members and bytes, where a link found makes the other pairs of its two components needless.
4. The members of buckets of over LARGE go to the next of LEVELS instead, where more registers make a key and more keys a document, so
   that the buckets of documents that aren't linked come apart while linked ones still meet as surely; steps 2 and 3 again. So no pair that shares
   a band is left out.

Full sets are written once, of the documents that share a bucket with others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, drop_written, join_spread, slices, spare, written
from tallyloom.llm.components import components
from tallyloom.llm.shingles import WordHashes, mix, shingle_set

WIDTH, PERCENT = 5, 80
#: Registers (a power of two) and mantissa bits of a sketch.
REGISTERS, MANTISSA = 256, 10
#: Registers in a key and keys of a document, by level: two documents at the threshold share none with a probability under 1e-7.
LEVELS = ((4, 32), (8, 88))
#: Standard deviations of an estimate below the threshold, beyond which a pair isn't verified.
MARGIN = 5.0
#: Buckets of more members are verified in place, by blocks of so many and of so many bytes of sets; each two blocks meet once.
SMALL, BLOCK, BLOCK_BYTES = 64, 1_000, 8_000_000
#: Buckets of more members go to the next level, if there is one.
LARGE = 20_000
#: Bytes of sets that a task gives out at once.
SET_BYTES = 8_000_000
#: Up to so many ids (8 bytes each) are broadcast; beyond, documents meet them by a shuffle.
BROADCAST_IDS = 2_000_000

_BITS = REGISTERS.bit_length() - 1
_REST = 64 - _BITS


def _orders() -> np.ndarray:
    """For each bucket the order in which it looks for another to borrow from."""
    at = np.arange(REGISTERS, dtype=np.uint64)
    return np.argsort(mix(mix(at + np.uint64(1))[:, None] + at[None, :]), axis=1, kind="stable")


_ORDER = _orders()


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of sorted distinct hashes (at least one), uint16 each."""
    starts = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_REST)
    first = hashes[np.minimum(np.searchsorted(hashes, starts), len(hashes) - 1)]
    full = first >> np.uint64(_REST) == starts >> np.uint64(_REST)
    frac, exp = np.frexp((first & np.uint64((1 << _REST) - 1)).astype(np.float64))
    zeros = _REST - exp
    mantissa = np.clip((frac * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1)
    values = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        values[empty] = values[_ORDER[empty, full[_ORDER[empty]].argmax(axis=1)]]
    return values


def collisions(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Chance that a register of two disjoint sets of these sizes is equal.

    A register value stands for a cell of width 2^-(z+1) / 2^MANTISSA; a bucket's least hash falls into it with about
    load * width * exp(-load * place). The products are summed over the cells of each z in closed form.
    """
    a, b = np.maximum(n1 / REGISTERS, 1e-9), np.maximum(n2 / REGISTERS, 1e-9)
    z = np.arange(_REST)[:, None]
    high, low = 2.0**-z, 2.0 ** -(z + 1)
    cell = low / (1 << MANTISSA)
    return np.minimum((a * b * cell * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high)) / (a + b)).sum(axis=0), 0.5)


def estimate(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Resemblance from the number of equal registers."""
    c = collisions(np.asarray(n1, float), np.asarray(n2, float))
    return np.clip((equal / REGISTERS - c) / (1 - c), 0, 1)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - MARGIN * (j * (1 - j) / REGISTERS) ** 0.5


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, k1, k2, regs, sk): set size, the set's 128-bit key, registers, and a bit of each of the registers 0 to 127."""
    salt = mix(np.arange(128, dtype=np.uint64) * np.uint64(7919))

    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            ids, n, k, regs, sk = batch.column(0), [], [], [], []
            for t in batch.column(1):
                s = shingle_set(words.of(t.as_py()), width)
                n.append(len(s))
                k.append(xxhash.xxh128_intdigest(s.tobytes()))
                r = registers(s) if len(s) else None
                regs.append(None if r is None else r.tobytes())
                sk.append(None if r is None else np.packbits((mix(r[:128] + salt) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            k = np.array([[x >> 64, x & (1 << 64) - 1] for x in k], np.uint64).reshape(-1, 2).view(np.int64)
            sk1, sk2 = ([None if x is None else int(x[i]) for x in sk] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(regs, pa.binary()), pa.array(sk1, pa.int64()), pa.array(sk2, pa.int64())], names=["id", "n", "k1", "k2", "regs", "sk1", "sk2"])

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, regs binary, sk1 long, sk2 long")


def _places(level: int) -> np.ndarray:
    """The registers of each key of a level: in order at the first one, else drawn in rounds that use all registers alike."""
    rows, keys = LEVELS[level]
    if not level:
        return np.arange(rows * keys).reshape(keys, rows)
    rng = np.random.default_rng(level)
    drawn = np.concatenate([rng.permutation(REGISTERS)[: REGISTERS // rows * rows] for _ in range(-(-keys * rows // (REGISTERS // rows * rows)))])
    return drawn[: keys * rows].reshape(keys, rows)


def _keys(regs: np.ndarray, level: int) -> np.ndarray:
    """The keys of sketches: a hash of the key's number and registers, 64 bits."""
    places = _places(level)
    acc = np.broadcast_to(mix(np.arange(1, len(places) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (len(regs), len(places)))
    for k in range(places.shape[1]):
        acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + regs[:, places[:, k]])
    return acc


def _banded(named: DataFrame, level: int) -> DataFrame:
    """(bucket, band, id, n, sk1, sk2) for each key of (id, n, regs, sk1, sk2)."""

    def run(batches):
        for batch in slices(batches):
            for at in range(0, len(batch), 2_000):
                part = batch.slice(at, 2_000)
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = _keys(regs, level)
                row = pa.array(np.repeat(np.arange(len(part)), keys.shape[1]))
                band = pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), band, *(part.column(c).take(row) for c in ("id", "n", "sk1", "sk2"))], names=["bucket", "band", "id", "n", "sk1", "sk2"])

    return named.select("id", "n", "regs", "sk1", "sk2").mapInArrow(run, "bucket long, band int, id long, n long, sk1 long, sk2 long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, regs, hashes) of the documents with these ids, from their texts."""
    spark = docs.sparkSession
    if ids.count() <= BROADCAST_IDS:
        held = spark.sparkContext.broadcast(np.sort(ids.toArrow()["id"].to_numpy()))
    else:
        held, docs = None, docs.join(ids, "id", "left_semi")

    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            i, found, size = batch.column(0), [], 0
            if held is not None and len(held.value):
                at = i.fill_null(-(2**63)).to_numpy()
                hit = np.flatnonzero(held.value[np.minimum(np.searchsorted(held.value, at), len(held.value) - 1)] == at)
            else:
                hit = np.arange(len(i) if held is None else 0)
            for k in [*hit.tolist(), -1]:
                if k >= 0 and len(s := shingle_set(words.of(batch.column(1)[k].as_py()), width)):
                    found.append((k, registers(s).tobytes(), s.tobytes()))
                    size += s.nbytes
                if k < 0 or size > SET_BYTES:
                    at, regs, hashes = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([i.take(pa.array(at, pa.int64())), pa.array(regs, pa.binary()), pa.array(hashes, pa.binary())], names=["id", "regs", "hashes"])
                    found, size = [], 0

    return docs.mapInArrow(run, "id long, regs binary, hashes binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, not empty) resemble each other by at least percent / 100."""
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets resemble each other, compared in full."""
    first = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))

    def run(batches):
        for batch in slices(batches):
            a, b, ha, hb = (batch.column(k) for k in ("a", "b", "ha", "hb"))
            sure = [k for k in range(len(a)) if linked(np.frombuffer(ha[k].as_buffer(), np.uint64), np.frombuffer(hb[k].as_buffer(), np.uint64), percent)]
            keep = pa.array(sure, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])

    return written(pairs.join(first, "a").join(second, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long").distinct())


def _open(crowded: DataFrame, parts: DataFrame) -> DataFrame:
    """(bucket, band, members, bytes, id, n, comp) of the members of buckets of three and more that hold several components."""
    x = crowded.filter("members > 2").join(parts.withColumnRenamed("id", "pid"), F.col("id") == F.col("pid"), "left").withColumn("comp", F.coalesce("component", "id"))
    mixed = x.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.col("n") * 8).alias("bytes")).filter("lo < hi").select("bucket", "bytes")
    mixed = written(mixed)
    near = F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed
    out = written(x.join(near, "bucket").select("bucket", "band", "members", "bytes", "id", "n", "comp"))
    drop_written(mixed)
    return out


def _rest(buckets: DataFrame, percent: int, level: int) -> DataFrame:
    """Pairs (a, b) of different components in one block of a bucket, by estimate, each in the first band that it shares.

    With a column of the members' sets (hashes) these are links: compared in full, and only those that join components that
    others haven't joined.
    """
    least = least_estimate(percent)

    def run(key, rows):
        band, same_block = key[1].as_py(), key[2].as_py() == key[3].as_py()
        ids, comp, n = (rows[c].to_numpy() for c in ("id", "comp", "n"))
        regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows["hashes"]] if "hashes" in rows.column_names else None
        block, places = rows["block"].to_numpy(), _places(level)
        names, where, count = np.unique(comp, return_inverse=True, return_counts=True)
        joined = np.arange(len(names))  # the components' sets of this block
        main = where == count.argmax()
        out = []
        for k in np.flatnonzero(~main):
            # with the main component, and with the other ones once
            mate = (where != where[k]) & (main | (ids > ids[k]))
            if not same_block:
                mate &= block != block[k]
            mate &= (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])) & (joined[where] != joined[where[k]])
            m = np.flatnonzero(mate)
            if not len(m):
                continue
            eq = regs[m] == regs[k]
            near = estimate(np.count_nonzero(eq, axis=1), n[m], np.full(len(m), n[k])) >= least
            shared = eq[near][:, places].all(axis=2).argmax(axis=1) == band
            for j in m[near][shared]:
                if sets is not None:
                    x, y = joined[where[k]], joined[where[j]]
                    if x == y or not linked(sets[k], sets[j], percent):
                        continue
                    joined[joined == x] = y
                out.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    blocks = F.when(F.col("members") > SMALL, blocks).otherwise(1)
    x = buckets.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    cols = ["id", "comp", "n", "regs", "block", *[c for c in x.columns if c == "hashes"]]
    return x.select("bucket", "band", "low", "high", *cols).groupBy("bucket", "band", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents are linked if 100 * |A & B| >= percent * |A | B|.

    Sets hold distinct runs of `width` words (A-Z lower-cased); fewer words are one run; without words or text the set is
    empty, linked with nothing, and its own component. component_id is the least id reachable, kept marks it. Rows of one
    id are one document for links. A null id is in its set's component but never its name: kept is then false,
    and its component_id null if no row with an id is there. Links are found on candidates that share a band: a pair at the threshold
    does with a probability over 1 - 1e-7, one above it with more, and is estimated out with one under 1e-6.
    """
    x = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    sig = written(_signatures(x, width))
    reps = written(sig.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("sk1").alias("sk1"), F.first("sk2").alias("sk2"), F.count("*").alias("copies")))
    named = reps.filter("id is not null")
    j = percent / 100
    most_apart = int(64 * (1 - j) + (MARGIN + 1.5) * (128 * (1 + j) / 2 * (1 - j) / 2) ** 0.5)

    sets = parts = None
    for level in range(len(LEVELS)):
        bands = _banded(named, level)
        centre = written(bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("id", "n", "sk1", "sk2")).alias("c")).filter("members > 1"))
        apart = F.bit_count(F.col("sk1").bitwiseXOR(F.col("c.sk1"))) + F.bit_count(F.col("sk2").bitwiseXOR(F.col("c.sk2")))
        crowded = join_spread(bands, centre, ["bucket"], "members", "id").select("bucket", "band", "id", "n", "members", F.col("c.id").alias("c"), apart.alias("apart"), F.col("c.n").alias("cn"))
        crowded = written(crowded)
        may = (F.col("apart") <= most_apart) & (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn"))
        star = crowded.filter((F.col("id") != F.col("c")) & may)
        if sets is None:  # later levels have none but members of larger buckets
            ids = written(star.select("id").union(star.select("c")).union(crowded.filter("members > 2").select("id")).distinct())
            sets = written(_sets(x, ids, width))
            drop_written(ids)
        star = star.select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
        if parts is not None:
            star = _apart(star, parts)
        star = written(star)
        parts = _joined(parts, _verified(star, sets, percent))
        drop_written(star)

        # buckets of two are settled; of the others, those with members of several components go on
        open_ = _open(crowded, parts)
        drop_written(centre, crowded)
        most = 2**62 if level == len(LEVELS) - 1 else LARGE
        pairs = written(_rest(open_.filter(F.col("members") <= SMALL).join(sets.select("id", "regs"), "id"), percent, level))
        links = [_verified(pairs, sets, percent)]
        in_place = open_.filter((F.col("members") > SMALL) & (F.col("members") <= most))
        if not in_place.isEmpty():
            links.append(written(_rest(in_place.join(sets, "id"), percent, level)))
        parts = _joined(parts, *links)
        rest = open_.filter(F.col("members") > most).select("id").distinct()
        more = None if rest.isEmpty() else written(named.join(rest, "id", "left_semi"))
        drop_written(open_, pairs)
        if more is None:
            break
        named = more
    drop_written(sets)

    of_set = reps.select("k1", "k2", "copies", F.col("id").alias("rep")).join(parts, F.col("rep") == F.col("id"), "left").select("k1", "k2", "copies", F.coalesce("component", "rep").alias("component_id"))
    of_set = written(of_set)
    drop_written(parts, reps)
    out = join_spread(sig.filter("n > 0").select("id", "n", "k1", "k2"), of_set, ["k1", "k2"], "copies", "id")
    out = out.select("id", "n", "component_id").union(sig.filter("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _joined(parts: DataFrame | None, *links: DataFrame) -> DataFrame:
    """(id, component) of the links and those before."""
    before = [] if parts is None else [parts.select(F.col("id").alias("a"), F.col("component").alias("b"))]
    out = written(components(reduce(DataFrame.union, [*links, *before])).distinct())
    drop_written(parts, *links)
    return out


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs that aren't in one component yet."""
    for side in ("a", "b"):
        own = parts.select(F.col("id").alias(side), F.col("component").alias(f"in_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"in_{side}", F.coalesce(f"in_{side}", side))
    return pairs.filter("in_a != in_b").select("a", "b")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, of the least id; all columns stay.

    Rows of one id are one document: of these one stays, that of least text hash. A row without an id is a document by its text, after all
    that have one: it goes if its component has such, and of equal ones one stays. Rows without an id and without words are
    linked with nothing and stay.
    """
    key, row = spare(docs, "id_of"), spare(docs, "row_of")
    made = F.when(F.col(text).cast("string").rlike(WORD), F.xxhash64(text).bitwiseAND((1 << 61) - 1).bitwiseOR(1 << 62))
    x = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), made))
    marks = near_duplicates(x.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", "text", width, percent)
    marks = written(marks.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("n > 1 or not kept").select(F.col("doc_id").alias(key), "kept"))
    gone, many = marks.filter("not kept").select(key), marks.filter("kept").select(key)
    near = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_IDS else ids
    x = x.join(near(gone, gone.count()), key, "left_anti")
    if not (n := many.count()):
        return x.select(*docs.columns)
    one = x.join(near(many, n), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.md5(F.col(text).cast("binary"))).alias(row))
    return x.join(near(many, n), key, "left_anti").select(*docs.columns).union(one.select(f"{row}.*"))


#: near_duplicates of documents by two-word shingles in DuckDB's SQL, by all pairs that a prefix filter leaves.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, w[i:i + 1] AS g FROM p),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- a prefix filter: of two sets that are linked, the least tenths and a bit of both have a shingle in common
o AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS nth FROM s JOIN c USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g)),
q AS (SELECT doc_id, g, n FROM o WHERE nth <= n - ceil(0.8 * n) + 1),
m AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM q a JOIN q b USING (g) WHERE a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)),
v AS (SELECT m.a, m.b FROM m JOIN s x ON x.doc_id = m.a JOIN s y ON y.doc_id = m.b AND y.g = x.g JOIN c ca ON ca.doc_id = m.a JOIN c cb ON cb.doc_id = m.b
 GROUP BY m.a, m.b, ca.n, cb.n HAVING 100 * count(*) >= 80 * (ca.n + cb.n - count(*))),
e AS (SELECT a, b FROM v UNION ALL SELECT b, a FROM v),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, min(r.root) AS component_id, min(r.root) = d.doc_id AS kept FROM d LEFT JOIN c USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, c.n
"""
