"""N-gram Jaccard join by a token-group matrix: exact links between documents whose shingle sets resemble each other.

1. Documents of equal sets become one. A document's shingles are put in one order for all: those of crowded counters last. The counters are
   a table of fixed size, filled from all documents, so they cost the same at every size.
2. If two sets are linked, their first shingles in this order, some sixth of all and a few more, have a number of shingles in common
   (`shared`). Only shingles that are among the first ones of two documents go on: the others can't decide.
3. Documents that share the three least of four kinds of hashes are compared with one of them, so that most of what is linked is connected
   before groups meet.
4. Groups: each document goes with those whose most common first shingle is the same, so variants of one text are together, linked or not.
   The matrix has a row for each shingle and group that has it among its members' first ones: the union of the group's tokens, as far as
   they can decide. It bounds from above how much a document can have in common with any member; only groups that reach what the document
   needs are opened, the larger group of two by the smaller one's members, and a group by its own members but for its largest component.
5. An opened group's members meet the documents that ask for it in blocks of bounded size. There the whole union bounds once more, then sets
   are compared in full. A document needs one link with each component.

Components of all links are the result. No pair at the threshold is lost, whatever the groups are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import HOT_ROWS, drop_written, join_spread, slices, written
from tallyloom.llm.components import components
from tallyloom.llm.shingles import WordHashes, mix, shingle_set

WIDTH, PERCENT = 4, 85
#: Counters of shingles (a power of two), and kinds of hashes and hashes of each that make a key.
COUNTERS, KINDS, LEAST = 1 << 18, 4, 3
#: Shingles that two sets of 64 more shingles must have in common among their first ones.
MORE = 64
#: Bytes of sets of a block, and of a task's output at once.
BLOCK_BYTES = 8_000_000
#: Rows of one shingle (documents times groups) that a task pairs at most, about.
PAIRED = 1_000_000
#: Up to so many ids (8 bytes each) are broadcast; beyond, documents meet them by a shuffle.
BROADCAST_IDS = 2_000_000
#: A counter is crowded if it has over so many times the mean.
CROWDED = 4

_BITS = np.uint64(64 - (COUNTERS.bit_length() - 1))


def needed(n, percent: int):
    """What a set of n shingles has in common with any set that it is linked with, at least."""
    return -(-percent * n // 100)


def extra(n):
    """How many shingles of the first ones a linked pair has in common at least, by the smaller set's size."""
    return 1 + n // MORE


def first_of(n: int, percent: int) -> int:
    """How many shingles are a set's first ones."""
    return min(n, n - needed(n, percent) + extra(n))


def shared(n, percent: int):
    """How many of its first shingles a set of n must find in another's: those of the smallest set that it can be linked with."""
    return extra(needed(n, percent))


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set (sorted hashes) in the order for all documents: by the counter that a shingle falls into, then by hash."""
    return s[np.argsort(counts[(mix(s) >> _BITS).astype(np.int64)], kind="stable")]


def _described(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, k1, k2, keys) of each document, keys: KINDS hashes of its LEAST least; and for each task (counter rows) id and keys null,
    the counters' numbers in `counts`."""
    salts = mix(np.arange(1, KINDS + 1, dtype=np.uint64))

    def run(batches):
        words, counts, some = WordHashes(), np.zeros(COUNTERS, np.int64), False
        names = ["id", "n", "k1", "k2", "keys", "counts"]
        for batch in slices(batches):
            n, k, keys = [], [], []
            for t in batch.column(1):
                s = shingle_set(words.of(t.as_py()), width)
                n.append(len(s))
                k.append(xxhash.xxh128_intdigest(s.tobytes()))
                if not len(s):
                    keys.append(None)
                    continue
                m = mix(s)
                counts += np.bincount((m >> _BITS).astype(np.int64), minlength=COUNTERS) if len(s) > COUNTERS // 8 else 0
                if len(s) <= COUNTERS // 8:
                    np.add.at(counts, (m >> _BITS).astype(np.int64), 1)
                some = True
                own = []
                for salt in salts:
                    h = mix(m ^ salt)
                    h = np.sort(np.partition(h, LEAST - 1)[:LEAST] if len(h) > LEAST else h)
                    own.append(xxhash.xxh3_64_intdigest(h.tobytes(), int(salt)) - (1 << 63))
                keys.append(own)
            k = np.array([[x >> 64, x & (1 << 64) - 1] for x in k], np.uint64).reshape(-1, 2).view(np.int64)
            none = pa.nulls(len(n), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(keys, pa.list_(pa.int64())), none], names=names)
        if some:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=names)

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, keys array<long>, counts array<long>")


def _counters(described: DataFrame) -> np.ndarray:
    """The counters' sums over all documents: COUNTERS numbers."""
    each = described.filter("counts is not null").select(F.posexplode("counts").alias("at", "c")).filter("c > 0")
    found = each.groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["at"].to_numpy()] = found["c"].to_numpy()
    return out


def _of_ids(docs: DataFrame, ids: DataFrame):
    """docs (id, text) with these ids, as far as that needs a shuffle, and a test of ids for a task."""
    if ids.count() > BROADCAST_IDS:
        docs = docs.join(ids, "id", "left_semi")
        return docs, lambda i: np.arange(len(i))
    held = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["id"].to_numpy()))

    def hits(i):
        have, at = held.value, i.fill_null(-(2**63)).to_numpy()
        return np.flatnonzero(have[np.minimum(np.searchsorted(have, at), len(have) - 1)] == at) if len(have) else np.empty(0, np.int64)

    return docs, hits


def _first(docs: DataFrame, ids: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, id, docs): the first shingles of the documents with these ids. docs: 0, or of a shingle in a crowded counter (over HOT_ROWS
    and CROWDED times the mean) the counter's number; a shingle in another one has that many documents at most."""
    docs, hits = _of_ids(docs, ids)
    told = docs.sparkSession.sparkContext.broadcast(counts)
    crowded = max(HOT_ROWS, CROWDED * counts.mean())

    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            tokens, of = [np.empty(0, np.uint64)], []
            for k in hits(batch.column(0)).tolist():
                s = shingle_set(words.of(batch.column(1)[k].as_py()), width)
                if len(s):
                    tokens.append(_ordered(s, told.value)[: first_of(len(s), percent)])
                    of += [k] * len(tokens[-1])
            tokens = np.concatenate(tokens)
            count = told.value[(mix(tokens) >> _BITS).astype(np.int64)]
            cols = [pa.array(tokens.view(np.int64)), batch.column(0).take(pa.array(of, pa.int64())), pa.array(np.where(count > crowded, count, 0))]
            yield pa.RecordBatch.from_arrays(cols, names=["token", "id", "docs"])

    return docs.mapInArrow(run, "token long, id long, docs long")


def _met(first: DataFrame) -> DataFrame:
    """first without the shingles that one row only has among its first ones, docs: how many do. Those of crowded counters stay unseen,
    so no shingle of the others, which one shuffle brings together, has more rows than a task can take."""
    x = first.filter("docs = 0").select("token", "id").repartition("token")
    twice = x.groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1")
    return first.filter("docs > 0").union(x.join(twice, "token").select("token", "id", "docs"))


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, hashes) of the documents with these ids: their whole sets, sorted."""
    docs, hits = _of_ids(docs, ids)

    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            at, n, blobs, size = [], [], [], 0
            for k in [*hits(batch.column(0)).tolist(), -1]:
                if k >= 0 and len(s := shingle_set(words.of(batch.column(1)[k].as_py()), width)):
                    at.append(k)
                    n.append(len(s))
                    blobs.append(s.tobytes())
                    size += s.nbytes
                if k < 0 or size > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "n", "hashes"])
                    at, n, blobs, size = [], [], [], 0

    return docs.mapInArrow(run, "id long, n long, hashes binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of one key and one of them, for each key another one. keys: (key, id, n)."""
    turn = F.xxhash64("key", "id")
    centre = keys.groupBy("key").agg(F.min(F.struct(turn.alias("t"), "id", "n")).alias("c"), F.count("*").alias("members")).filter("members > 1")
    near = join_spread(keys, written(centre), ["key"], "members", "id").filter((F.col("id") != F.col("c.id")) & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")))
    pairs = near.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
    first = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def run(batches):
        for batch in slices(batches):
            cols = [batch.column(c) for c in ("x", "y")]
            sure = [k for k in range(len(batch)) if linked(*(np.frombuffer(c[k].as_buffer(), np.uint64) for c in cols), percent)]
            yield batch.select(["a", "b"]).take(pa.array(sure, pa.int64()))

    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _asked(told: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(id, grp): the groups that a document's first shingles don't rule out. told: (token, id); groups: (id, grp, comp, n, most), n and most the
    least and the largest size of the sets with this id."""
    within = groups.groupBy("grp", "comp").agg(F.count("*").alias("c")).groupBy("grp")
    within = written(within.agg(F.sum("c").alias("members"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")))
    own = groups.join(within.filter("comps > 1"), "grp").filter("comp <> main").select("id", "grp")

    first = written(told.join(groups.join(within, "grp"), "id"))
    matrix = first.groupBy("token", "grp").agg(F.first("members").alias("members"), F.first("comps").alias("comps"), F.first("main").alias("main"), F.min("n").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("rows"))
    matrix = written(matrix)
    mixed = matrix.groupBy("token").agg(F.count("*").alias("groups"), F.sum("rows").alias("docs")).filter("groups > 1")
    mixed = written(mixed.withColumn("parts", F.ceil(F.col("groups") * F.col("docs") / PAIRED).cast("int")))
    asking = join_spread(first.select("token", "id", "n", "most", "grp", "members", "comp"), mixed, ["token"], "docs", "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    held = join_spread(matrix, mixed.select("token", "parts", "groups"), ["token"], "groups", "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select("token", "part", F.col("grp").alias("to"), F.col("members").alias("to_members"), F.when(F.col("comps") == 1, F.col("main")).alias("to_comp"), "lo", "hi")
    smaller = (F.col("members") < F.col("to_members")) | (F.col("members") == F.col("to_members")) & (F.col("grp") < F.col("to"))
    sizes = (100 * F.col("hi") >= percent * F.col("n")) & (100 * F.col("most") >= percent * F.col("lo"))
    apart = F.coalesce(F.col("comp") != F.col("to_comp"), F.lit(True))
    met = asking.join(held, ["token", "part"]).filter(smaller & sizes & apart).groupBy("id", "n", "to").agg(F.count("*").alias("met"))
    need = F.lit(1) + F.floor(F.floor((percent * F.col("n") + 99) / 100) / MORE)
    out = written(met.filter(F.col("met") >= need).select("id", F.col("to").alias("grp")).union(own).distinct())
    drop_written(within, first, matrix, mixed)
    return out


def _opened(asked: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of documents with members of a group that they ask for, one for each component. groups: (id, grp, comp) of all with sets."""
    groups = groups.select("id", "grp", "comp")
    sized = groups.join(sets.select("id", "n"), "id")
    size = lambda x, name: x.groupBy("grp").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias(name))
    blocks = written(size(asked.join(sized.select("id", "n"), "id"), "asks").join(size(sized, "holds"), "grp"))
    several = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    members = groups.join(blocks, "grp").select("grp", several("asks").alias("ask"), deal("holds").alias("hold"), F.lit(True).alias("held"), "id", "comp")
    asking = asked.join(groups.select("id", "comp"), "id").join(blocks, "grp")
    asking = asking.select("grp", deal("asks").alias("ask"), several("holds").alias("hold"), F.lit(False).alias("held"), "id", "comp")

    def run(key, rows):
        held = rows["held"].to_numpy(zero_copy_only=False)
        ids, comp = rows["id"].to_numpy(), rows["comp"].to_numpy()
        sets_ = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows["hashes"]]
        mine, out = np.flatnonzero(held), []
        if len(mine):
            tokens = np.concatenate([sets_[k] for k in mine])
            n = np.array([len(sets_[k]) for k in mine])
            of = np.repeat(np.arange(len(mine)), n)
            order = np.argsort(tokens, kind="stable")
            tokens, of = tokens[order], of[order]
            for k in np.flatnonzero(~held):
                q = sets_[k]
                lo, hi = np.searchsorted(tokens, q, "left"), np.searchsorted(tokens, q, "right")
                if np.count_nonzero(hi > lo) < needed(len(q), percent):
                    continue  # the union rules the block out
                many = hi - lo
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = np.bincount(of[at], minlength=len(mine))
                sure = mine[np.flatnonzero(100 * both >= percent * (n + len(q) - both))]
                sure = sure[comp[sure] != comp[k]]
                for j in sure[np.unique(comp[sure], return_index=True)[1]]:
                    out.append((ids[k], ids[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = members.union(asking).join(sets.select("id", "hashes"), "id")
    return rows.groupBy("grp", "ask", "hold").applyInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents are linked if 100 * |A & B| >= percent * |A | B|.

    Sets hold distinct runs of `width` words (A-Z lower-cased); fewer words are one run; without words or text the set is empty, linked with
    nothing, and its own component. component_id is the least id reachable. Rows of one id are one document for links. A null id is in its set's
    component but never its name: its component_id is null if no row with an id is there. Texts of any length count whole; links are exact.
    """
    x = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    described = written(_described(x, width))
    own = described.filter("counts is null")
    counts = _counters(described)
    reps = written(own.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies")))
    named = reps.filter("id is not null")

    # shingles that several documents have among their first ones, and documents with as many of these as they need
    sizes = own.filter("n > 0").groupBy("id").agg(F.min("n").alias("n"), F.max("n").alias("most"))
    first = written(_first(x, named.select("id").distinct(), counts, width, percent))
    told = written(_met(first))
    drop_written(first)
    need = F.lit(1) + F.floor(F.floor((percent * F.col("n") + 99) / 100) / MORE)
    able = told.groupBy("id").agg(F.count("*").alias("has"), F.max(F.struct("docs", "token"))["token"].alias("grp")).join(sizes, "id").filter(F.col("has") >= need)
    able = written(able.select("id", "grp", "n", "most"))
    sets = written(_sets(x, able.select("id"), width))

    keys = named.join(able.select("id"), "id", "left_semi").select(F.explode("keys").alias("key"), "id", "n")
    star = written(_star(keys, sets, percent))
    parts = written(components(star))
    groups = written(able.join(parts, "id", "left").select("id", "grp", "n", "most", F.coalesce("component", "id").alias("comp")))
    asked = _asked(told.drop("docs"), groups, percent)
    drop_written(told, parts, able)
    links = written(_opened(asked, groups, sets, percent))
    drop_written(asked, sets, groups)
    parts = written(components(star.union(links)).distinct())
    drop_written(star, links)

    of_set = reps.select("k1", "k2", "copies", F.col("id").alias("rep")).join(parts, F.col("rep") == F.col("id"), "left")
    of_set = written(of_set.select("k1", "k2", "copies", F.coalesce("component", "rep").alias("component_id")))
    drop_written(parts, reps)
    out = join_spread(own.filter("n > 0").select("id", "n", "k1", "k2"), of_set, ["k1", "k2"], "copies", "id")
    out = out.select("id", "n", "component_id").union(own.filter("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


#: jaccard_join of documents in DuckDB's SQL, by all pairs that a prefix filter leaves.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, w[i:i + 3] AS g FROM p),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- of two sets that are linked, the rarest shingles, as many as either can lack and one more, have one in common
o AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS nth FROM s JOIN c USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g)),
q AS (SELECT doc_id, g, n FROM o WHERE nth <= n - ceil(0.85 * n) + 1),
m AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM q a JOIN q b USING (g) WHERE a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)),
v AS (SELECT m.a, m.b FROM m JOIN s x ON x.doc_id = m.a JOIN s y ON y.doc_id = m.b AND y.g = x.g JOIN c ca ON ca.doc_id = m.a JOIN c cb ON cb.doc_id = m.b
 GROUP BY m.a, m.b, ca.n, cb.n HAVING 100 * count(*) >= 85 * (ca.n + cb.n - count(*))),
e AS (SELECT a, b FROM v UNION ALL SELECT b, a FROM v),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, min(r.root) AS component_id FROM d LEFT JOIN c USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, c.n
"""
