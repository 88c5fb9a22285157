import base64
import functools
import hashlib
import random

import numpy as np
import pytest
import xxhash

from tallyloom.llm import fingerprints as P
from tallyloom.llm.shingles import WordHashes, shingle_set


def test_estimates_and_merge():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 2**64, 30_000, dtype=np.uint64))
    a, b = np.sort(h[rng.permutation(len(h))[:20_000]]), np.sort(h[rng.permutation(len(h))[:20_000]])
    sa, sb = P.bottom(a), P.bottom(b)
    both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    assert abs(P.resemblance(sa, sb) - both / union) < 0.15
    assert abs(P.containment(sa, sb) - both / len(a)) < 0.2
    assert abs(P.distinct(sa) / len(a) - 1) < 0.35
    assert (P.merge(sa, sb) == P.bottom(np.union1d(a, b))).all() and (P.decode(P.encode(sa)) == sa).all()


M = 2**64 - 1


def slow_mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * by & M
    return x


def slow_sketch(t):
    """The 128 least hashes of the five-word runs, in plain Python."""
    w = [xxhash.xxh3_64_intdigest(x) for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()]
    k, out = min(5, len(w)), set()
    for i in range(len(w) - k + 1 if w else 0):
        acc = k
        for h in w[i : i + k]:
            acc = slow_mix(acc * 0x9E3779B97F4A7C15 + h & M)
        out.add(acc)
    return sorted(out)[:128]


def slow_likeness(a, b):
    union = sorted({*a, *b})[:128]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def naive(rows):
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, h(r[1]) - (h(r[1]) >> 63 << 64)))
    out, s = [], functools.cache(slow_sketch)
    code = lambda x: base64.b64encode(b"".join(h.to_bytes(8, "big") for h in x)).decode()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), code(s(t)), code(s(e)), slow_likeness(s(t), s(e)), slow_likeness(s(t), s(nxt))))
    return out


def test_query_against_naive(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rng.choices(["the", "Éau", "x", "of\n", "straße"], k=rng.randint(0, 90)))) for i in range(150)]
    for more in ([], [(None, "nobody knows"), (7, None), (7, ""), (10**12, "w " * 60_000), (40, "same"), (40, "same")]):
        df = spark.createDataFrame([(i, t, True) for i, t in rows + more], "doc_id bigint, text string, halo boolean")
        got = [tuple(r) for r in P.edited_fingerprints(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, naive(rows + more)))
    one = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    assert [tuple(r) for r in P.edited_fingerprints(one).collect()] == naive([(5, "abcd")])
    assert P.edited_fingerprints(one.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [5_000, 3])
def test_many_rows_of_one_id(spark, monkeypatch, hot):
    """Most rows without an id or of one id, many of them alike: they are several buckets, none of them large."""
    monkeypatch.setattr(P, "HOT_ROWS", hot)
    rows = [(None, f"a b c d e f {i}") for i in range(900)] + [(7, f"text {i} of id seven") for i in range(800)] + [(None, "same")] * 30 + [(9, "alike")] * 40 + [(i, f"own {i}") for i in range(100, 150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in P.edited_fingerprints(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, naive(rows)))
    placed, alike = P.in_order(df)
    assert alike == (hot == 3)
    sizes = [r["count"] for r in placed.filter("not halo").groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 0.15 * len(rows)


def test_a_hundred_thousand_rows_of_one_id(spark):
    df = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('some words of text ', id % 70000) AS text")
    sizes = [r["count"] for r in P.in_order(df)[0].groupBy("bucket").count().collect()]
    assert max(sizes) < 15_000 and sum(sizes) >= 100_000


def test_merged_parts(spark):
    df = spark.createDataFrame([(i % 2, f"a b c {i} {i + 1} d e f g {i % 9}") for i in range(400)], "part int, text string")
    words = WordHashes()
    got = {r.part: np.array(r.sketch).view(np.uint64) for r in P.merged(P.sketches(df, ["part"]), ["part"]).collect()}
    for p in (0, 1):
        whole = np.unique(np.concatenate([shingle_set(words.of(r.text.encode()), P.WIDTH) for r in df.filter(f"part = {p}").collect()]))
        assert (got[p] == P.bottom(whole)).all()
