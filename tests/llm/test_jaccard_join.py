import random

import numpy as np
import pytest

from tallyloom.llm import common
from tallyloom.llm import jaccard_join as J


def grams(t, w):
    x = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(x[i : i + w]) for i in range(max(1, len(x) - w + 1))} if x else set()


def naive(rows, width=4, percent=85):
    sets = [(i, grams(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets if i is not None)


def corpus(seed, n=220, words=140):
    """Near copies by a few edits, passages that a third of the rows hold, short texts, rows cut from others."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    base, shared = rng.choices(vocab, k=words), rng.choices(vocab, k=40)
    rows = []
    for i in range(n):
        kind = rng.random()
        t = list(base) if kind < 0.4 else rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 9, 40, 150]))
        if kind < 0.4:
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            t = t[: len(t) - rng.choice([0, 0, 3, 9, 15, 20])]
        elif kind < 0.7 and rows:
            t = rng.choice(rows)[1].split()
            if t and rng.random() < 0.7:
                t[rng.randrange(len(t))] = rng.choice(vocab)
        if rng.random() < 0.3:
            t = shared + t
        rows.append((rng.randrange(10**9) if i % 2 else i, " ".join(t).upper() if i % 9 == 0 else "\n".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "kinds", "block", "ids", "hot"), [(1, 4, 8_000_000, 10**6, 5_000), (2, 0, 3_000, 10**6, 3), (3, 1, 2_000, 0, 20)])
def test_against_naive(spark, monkeypatch, seed, kinds, block, ids, hot):
    """With fewer kinds of keys less is connected before groups meet; the links are the same."""
    for name, value in (("KINDS", kinds), ("BLOCK_BYTES", block), ("BROADCAST_IDS", ids), ("PAIRED", 50 * hot), ("HOT_ROWS", (5_000, 0, 2)[seed - 1]), ("CROWDED", 4 if seed == 1 else 0)):
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = corpus(seed) + [(-5, None), (-4, ""), (-3, " \n"), (-2, "one"), (-1, "One"), (7, "a b c d"), (7, "e f g h"), (9, "e f g h i"), (12, "A b c d")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int")
    want = naive(rows)
    assert len({c for *_, c in want}) < len(want) - 50
    assert sorted(map(tuple, J.jaccard_join(df).collect())) == want


def test_links_at_the_threshold(spark):
    """Pairs that are linked or not by one shingle."""
    rows, n = [], 0
    for size in (1, 2, 6, 7, 13, 20, 33, 64, 100, 200):
        for lacks in range(6):
            words = [f"p{n}x{k}" for k in range(size + 3)]
            rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[: max(1, len(words) - lacks * max(1, size // 40) - (size * 15 // 100 - 2 if size > 20 else 0))]))]
            n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, J.jaccard_join(df).collect()))
    assert got == naive(rows) and len({c for *_, c in got}) not in (len(rows), len(rows) // 2)


def test_nulls_repeats_empty_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (4, "a b c d e", 2), (4, "a b c d e", 3), (None, None, 4), (None, "lone one", 5)], "doc_id bigint, text string, component_id int")
    got = sorted(map(repr, map(tuple, J.jaccard_join(df.withColumn("n", df.component_id).withColumn("token", df.text)).collect())))
    assert got == sorted(map(repr, [(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (None, 1, None)]))
    assert J.jaccard_join(df.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    two = spark.createDataFrame([(1, long), (2, long + " more words here")], "doc_id bigint, text string")
    assert sorted(map(tuple, J.jaccard_join(two).collect())) == [(1, 59_997, 1), (2, 60_000, 1)]


def test_first_shingles_decide():
    """Sets that are linked have as many of their first shingles in common as is asked for."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, J.COUNTERS)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        lost = int(rng.integers(0, n * 0.15 + 1))
        b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, int(rng.integers(0, n * 0.15 - lost + 1)), dtype=np.uint64)]))
        if not len(b) or not J.linked(a, b, 85):
            continue
        x, y = (J._ordered(s, counts)[: J.first_of(len(s), 85)] for s in (a, b))
        assert len(np.intersect1d(x, y)) >= max(J.shared(len(a), 85), J.shared(len(b), 85))
