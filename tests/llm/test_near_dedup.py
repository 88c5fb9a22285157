import importlib
import random

import numpy as np
import pytest

from tallyloom.llm import common
from tallyloom.llm import near_dedup as N
from tallyloom.llm.components import components


def grams(t, w):
    x = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(x[i : i + w]) for i in range(max(1, len(x) - w + 1))} if x else set()


def naive(rows, width, percent=80):
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
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets if i is not None)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    base = rng.choices(vocab, k=80)
    for i in range(n):
        kind = rng.random()
        t = list(base) if kind < 0.4 else rng.choices(vocab, k=rng.choice([1, 2, 4, 5, 6, 12, 60]))
        if kind < 0.4:
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
        elif kind < 0.8 and rows:
            t = (rng.choice(rows)[1]).split()
            if t and rng.random() < 0.7:
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t.append(rng.choice(vocab))
        rows.append((rng.randrange(10**9) if i % 2 else i, " ".join(t).upper() if i % 9 == 0 else "\n".join(t)))
    return rows


@pytest.mark.parametrize(("width", "small", "block", "broadcast"), [(2, 64, 1000, 10**6), (2, 3, 4, 0), (5, 2, 1000, 10**6)])
def test_against_naive(spark, width, small, block, broadcast, monkeypatch):
    for name, value in (("SMALL", small), ("BLOCK", block), ("BROADCAST_IDS", broadcast)):
        monkeypatch.setattr(N, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", small)
    rows = corpus(width) + [(-5, None), (-4, ""), (-3, " \n"), (-2, "one"), (-1, "One")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int")
    assert sorted(map(tuple, N.near_duplicates(df, width=width).collect())) == naive(rows, width)


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(4, "a b c d e f", 1), (2, "A B C D E F", 2), (3, None, 3), (None, "a b c d e f", 4), (9, "x y", 5)], "doc_id bigint, text string, gone_id int")
    out = N.near_dedup(df)
    assert out.columns == df.columns and sorted(r.gone_id for r in out.collect()) == [2, 3, 5]


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 1), (3, "other text of one id", 1), (None, "A b c d e f", 1), (None, "x y z", 2), (None, "X y z", 2), (None, "x y z", 2), (None, None, 3), (None, " ", 4), (7, "", 5), (7, "", 5), (8, None, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part_of_key int")
    assert sorted(r.part_of_key for r in N.near_dedup(df).collect()) == [1, 2, 3, 4, 5, 6]
    assert N.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [10, 10**6])
def test_crowded_buckets_come_apart(spark, monkeypatch, large):
    """Documents that share half of their text but aren't linked, with some that are, at all levels; long ones among them."""
    for name, value in (("SMALL", 5), ("BLOCK", 7), ("BLOCK_BYTES", 20_000), ("LARGE", large)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(6)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base, rows = text(120), []
    for i in range(90):
        own = base + text(rng.choice([15, 30, 90])) if i % 4 else rows[-1][1].split() + text(2) if rows else base
        rows.append((i, " ".join(own)))
    rows += [(200, " ".join(base * 2 + text(6000)))]
    rows += [(201, rows[-1][1] + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, N.near_duplicates(df, width=2).collect())) == naive(rows, 2)


def test_keys_of_all_levels():
    rng = np.random.default_rng(0)
    regs = rng.integers(0, 65536, (50, N.REGISTERS)).astype(np.uint16)
    regs[1] = regs[0]
    for level, (rows, keys) in enumerate(N.LEVELS):
        k, places = N._keys(regs, level), N._places(level)
        assert k.shape == (50, keys) and places.shape == (keys, rows) and all(len(set(p)) == rows for p in places.tolist())
        assert (k[0] == k[1]).all() and len(np.unique(k)) == 49 * keys
        assert (1 - 0.8**rows) ** keys < 2e-7


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for size in (3, 40, 400, 20_000):
        h = np.unique(rng.integers(0, 2**64, 2 * size, dtype=np.uint64))
        a, b = np.sort(rng.permutation(h)[: int(len(h) * 0.9)]), np.sort(rng.permutation(h)[: int(len(h) * 0.9)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.count_nonzero(N.registers(a) == N.registers(b))
        assert abs(N.estimate(np.array([same]), [len(a)], [len(b)])[0] - j) < 0.16
    a, b = (np.unique(rng.integers(0, 2**64, 5_000, dtype=np.uint64)) for _ in range(2))
    same = [np.count_nonzero(N.registers(np.unique(rng.integers(0, 2**64, 5_000, dtype=np.uint64))) == N.registers(a)) for _ in range(200)]
    assert abs(np.mean(same) / N.REGISTERS - N.collisions(np.array([5_000.0]), np.array([5_000.0]))[0]) < 3e-4


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "x y"), (3, "a b c"), (3, "a b c"), (9, "a B c"), (1, "w " * 50_000)], "doc_id bigint, text string")
    got = sorted(map(str, (tuple(r) for r in N.near_duplicates(df, width=2).collect())))
    assert got == sorted(map(str, [(None, 2, 3, False), (None, 1, None, False), (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (1, 1, 1, True)]))
    assert N.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("many", [10**6, 0])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr(importlib.import_module("tallyloom.llm.components"), "MANY", many)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7), (1000, 2000), (2000, 1000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    assert got == {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).count() == 0
