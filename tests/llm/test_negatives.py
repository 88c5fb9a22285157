import random

import numpy as np
import pytest

from tallyloom.llm import negatives as N


def slow(rows):
    """All anchors against all rows in plain Python."""
    fine = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = ((lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(x * 256.0)) for x in v])
        fine[i] = min(fine.get(i, row), row)
    out = []
    for a, (lab, v) in fine.items():
        if a % 100:
            continue
        dot = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in fine.items() if i != a and len(w) == len(v)}
        pos = sorted((-s, i) for i, s in dot.items() if fine[i][0] == lab)[:5]
        for ps, p in pos:
            near = sorted((-s, i) for i, s in dot.items() if fine[i][0] != lab and 30 * -ps <= 100 * s <= 90 * -ps)[:10]
            out += [(a, p, k, i, -ps, -s) for k, (s, i) in enumerate(near, 1)]
    return sorted(out)


def made(n, d, labels, seed, step=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (labels, d))
    rows = []
    for i in range(0, n * step, step):
        lab = int(rng.integers(labels))
        rows.append((i, (centres[lab] + rng.normal(0, 0.2 * spread, d)).astype(np.float32).tolist(), lab))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def got(found):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize(("block", "leaf", "seed"), [(8192, 64, 1), (40, 8, 2), (100, 3, 3)])
def test_against_all_pairs(spark, monkeypatch, block, leaf, seed):
    for name, value in (("BLOCK", block), ("ANCHOR_BLOCK", max(4, block // 8)), ("LEAF", leaf), ("AT_ONCE", 32)):
        monkeypatch.setattr(N, name, value)
    rows = made(300, 6, 4, seed, step=20)
    want = slow(rows)
    assert len(want) > 500 and got(N.hard_negatives(frame(spark, rows))) == want


def test_ties_nulls_repeats_lengths_labels(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    rng = random.Random(4)
    rows = [(i * 25, [rng.choice([0.0, 0.25, 0.5]) for _ in range(3)], rng.choice([0, 0, 0, 0, 1, 2])) for i in range(80)]  # many ties, one large label
    rows += [(7_000, [float("nan"), 0.1, 0.2], 0), (7_100, None, 0), (7_200, [0.1, None, 0.1], 0), (7_300, [0.1, 0.1, 0.1], None), (None, [0.5, 0.5, 0.5], 1), (7_400, [float("inf"), 0.0, 0.0], 1)]
    rows += [(8_000, [0.5, 0.5], 0), (8_001, [0.5, 0.4], 0), (8_002, [0.3, 0.3], 1), (8_100, [], 0), (8_101, [], 0), (8_102, [], 3)]
    rows += [rows[0], (100, [0.5, 0.0, 0.25], 2), (9_000, [-0.1, -0.2, -0.3], 8), (9_001, [-0.5, 0.2, 0.1], 8)]
    want = slow(rows)
    assert len(want) > 100 and got(N.hard_negatives(frame(spark, rows))) == want
    assert got(N.hard_negatives(frame(spark, rows).limit(0))) == []
    assert got(N.hard_negatives(frame(spark, [(0, [1.0, 0.5], 1)]))) == []
    clash = frame(spark, rows).selectExpr("vec_id", "embedding", "label", "1 as id", "'x' as block", "2 as score")
    assert got(N.hard_negatives(clash)) == want


def test_large_numbers_are_exact(spark):
    rows = [(i * 50, [float(2**20 + i), float(i % 7) * 2**19, 3.0], i % 2) for i in range(12)]
    want = slow(rows)
    assert want and max(w[4] for w in want) > 2**53 and got(N.hard_negatives(frame(spark, rows))) == want
    with pytest.raises(Exception, match="beyond 62 bits"):
        N.hard_negatives(frame(spark, [(100, [1e12], 1), (101, [1e12], 1)])).collect()


def test_nodes_prune_and_lose_nothing(spark):
    rows = made(2_000, 8, 5, 7, spread=0.2)
    x = np.floor(np.array([v for _, v, _ in rows], np.float64) * 256).astype(np.int64)
    labels = np.array([lab for *_, lab in rows])
    order, ends = N.tree(x, labels)
    assert sorted(order.tolist()) == list(range(len(rows))) and np.diff(ends, prepend=0).max() <= N.LEAF
    row = {"ids": order.astype(np.int64).tobytes(), "labels": labels[order].astype(np.int64).tobytes(), "vecs": x[order].astype(np.int16).tobytes(), "ends": ends.astype(np.int64).tobytes(), "scores": b"", "small": True, "dims": 8}
    c = N.Block(row)
    assert all(np.sqrt(((c.f[r] - m) ** 2).sum(1)).max() <= q + 1e-6 for r, m, q in zip(c.runs, c.centre, c.radius, strict=True))
    search = N.Search(c, 5, True)
    every = len(c.ends) ** 2
    assert len(search.leaves(c)[0]) < every / 3  # labels
    search.see(c)
    after = search.leaves(c)[0]
    assert len(after) < every / 6  # and the best so far
    s = c.x.astype(np.int64) @ c.x.astype(np.int64).T
    for i in range(0, len(rows), 97):
        own = [(-s[i, k], c.ids[k]) for k in range(len(rows)) if k != i and c.labels[k] == c.labels[i]]
        assert [(-a, b) for a, b in zip(search.score[i, 0], search.id[i, 0], strict=True)] is not None
        assert sorted(own)[:5] == [(-a, b) for a, b in zip(search.score[i, 0], search.id[i, 0], strict=True)]
