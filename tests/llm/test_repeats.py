import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import repeats as R
from tallyloom.llm.suffix_array import suffix_array


def test_suffix_array_against_sorting():
    rng = random.Random(0)
    for t in range(1500):
        x = bytes(rng.choices(range(rng.choice([1, 2, 3, 5, 256])), k=rng.randint(0, 40))) * (3 if t % 3 == 0 else 1)
        assert list(suffix_array(x)) == sorted(range(len(x)), key=lambda i: x[i:])
    assert not suffix_array(b"")


@pytest.mark.parametrize("kind", ["mixed", "run", "period"])
def test_anchors_tile_the_windows(kind):
    rng = np.random.default_rng(1)
    data = {"mixed": rng.integers(97, 100, 3000), "run": np.full(900, 32), "period": np.tile([97, 98, 99], 400)}[kind].astype(np.uint8)
    h, first, last, twice = R.anchors(data)
    assert first[0] == 0 and last[-1] == len(data) - R.LENGTH and (first[1:] == last[:-1] + 1).all()
    grams = R.string_hashes(data, R.K)
    width = R.LENGTH - R.K + 1
    for a, b, v in zip(first, last, h, strict=True):
        assert all(grams[i : i + width].min() == v for i in range(a, b + 1))
    assert kind == "mixed" or len(h) == 1
    held = [np.count_nonzero(grams[a : b + width] == v) > 1 for a, b, v in zip(first, last, h, strict=True)]
    assert not (np.array(held) & ~twice).any()
    assert twice.mean() < 0.2 if kind == "mixed" else twice.all()
    parts = [at + len(x) - R.LENGTH for at, x in R.segments(bytes(data))]
    assert parts[-1] == len(data) - R.LENGTH


def test_string_hashes_tell_strings_apart():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 20_000).astype(np.uint8)
    for length in (1, 7, 12, 32, 100):
        h = R.string_hashes(data, length)
        assert len(h) == len(data) - length + 1
        assert len(set(h.tolist())) == len({bytes(data[i : i + length]) for i in range(len(h))})


def test_classes_are_the_equal_windows():
    rng = random.Random(2)
    base = bytes(rng.choices(b"ab ", k=400))
    texts = [base[a : a + n] for a, n in ((0, 200), (90, 150), (3, 100), (250, 150), (100, 99))] + [b"a" * 300]
    owner, offset, group = R.classes(texts)
    seen = {}
    for o, at, g in zip(owner.tolist(), offset.tolist(), group.tolist(), strict=True):
        assert seen.setdefault(g, texts[o][at : at + 100]) == texts[o][at : at + 100]
    assert len(owner) == sum(max(0, len(t) - 99) for t in texts) and len(seen) == len(set(seen.values()))


def naive(rows, length):
    seen, out = set(), []
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0]):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "ation", "Éaue", "of", "straße", "x", "and\n", "words"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [text(60) for _ in range(6)]
    rows = []
    for i in range(70):
        t = text(rng.choice([0, 5, 30, 120]))
        for _ in range(rng.choice([0, 1, 2])):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            t += s[a : a + rng.choice([90, 105, 150, 400])] + text(2)
        rows.append((i * 7 % 71, t))
    return [*rows, (200, rows[9][1]), (201, rows[9][1]), (202, None), (203, ""), (204, " " * 700), (205, "ab" * 300 + "ab" * 60), (206, "é" * 99), (207, "short"), (208, "short")]


def test_against_naive(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, key int, size int")
    want = naive(rows, 100)
    assert sum(r[2] for r in want) > 3000
    assert sorted(map(tuple, R.remove_repeats(df).collect())) == want
    monkeypatch.setattr(R, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(R, "BROADCAST_COPIES", 0)
    monkeypatch.setattr(R, "CHUNK", 500)
    assert sorted(map(tuple, R.remove_repeats(df).collect())) == want


def hot_corpus(seed):
    """A passage in most documents, each time beside other text, pairs of documents that share more, and exact copies."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage = " ".join(word(6) for _ in range(60))
    rows = []
    for i in range(300):
        beside = rows[-1][1] if i % 5 == 1 else f"{word(150)} {passage} {word(150)}"
        rows.append((i * 37 % 301, beside if i % 5 == 1 and i % 2 else f"{word(rng.randrange(40))}{beside}{word(rng.randrange(40))}"))
    return rows


@pytest.mark.parametrize("hot", [20, 10**9])
def test_hot_passage(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R, "HELD", 3000)
    monkeypatch.setattr(R, "SEGMENT", 333)
    rows = hot_corpus(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, R.remove_repeats(df).collect())) == naive(rows, 100)


def test_periodic_texts(spark):
    rows = [(1, "a" * 300_000), (2, "abc" * 50_000), (3, "x" + "bca" * 3_000), (4, "a" * 99), (5, "b" + "a" * 100), (6, "0123456789" * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, R.remove_repeats(df).collect())) == naive(rows, 100)
    runs = [x for t in rows[:2] for x in R.anchors(np.frombuffer(t[1].encode(), np.uint8))[0]]
    assert len(runs) == 2  # a periodic text is one run, not one for each byte


def test_odd_tables(spark):
    t = "some words that are long enough to make a window of a hundred bytes when they are put together " * 2
    df = spark.createDataFrame([(None, t), (3, t), (3, t)], "doc_id bigint, text string")
    got = R.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in got) == [("3", len(t), 1), ("3", len(t), 1), ("None", naive([(0, t)], 100)[0][2], naive([(0, t)], 100)[0][3])]
    kept = R.remove_repeats(df, with_text=True).filter("doc_id = 3").first()
    assert bytes(kept.text) == b"" and kept.kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert R.remove_repeats(df.limit(0)).count() == 0
