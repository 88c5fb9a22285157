import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import language_id as L

WORDS = {"en": "the of and to in that with from have this which been their would there".split(), "fr": "le la les des être avec où très pour dans qui sont même après était".split(), "de": "der die und nicht über für schön mit eine auch nach größer wird sich".split()}


def texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        yield i, " ".join(rng.choices(WORDS[lang], k=rng.choice([3, 8, 40, 300]))), lang


@pytest.fixture(scope="module")
def rows():
    return list(texts(1, 400)) + [(500, None, "en"), (501, "", "en"), (502, " 12 34 !?", "fr"), (503, "über " * 60_000, None), (504, "中文字", "en"), (None, "the the", "en")]


def test_held_out_accuracy_and_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in L.predicted(df).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:400] if got[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "de" and got[504].lang_pred != "und"
    kept = L.keep_known(df)
    assert kept.columns == df.columns and not {500, 501, 502} & {r.doc_id for r in kept.collect()} and kept.count() > 390


def test_tables_score_like_the_filters():
    net = L.Network(["a", "b", "c"])
    net.tables()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (150, L.WINDOW), dtype=np.uint8)
    pooled, _ = net._pooled(x)
    assert np.allclose(net.scores(x), np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias, atol=1e-4)


def naive(net, text):
    """The prediction by its definition, a window, filter and place at a time."""
    total = np.zeros(len(net.names))
    for at in range(0, len(text), L.WINDOW):
        w = text[at : at + L.WINDOW]
        x = list(w) + [0] * (L.WINDOW - len(w))
        pooled = [max(sum(float(net.conv[k][o][x[p + o]][f]) for o in range(k)) for p in range(L.WINDOW - k + 1)) for k in L.WIDTHS for f in range(L.FILTERS)]
        hidden = [max(0.0, v + float(b)) for v, b in zip(pooled, net.bias, strict=True)]
        total += len(w) * np.array([sum(h * float(net.out[i][c]) for i, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(len(net.names))])
    z = total / len(text)
    p = np.exp(z - z.max())
    return net.names[int(z.argmax())], float(p.max() / p.sum())


def test_predictions_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = L.fit(df)
    some = [(i, t) for i, t, _ in rows if i is not None and t and L.has_letter(t.encode()) and len(t) < 3000][::29] + [(900, "é" * 300), (901, "x")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(some, "doc_id bigint, text string"), net).collect()}
    for i, t in some:
        name, score = naive(net, t.encode())
        assert got[i][0] == name and abs(got[i][1] - score) < 1e-3


def test_a_rare_language_is_learned(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS["en"], k=30)), "en") for i in range(3_000)] + [(5_000 + i, " ".join(rng.choices(WORDS["fr"], k=30)), "fr") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = L.fit(df, train_windows=400)
    assert net.names == ["en", "fr"]
    held = L.identify(df, net).filter(L.held_out("doc_id")).filter("lang = 'fr'").collect()
    assert len(held) > 3 and all(r.lang_pred == "fr" for r in held)


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    x = rng.integers(97, 123, (300, L.WINDOW), dtype=np.uint8)
    x[y == 1, 40:43] = np.frombuffer(b"\xc3\xa9!", np.uint8)
    net = L.Network(["a", "b"])
    net.train(x, y, epochs=5)
    net.tables()
    assert (net.scores(x).argmax(1) == y).mean() > 0.97


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a text", None)], "doc_id bigint, text string, lang string")
    assert tuple(L.predicted(df).first())[2:] == ("und", 0.0)
    assert L.predicted(df.limit(0)).count() == 0


@pytest.mark.parametrize("learned", [["en"], ["en", "fr", "de"]])
def test_unlearned_languages_and_junk_go(spark, learned):
    rng = random.Random(4)
    clean = [r for r in texts(3, 900) if r[2] in learned]
    strange = [
        "wszystkie dzieci często wracają późno ze szkoły przez wąską ścieżkę", "быстрая коричневая лиса прыгает через ленивую собаку", "東京都の図書館は午後九時まで開いています",
        "for(i=0;i<n;++i){x[i]=y[i]*z[i]+0x1F;}if(!p)return NULL;", "a" + "".join(chr(rng.randrange(33, 1000)) for _ in range(400)), "xq7#kz!" * 40, "zzzzqqqqxxxxjjjj" * 30,
    ]
    rows = clean + [(10_000 + i, t, None) for i, t in enumerate(strange)]
    kept = {r.doc_id for r in L.keep_known(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not {i for i, _, lang in rows if lang is None} & kept
    held = [i for i, _, _ in clean if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(set(held) & kept) >= 0.99 * len(held)


@pytest.mark.parametrize("one", [999_001, 999_003, 999_008, 999_010])
def test_rows_of_one_id_are_rows(spark, monkeypatch, one):
    """A language of which all rows have one id is learned, whatever the id; what the driver gets is the sample at most."""
    rng, got = random.Random(6), []
    while any(zlib.crc32(str(i).encode()) % 4 == 2 for i in (one, one + 1)):  # held out
        one += 2
    train = L.Network.train
    monkeypatch.setattr(L.Network, "train", lambda self, x, y, **k: got.append((len(x), np.bincount(y))) or train(self, x, y, **k))
    rows = [(i, " ".join(rng.choices(WORDS["en"], k=30)), "en") for i in range(2_000)]
    rows += [(one, " ".join(rng.choices(WORDS["fr"], k=30)), "fr") for _ in range(6_000)] + [(one + 1, "der die und nicht über für schön mit eine", "de")] * 3_000
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = L.fit(df, train_windows=600)
    n, by = got[0]
    assert net.names == ["de", "en", "fr"] and by[0] == 1 and by[1] >= 100 and by[2] >= 250
    assert n <= sum(max(L.LANGUAGE_WINDOWS, 600 * k // 11_000) for k in (2_000, 6_000, 3_000))


def test_a_long_text_is_scored_in_slices(spark, rows):
    import tracemalloc

    net = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    text = ("die und nicht über für schön mit eine auch " * 500_000).encode()[:20_000_000]
    tracemalloc.start()
    odd = net.usual.odd(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not odd and peak < 3 * len(text)
    some, codes = text[:3_000_001], L.pair_codes(text[:3_000_001])
    starts = np.arange(0, len(codes), L.WINDOW)
    whole = np.max([np.add.reduceat(log.take(codes), starts) for log in net.usual.log], axis=0).sum() / len(codes)
    assert abs(net.usual.score(some) - whole) < 1e-3 * abs(whole)
