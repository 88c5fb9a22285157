import random

from tallyloom.llm import decontaminate as D


def grams(t, w):
    x = t.casefold().encode().split()
    return {tuple(x[i : i + w]) for i in range(len(x) - w + 1)}


def naive(docs, items):
    out = []
    for d, t in docs:
        for i, s in items:
            n = len((s or "").encode().split())
            want = grams(s, min(5, n)) if n else set()
            got = len(want & grams(t or "", min(5, n))) if want else 0
            if want and got >= 0.8 * len(want):
                out.append((d, i, len(want), got))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [*(f"w{i}" for i in range(56)), "été", "Öl", "straße", "ñ"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 40, 80]))) for i in range(40)]
    docs = []
    for d in range(120):
        t = text(rng.choice([0, 3, 30, 300, 3000])).split()
        for _, s in rng.sample(items, 2):
            s = s.split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                s[rng.randrange(len(s))] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = s
        docs.append((d, " ".join(t).upper() if d % 5 == 0 else "\n".join(t)))
    return docs, items


def test_against_naive_by_both_ways(spark):
    docs, items = corpus(2)
    docs += [(200, None), (201, ""), (202, "w1"), (203, items[0][1])]
    items += [(90, None), (91, ""), (92, " \t"), (93, items[5][1])]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, doc_id int")
    want = naive(docs, items)
    for limit in (10**6, 0):
        got = D.contaminated(d, i, broadcast_shingles=limit).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == want
    bad = {r[0] for r in want}
    kept = D.decontaminate(d, i)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - bad


def test_empty_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id bigint, text string")
    i = spark.createDataFrame([(5, "A b c d e f")], "item_id bigint, text string")
    assert sorted((tuple(r)[:4] for r in D.contaminated(d, i).collect()), key=str) == [(1, 5, 2, 2), (1, 5, 2, 2), (None, 5, 2, 2)]
    assert D.contaminated(d.limit(0), i).count() == 0 and D.contaminated(d, i.limit(0)).count() == 0
    assert D.decontaminate(d, i).count() == 0  # rows go by what they hold, whatever their id
    assert D.decontaminate(d.limit(0), i).count() == 0 and D.decontaminate(d, i.limit(0)).count() == 3


def test_rows_are_judged_by_their_text(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "clean"), (1, "x a b c d e f"), (1, "clean too"), (2, None)], "doc_id bigint, text string")
    i = spark.createDataFrame([(5, "A b c d e f")], "item_id bigint, text string")
    for limit in (10**6, 0):
        assert sorted((str(r.doc_id), str(r.text)) for r in D.decontaminate(d, i, broadcast_shingles=limit).collect()) == [("1", "clean too"), ("2", "None"), ("None", "clean")]


def test_items_of_one_phrase_and_of_one_id(spark):
    """A phrase that all items begin with finds no candidates by itself; items of one id are one item."""
    items = [(k, "choose the right answer from these words " + " ".join(f"q{k}x{j}" for j in range(30))) for k in range(60)]
    items += [(None, "one two"), (None, "three four five six seven eight"), (7, "short"), (70, "lone")]
    docs = [(k, f"before {t} after {k}") for k, t in items[:30]] + [(100, "choose the right answer from these words " + "w " * 40), (101, "one two three four five six seven eight"), (102, "a lone word"), (103, "one two")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    known = D.Items(*index_of(items[:60]))
    words = D.WordHashes().of(docs[30][1].encode(), fold=True)
    assert known.candidates(D.np.unique(D.runs(words, D.WIDTH))) == []
    got = [sorted(str(tuple(r)[:4]) for r in D.contaminated(d, i, broadcast_shingles=n).collect()) for n in (10**6, 0)]
    assert got[0] == got[1]
    want = {(k, k) for k in range(30)} | {(101, None), (102, 70)}  # of item 7 nearly all is there
    assert {eval(x)[:2] for x in got[0]} == want


def index_of(items):
    words = D.WordHashes()
    sets = [D.np.unique(D.runs(words.of(t.encode(), fold=True), D.WIDTH)) for _, t in items]
    place = D.np.repeat(D.np.arange(len(sets)), [len(s) for s in sets])
    return D.np.concatenate(sets), place, D.np.full(len(place), D.WIDTH), len(sets), D.THRESHOLD


def test_signatures_are_small_and_miss_little():
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, text(400)) for k in range(300)]
    known = D.Items(*index_of(items))
    words, caught = D.WordHashes(), 0
    for k, t in items:
        x = t.split()
        for b in range(8, 400, 27):  # changed words leave about 0.8 of the shingles
            x[b] = "changed"
        hashes = D.np.unique(D.runs(words.of(" ".join([text(3000), *x, text(3000)]).encode(), fold=True), D.WIDTH))
        assert D.held(known.sets[k], hashes) >= 0.8 * known.sizes[k]
        assert len(hashes[: D.np.searchsorted(hashes, known.parts[-1][0][-1])]) < 0.15 * len(hashes)
        caught += k in known.candidates(hashes)
    assert caught >= 0.99 * len(items)
