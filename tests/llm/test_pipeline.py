import random
from collections import Counter, defaultdict

import corpus_pipeline
from tallyloom.llm import language_id, line_dedup, mixing


def shingles(t):
    x = (t or "").lower().split()
    return {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set()


def brute(docs, items, known):
    """The stages after language ID, on rows (id, text, source)."""
    pages = Counter(s for _, _, s in docs)
    n = Counter((s, x) for _, t, s in docs for x in set(t.split("\n")))
    docs = [(i, "\n".join(x for x in t.split("\n") if not (n[s, x] >= 3 and n[s, x] > line_dedup.RATIO * pages[s])), s) for i, t, s in docs if i in known]
    sets, root = {i: shingles(t) for i, t, _ in docs}, {}
    for i in sorted(sets):
        root.setdefault(i, i)
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                for k, r in root.items():
                    if r == b:
                        root[k] = a
    docs = [d for d in docs if root[d[0]] == d[0]]
    return [d for d in docs if not any(len(sets[d[0]] & shingles(s)) >= 0.8 * len(shingles(s)) for s in items)]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    items = [text(20) for _ in range(4)]
    docs = []
    for i in range(160):
        t = text(rng.choice([8, 40, 80]))
        if i % 6 == 1 and docs:
            t = rng.choice(docs)[1].split("\n")[1]
        if i % 17 == 0:
            t += " " + items[i % 4]
        docs.append((i, f"menu home\n{t}\nline {i}" if i % 3 else f"top\n{t}\nline {i}", f"s{i % 4}"))
    docs += [(900, "12 34 56", "s1"), (901, "", "s1")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = {i for i, t, _ in docs if language_id.has_letter(t.encode())}
    left = brute([d for d in docs if d[0] in known], items, known)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in left}
    words = defaultdict(int)
    for i, t, s in left:
        assert got[i]["size"] == len(t.split()) and got[i].source == s
        words[s] += got[i]["size"]
    for s, n in words.items():
        mine = [r for r in got.values() if r.source == s]
        assert mine[0].source_size == n and sum(r.taken for r in mine) == int(mine[0].target)
    assert abs(sum(r.taken for r in got.values()) - sum(words.values())) <= len(words)
    assert mixing.SEED == "mix-1"


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words in a row here", "en", None, 24), (2, "some words in a row here", "en", None, 24), (3, "some words in a row here", None, "a", 24), (4, "12", "de", "a", 2), (5, "w " * 40_000, "en", "b", 80_000)]
    extra = "size long, key string, lang_pred int, score double, drop int, gone string, target int, text_of string"
    docs = spark.createDataFrame([(*r, 7, "k", 1, 0.5, 2, "g", 3, "t") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    spark.createDataFrame([(0, None), (None, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        ids = [r.doc_id for r in out.collect()]
        assert set(ids) == {"language": {2, 3, 5}, "lines": {None, 1, 2, 3, 4, 5}, "near": {None, 1, 2, 4, 5}, "clean": {None, 1, 2, 3, 4, 5}}[name]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert mixed.count() == len(rows) and mixed.filter("doc_id is null").first().taken == 0
