import hashlib
import os
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pytest

from tallyloom.llm import alignment as A

pytestmark = pytest.mark.skipif(not os.path.exists(A.A_PATH), reason="tokenizers are not here")

TEXTS = [
    None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "Hello world, it's 12 o'clock.\n\nA new line  with two spaces\tand a tab ", "naïve café 東京 \U0001f600 x́",
    "<|endoftext|> <s> </s> <unk> <0x0A> ▁x a▁b", "ﬁ ligature   no-break　wide", "x\x00y \x1cz \x85 q\r\nr", "\n\n\nabc\n def\n  ghi \n", "aaaa" * 300, "one two one two\none two", "one two one two\none two",
    "don't we'll  they're\t\tI'M", "12345 678 9.10", "!!! ??? ...   end", "word sep ­soft", "é ́ x", "a\n b", "a \nb", "tail   \n\n",
]


def slow(units, text):
    """Whole texts, without parts: groups by common ends, links by all pairs that end together."""
    if not text:
        return None
    ia, ib = units.a.encode(f" {text}", add_special_tokens=False).ids, units.b.encode(text)
    raw = f" {text}".encode()
    if b"".join(units.a_bytes[i] for i in ia) != raw or b"".join(units.b_bytes[i] for i in ib) != raw:
        return None
    ends = lambda ids, of: list(accumulate(len(of[k]) for k in ids))
    ea, eb = ends(ia, units.a_bytes), ends(ib, units.b_bytes)
    cuts = [0, *sorted(set(ea) & set(eb))]
    inside = lambda ids, e, lo, hi: ids[bisect_right(e, lo) : bisect_right(e, hi)]
    groups = [(inside(ia, ea, lo, hi), inside(ib, eb, lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    links = [(a, b) for a, x in zip(ia, ea, strict=True) for b in inside(ib, eb, x - 1, x)]
    return len(ia), len(ib), groups, links


@pytest.fixture(scope="module")
def units():
    return A.Units(open(A.A_PATH, "rb").read(), open(A.B_PATH, "rb").read())


def expected(units, texts):
    found = [slow(units, t) for t in texts]
    count = Counter(p for f in found if f for p in f[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((a, b, len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), said))
    return out, count


def columns(r, groups="groups"):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r[groups]


def test_against_whole_texts(spark, units, monkeypatch):
    assert units.cut
    monkeypatch.setattr(A, "SLICE_BYTES", 200)
    monkeypatch.setattr(A, "SHARD_KEYS", 16)
    monkeypatch.setattr(A, "ASKING", 2)
    monkeypatch.setattr(A, "KEPT_PARTS", 5)
    monkeypatch.setattr(A, "RUN_CHARS", 60)
    want, count = expected(units, TEXTS)
    df = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string, keys long").repartition(3)
    got = {r.doc_id: r for r in A.align(df).collect()}
    assert len(got) == len(TEXTS) and all(r["keys"] == r.doc_id for r in got.values())
    for i, w in enumerate(want):
        assert columns(got[i]) == w, TEXTS[i]
    assert sum(w[6] == "" for w in want) < len(TEXTS) / 2
    pairs = {(r.a, r.b): r.n for r in A.pair_counts(df).collect()}
    assert pairs == dict(count)


def test_digest_nulls_repeats_empty(spark, units):
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = expected(units, [t for _, t in rows])
    got = sorted((repr(r.doc_id), *columns(r, "g")) for r in A.align(df, keep=["doc_id"], groups="g", digest=True).collect())
    assert got == sorted((repr(i), *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for (i, _), w in zip(rows, want, strict=True))
    assert A.align(df.limit(0)).count() == 0 and A.pair_counts(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query_on_the_test_table(spark, units):
    from tallyloom.llm import registry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len(d.text or "") < 6_000]
    df = spark.createDataFrame([(d.doc_id, d.text) for d in docs], "doc_id long, text string")
    want, _ = expected(units, [d.text for d in docs])
    got = {r.doc_id: columns(r, "groups_sha256") for r in A.align(df, keep=["doc_id"], groups="groups_sha256", digest=True).collect()}
    assert got == {d.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for d, w in zip(docs, want, strict=True)}
    whole = registry.op12_token_alignment(spark, "/root/testdata/sf0.001")
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and whole.count() == 200


def test_a_vocabulary_that_reaches_over_cuts_is_encoded_whole(units):
    assert not A.Units.cuts({"pre_tokenizer": {"type": "ByteLevel"}}, ["a▁b"])
    assert not A.Units.cuts({"pre_tokenizer": {"type": "Whitespace"}}, ["a"])
    assert A.Units.cuts({"pre_tokenizer": {"type": "ByteLevel"}}, ["▁▁a", "▁"])
