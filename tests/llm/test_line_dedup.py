from collections import Counter

import duckdb

from tallyloom.llm import common
from tallyloom.llm import line_dedup as L


def rows():
    out = [(i, f"head\nline {i}\n{'menu' if i % 3 else 'x'}\n\nend {i % 40}", "s" if i % 3 else None) for i in range(90)]
    return [*out, (200, None, "s"), (201, "", "s"), (202, "menu", "s"), (202, "menu", "s"), (203, "head\nhead\nown", "other"), (204, "x" * 500_000, "s")]


def naive(rows, ratio=L.RATIO, least=L.LEAST):
    pages = Counter(s for _, _, s in rows)
    n = Counter((s, x) for _, t, s in rows if t is not None for x in set(t.split("\n")))
    bad = {k for k, c in n.items() if c >= least and c > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad), 0 if t is None else sum((s, x) in bad for x in t.split("\n"))) for i, t, s in rows]


def test_against_naive_by_both_ways(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows()], "doc_id bigint, text string, source string, line int, drop int")
    for limit in (10**6, 0):
        out = L.line_dedup(df, removed="n_removed", broadcast_lines=limit)
        assert out.columns == [*df.columns, "n_removed"]
        assert sorted(map(str, naive(rows()))) == sorted(str((r.doc_id, r.text, r.n_removed)) for r in out.collect())


def test_hashes_in_both_languages(spark):
    texts = ["", "é", "\n\n", "a line\nanother \U0001f600", "x" * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", L.hashes(L.F.col("t")).alias("h")).collect():
        assert [h & (1 << 64) - 1 for h in r.h] == L.line_hashes(r.t.split("\n"))


def test_a_page_of_many_boilerplate_lines(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    long = "\n".join(f"line {k}" for k in range(30_000))
    data = [(i, long, "s") for i in range(9)] + [(10, "own", "s"), (11, "line 1\nown", "t")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    for limit in (10**6, 0):
        out = {r.doc_id: (r.text, r.gone) for r in L.line_dedup(df, removed="gone", broadcast_lines=limit).collect()}
        assert out == {**{i: ("", 30_000) for i in range(9)}, 10: ("own", 0), 11: ("line 1\nown", 0)}


def test_sql(spark):
    documents = spark.createDataFrame([r for r in rows() if r[0] != 202], "doc_id bigint, text string, source string").toPandas()  # noqa: F841
    assert sorted(map(str, duckdb.sql(L.SQL).fetchall())) == sorted(map(str, naive([r for r in rows() if r[0] != 202])))


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
