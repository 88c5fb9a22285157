import duckdb

from tallyloom.llm import common, mixing


def naive_targets(words, weights=(1, 2, 3), most=3):
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(words.values()), set()
    while True:
        free = [s for s in words if s not in capped]
        rest = total - sum(most * words[s] for s in capped)
        share = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * words[s] + 1e-9}
        if not over:
            return share | {s: float(most * words[s]) for s in capped}
        capped |= over


def rows():
    out = [(i, "w " * (i % 7), ["b", "a", None, "z", "é"][i % 5 if i % 11 else 0]) for i in range(200)]
    return [*out, (3, "w w", "a"), (3, "w w", "a"), (None, "one\ttwo\n", "tiny"), (900, None, "none"), (901, "x " * 20_000, "big")]


def test_targets_and_taken(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, source string").withColumn("key", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = mixing.mix(df).collect()
    words = {}
    for r in got:
        words[r.source] = words.get(r.source, 0) + r["size"]
    want = naive_targets(words)
    assert len(got) == len(rows())
    for s in words:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == words[s] and 0 <= r.taken <= 3 * r["size"] for r in mine)
        assert sum(r.taken for r in mine) == int(mine[0].target)
    assert sorted(got, key=str) == sorted(mixing.mix(df).collect(), key=str)


def test_sql_and_ranges_agree(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, source string")
    documents = df.toPandas()  # noqa: F841  read by DuckDB
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    sql = sorted(map(str, duckdb.sql(mixing.SQL).fetchall()))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(str(tuple(r)) for r in mixing.mix(df).select(cols).collect()) == sql
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "RANGES", 3)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "REPEAT_ROWS", 1)
    assert sorted(str(tuple(r)) for r in mixing.mix(df).select(cols).collect()) == sql


def test_many_rows_of_one_id(spark, monkeypatch):
    """100,000 rows without an id or of one id, some alike, in a source of half of all rows."""
    rows = [(None if i % 2 else 5, "w " * (i % 30), "hot") for i in range(100_000)] + [(i + 10, "w w w", f"s{i % 3}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    monkeypatch.setattr(mixing, "RANGES", 2)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in ("hot", "s0", "s1", "s2"):
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target) and sum(0 < r.taken % r["size"] for r in mine if r["size"]) <= 1


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")).first().taken == 0
