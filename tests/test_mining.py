"""Golden results, brute force and edge cases of the mining engine."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.__main__ import main
from tallyloom.operators import encode, items, itemsets, mine, paths
from tallyloom.sources import baskets, sinks

TEN = ["1 2 3", "2 3 4", "1 2 4", "2 3", "1 3 4", "2 4", "1 2 3 4", "3 4", "1 2", "2 3 4"]
THIRTEEN = ["1 2 3 4", "1 2 3", "1 2", "2 3 4", "2 3", "1 3", "1 3 4", "1 4", "4 5", "1 5", "2 5", "3 5", "5"]
FIVE = ["6 3 1 4 7 9 13 16", "1 2 3 6 12 13 15", "2 6 8 10 15", "2 3 11 19 16", "1 6 3 5 12 13 16 14"]


ENGINES = ("mllib", "levels", "growth", "groups")


def brute(rows, least):
    sets, out = [set(r) for r in rows if r is not None], {}
    for s in sets:
        for k in range(1, len(s) + 1):
            for c in combinations(sorted(s), k):
                out[c] = out.get(c, 0) + 1
    return {k: n for k, n in out.items() if n >= least}


def frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "tid bigint, items array<int>")


def got(found):
    rows = found.collect()
    assert len({tuple(r.itemset) for r in rows}) == len(rows)
    return {tuple(r.itemset): r.support for r in rows}


def ints(lines):
    return [list(map(int, x.split())) for x in lines]


@pytest.mark.parametrize(("lines", "least", "n"), [(TEN, 2, 14), (TEN, 3, 11), (TEN, 4, 8), (THIRTEEN, 3, 10), (FIVE, 2, 54), (FIVE, 3, 18)])
def test_golden_sizes(spark, lines, least, n):
    for engine in ENGINES:
        found = got(mine.mine(frame(spark, ints(lines)), least, engine=engine))
        assert len(found) == n and found == brute(ints(lines), least)


def test_golden_supports(spark):
    want = {(1,): 5, (2,): 8, (3,): 7, (4,): 7, (1, 2): 4, (1, 3): 3, (1, 4): 3, (2, 3): 5, (2, 4): 5, (3, 4): 5, (1, 2, 3): 2, (1, 2, 4): 2, (1, 3, 4): 2, (2, 3, 4): 3}
    assert got(mine.mine(frame(spark, ints(TEN)), 2)) == want


def test_random_baskets_both_engines(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [rng.choices(range(-1, 9), k=rng.randint(0, 6)) for _ in range(40)]
        for least in (2, 5):
            want = brute(rows, least)
            for engine in ENGINES if seed == 0 else ENGINES[:2]:
                assert got(mine.mine(frame(spark, rows), least, engine=engine)) == want


@pytest.mark.parametrize(
    ("rows", "least", "want"),
    [
        ([[1, 2], [1, 2], [2, 1], [2, 1]], 3, {(1,): 4, (2,): 4, (1, 2): 4}),
        ([[1, 1, 2], [1]], 2, {(1,): 2}),
        ([[0, -1, 5000], [0, -1, 5000]], 2, None),
        ([None, [], [3], [3]], 2, {(3,): 2}),
        ([], 1, {}),
        ([[1], [2]], 9, {}),
        ([[7]] * 7 + [[1, 2]] * 9 + [[3]] * 9, 7, None),
        ([list(range(10))], 1, None),
    ],
)
def test_edges(spark, rows, least, want):
    want = brute(rows, least) if want is None else want
    for engine in ENGINES:
        assert got(mine.mine(frame(spark, rows), least, engine=engine)) == want


def test_threshold_must_be_positive(spark):
    for engine in ENGINES:
        with pytest.raises(ValueError, match="at least 1"):
            mine.mine(frame(spark, [[1]]), 0, engine=engine)
    assert all(int(-(-items.relative_support(c, n) * n // 1)) == c for n in range(1, 120) for c in range(1, n + 1))


def test_text_source_and_cli(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("# comment\n\n1 2 x 3\n12abc 4\n-5\t+6\n" + "\n".join(TEN) + "\n")
    rows = [r.items for r in baskets.read_transactions(spark, f"{tmp_path}/in.txt").orderBy("tid").collect()]
    assert rows[:3] == [[1, 2], [12], [-5, 6]] and rows[3:] == ints(TEN)
    assert [r.items for r in baskets.read_transactions(spark, f"{tmp_path}/in.txt", False).orderBy("tid").collect()][:3] == [[], [], [1, 2]]
    assert baskets.read_text_transactions(spark, f"{tmp_path}/in.txt").first()["items"] == ["1", "2", "x", "3"]
    (tmp_path / "ten.txt").write_text("\n".join(TEN))
    assert main(["mine", f"{tmp_path}/ten.txt", "3", f"{tmp_path}/out"], spark) == 0
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert {tuple(map(int, x.split())) for x in lines} == set(brute(ints(TEN), 3))
    assert main(["mine", f"{tmp_path}/ten.txt", "4"], spark) == 0 and "2 3 5" in capsys.readouterr().out.splitlines()
    assert main(["compare", f"{tmp_path}/out", f"{tmp_path}/out"], spark) == 0 and "in both: 11" in capsys.readouterr().out
    assert main(["count", f"{tmp_path}/ten.txt", "6", f"{tmp_path}/counts"], spark) == 0
    assert {r.value for r in spark.read.text(f"{tmp_path}/counts").collect()} == {"0 0", "1 5", "2 8", "3 7", "4 7", "5 0"}
    assert main(["rerank", f"{tmp_path}/in.txt", f"{tmp_path}/ranked"], spark) == 0
    assert "6 4" in {r.value for r in spark.read.text(f"{tmp_path}/ranked").collect()} or spark.read.text(f"{tmp_path}/ranked").count() == 13
    assert main([], spark) == main(["mine"], spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        baskets.read_transactions(spark, f"{tmp_path}/missing.txt")


def test_csv_dictionary(spark, tmp_path):
    (tmp_path / "b.csv").write_text("milk, whole bread ,,eggs\n\neggs,milk,milk\n , \nbutter\n")
    cells = baskets.read_csv_baskets(spark, f"{tmp_path}/b.csv")
    names = encode.first_seen(cells, ["row", "col"])
    assert {r.item: r.id for r in names.collect()} == {"milk": 1, "whole bread": 2, "eggs": 3, "butter": 4}
    coded = encode.encode(cells, names)
    assert sorted(r["items"] for r in coded.collect()) == [[1, 2, 3], [3, 1, 1], [4]]
    sinks.write_dictionary(names, f"{tmp_path}/d")
    assert {(r.item, r.id) for r in sinks.read_dictionary(spark, f"{tmp_path}/d").collect()} == {(r.item, r.id) for r in names.collect()}
    with pytest.raises(Exception, match="line end"):
        sinks.write_dictionary(spark.createDataFrame([("two\nlines", 1)], "item string, id bigint"), f"{tmp_path}/broken")
    found = mine.mine(coded, 2)
    assert got(itemsets.relabel(found.withColumn("itemset", F.col("itemset").cast("array<int>")), names)) == {("milk",): 2, ("eggs",): 2, ("eggs", "milk"): 2}


def test_rerank_keeps_order_and_repeats(spark):
    out = encode.rerank_transactions(frame(spark, [[900, 5, 900], [], [70, 5]]))
    assert {r.tid: r["items"] for r in out.collect()} == {0: [3, 1, 3], 1: [], 2: [2, 1]}


def test_paths_and_tree(spark):
    long = baskets.explode_items(frame(spark, ints(TEN)))
    ranks = paths.ranked_items(long, 2)
    assert [(r.item, r.support, r["rank"]) for r in ranks.orderBy("rank").collect()] == [(2, 8, 1), (3, 7, 2), (4, 7, 3), (1, 5, 4)]
    found = paths.weighted(paths.filtered(long, ranks))
    got_paths = {tuple(s["item"] for s in r.path): r.w for r in found.collect()}
    assert got_paths == {(2, 3, 1): 1, (2, 3, 4): 2, (2, 4, 1): 1, (2, 3): 1, (3, 4, 1): 1, (2, 4): 1, (2, 3, 4, 1): 1, (3, 4): 1, (2, 1): 1}
    tree = paths.nodes(found)
    assert {r.item: r.support for r in paths.header(tree).collect()} == {2: 8, 3: 7, 4: 7, 1: 5}
    stats = paths.tree_stats(tree).first()
    assert (stats.nodes, stats.depth) == (len({p[:k] for p in got_paths for k in range(1, len(p) + 1)}), 4)
    assert paths.leaves(tree).count() == 5
    flat = paths.flat(tree).orderBy("pos").collect()
    assert [r.pos for r in flat] == list(range(stats.nodes)) and all(r.parent < r.pos for r in flat)
    up = {r.pos: r for r in flat}
    assert all(r.prefix[:-1] == (up[r.parent].prefix if r.parent >= 0 else []) and r.depth == len(r.prefix) for r in flat)
    assert [r.line for r in paths.tree_lines(tree).orderBy("place").collect()] == ["  " * (r.depth - 1) + f"{r['item']} ({r.support})" for r in flat]
    base = {tuple(s["item"] for s in r.base): r.w for r in paths.pattern_base(found, 1).collect()}
    assert base == {(2, 3): 1, (2, 4): 1, (3, 4): 1, (2, 3, 4): 1, (2,): 1}
    assert {tuple(s["item"] for s in r.path): r.w for r in paths.conditional_paths(found, 1, 4).collect()} == {(2,): 4}
    starts = [r.start for r in paths.offsets(tree).orderBy("start").collect()]
    assert starts[0] == 0 and len(starts) == stats.nodes


def test_ranges_give_the_same_ranks(spark, monkeypatch):
    long = baskets.explode_items(frame(spark, ints(FIVE)))
    want = sorted(map(tuple, paths.ranked_items(long, 1).collect()))
    monkeypatch.setattr(items, "WINDOW_ITEMS", 0)
    monkeypatch.setattr(paths, "BROADCAST_ITEMS", 0)
    ranks = paths.ranked_items(long, 1)
    assert sorted(map(tuple, ranks.collect())) == want and paths.filtered(long, ranks).count() == 5


def test_single_path(spark):
    chain = spark.createDataFrame([([4, 2, 9], [9, 5, 3])], "items array<int>, counts array<bigint>")
    assert got(mine.power_set(chain, 4)) == {(4,): 9, (2,): 5, (2, 4): 5}
    assert len(got(mine.power_set(chain, 1))) == 7


def test_comparison(spark):
    a = mine.mine(frame(spark, ints(TEN)), 2)
    b = mine.mine(frame(spark, ints(TEN)), 3)
    assert itemsets.same(a, a) and not itemsets.same(a, b) and itemsets.only_in(b, a).isEmpty()
    assert [r.itemset for r in itemsets.sample_of(itemsets.only_in(a, b)).collect()] == [[1, 2, 3], [1, 2, 4], [1, 3, 4]]
    score = itemsets.match_score(a, b).first()
    assert (score.matched, score.total) == (11, 14)
    lines = spark.createDataFrame([("3 1 ",), ("1 3",), ("",), ("a 1",), ("2 2",)], "value string")
    assert sorted(r.itemset for r in itemsets.parse_itemsets(lines).collect()) == [[1, 3], [2]]
    assert {r["size"]: r.n for r in itemsets.size_histogram(a).collect()} == {1: 4, 2: 6, 3: 4}
    rule = {(tuple(r.antecedent), r.consequent): (r.support, round(r.confidence, 3)) for r in mine.rules(a, 0.7, 10).collect()}
    assert rule[((1,), 2)] == (4, 0.8) and all(c >= 0.7 for _, c in rule.values())


def test_streaming_counts(spark, tmp_path):
    from tallyloom.streaming.item_counts import windowed_support

    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-05 00:00:00", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/ev")
    q = windowed_support(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/ev")).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r.start)[:10], r["item"]): r.support for r in spark.sql("select * from counts").collect()} == {("2024-01-01", "a"): 2, ("2024-01-02", "b"): 1, ("2024-01-05", "b"): 1}


def test_timer():
    from tallyloom.functions.timing import StageTimer

    t = StageTimer()
    for _ in range(2):
        with t.stage("a"):
            pass
    with t.stage("b"):
        pass
    assert list(t.seconds) == ["a", "b"] and t.total >= 0 and t.report().splitlines()[-1].startswith("total")


def test_csv_cells_as_csv_readers_have_them(spark):
    import csv

    rng = random.Random(2)
    lines = ["".join(rng.choices('ab ",', k=rng.randrange(14))) for _ in range(400)] + ['"a,b",c', '"x""y",z', '"', '""', ",,", "", "a"]
    lines = [x for x in lines if len(list(csv.reader([x]))) <= 1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = {r.i: list(r.c) for r in df.select("i", baskets.csv_cells(F.col("value")).alias("c")).collect()}
    for i, x in enumerate(lines):
        want = [c.strip("\n") for c in (list(csv.reader([x])) or [[]])[0]]
        assert [c for c in got[i] if c] == [c for c in want if c], x


def test_large_ids_are_ordinary_items(spark, tmp_path):
    rows = ["1 99999999999 3", "99999999999 3", "3 99999999999 99999999999999999999 1", "9223372036854775807 -9223372036854775808"]
    (tmp_path / "big.txt").write_text("\n".join(rows))
    read = baskets.read_transactions(spark, f"{tmp_path}/big.txt")
    assert [r["items"] for r in read.orderBy("tid").collect()] == [[1, 99999999999, 3], [99999999999, 3], [3, 99999999999], [2**63 - 1, -(2**63)]]
    for engine in ENGINES:
        assert got(mine.mine(read, 3, engine=engine)) == {(3,): 3, (99999999999,): 3, (3, 99999999999): 3}
    cells = read.select(F.col("tid").alias("row"), F.posexplode("items").alias("col", "item"))
    assert {r.item for r in encode.dense_rerank(cells).collect()} == {1, 3, 99999999999, 2**63 - 1, -(2**63)}
    assert [r.support for r in items.dense_histogram(cells, 4).orderBy("item").collect()] == [0, 1, 0, 3]


def test_local_order_of_a_conditional_tree(spark):
    # globally 1 > 2 > 3 > 9; before 9, item 3 is the most frequent one
    rows = [[1]] * 9 + [[1, 2]] * 4 + [[2]] * 3 + [[3, 9], [3, 9], [2, 3, 9], [1, 2, 3, 9]]
    long = baskets.explode_items(frame(spark, rows))
    found = paths.weighted(paths.filtered(long, paths.ranked_items(long, 1)))
    shown = lambda x: {tuple(s["item"] for s in r.path): r.w for r in x.collect()}
    assert shown(paths.conditional_paths(found, 9, 2)) == {(3,): 2, (2, 3): 2}
    assert shown(paths.local_conditional_paths(found, 9, 2)) == {(3,): 2, (3, 2): 2}


def test_power_set_of_any_chain(spark):
    chain = lambda n: spark.createDataFrame([(list(range(n)), [10 + n - i for i in range(n)])], "items array<int>, counts array<bigint>")
    assert mine.power_set(chain(17), 1).count() == 2**17 - 1
    few = mine.power_set(chain(17), 26)
    assert {tuple(r.itemset): r.support for r in few.collect()} == {(0,): 27, (1,): 26, (0, 1): 26}
    with pytest.raises(Exception, match="over 60 items"):
        mine.power_set(chain(61), 1).count()


def test_running_sums_and_released_tables(spark):
    import os

    from tallyloom.functions import shared

    df = spark.createDataFrame([(i % 7, i, (i * 37) % 11) for i in range(200)], "k int, i int, v int").repartition(5)
    want, total = {}, 0
    for r in sorted(df.collect(), key=lambda r: (r.k, r.i)):
        want[r.i], total = total, total + r.v
    assert {r.i: r.s for r in shared.running_sums(df, [F.asc("k"), F.asc("i")], "v", "s").collect()} == want
    at = shared.materialize(df)
    path = at._at.removeprefix("file:")
    assert os.path.isdir(path)
    shared.release(at)
    assert not os.path.isdir(path)
    before = len(shared._written)
    mine.mine(frame(spark, ints(TEN)), 2, engine="levels").collect()
    assert len(shared._written) == before + 1  # the result's own


def test_levels_with_shuffled_itemsets(spark, monkeypatch):
    monkeypatch.setattr(mine, "BROADCAST_ITEMSETS", 0)
    monkeypatch.setattr(mine, "BROADCAST_ITEMS", 0)
    assert got(mine.mine(frame(spark, ints(FIVE)), 2, engine="levels")) == brute(ints(FIVE), 2)
    assert {len(k) for k in got(mine.mine(frame(spark, ints(FIVE)), 2, engine="levels", max_size=2))} == {1, 2}


def test_validation_of_result_files(spark, tmp_path, capsys):
    ten, four = "\n".join(" ".join(map(str, k)) for k in brute(ints(TEN), 3)), "\n".join(" ".join(map(str, reversed(k))) for k in brute(ints(TEN), 4))
    for name, text in {"ten_ms3_py": ten, "ten_ms3_org": ten + "\n# note\n", "ten_ms3_pfp": four, "ten_ms4_py": four, "ten_ms4_org": four + "\n7\n", "lost_org": ten, "ten_ms4_none": ""}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    assert main(["validate", str(tmp_path), "py"], spark) == 0
    got = capsys.readouterr().out.splitlines()
    assert got[:5] == ["lost org: different, common 0, only in py 0, only in org 11", "ten_ms3 org: same, common 11, only in py 0, only in org 0", "ten_ms3 pfp: different, common 8, only in py 3, only in pfp 0", "ten_ms4 none: different, common 0, only in py 8, only in none 0", "ten_ms4 org: different, common 8, only in py 0, only in org 1"]
    assert got[5:] == ["none: 0 of 1 (0.0 %)", "org: 1 of 3 (33.3 %)", "pfp: 0 of 1 (0.0 %)"]


def test_growth_projects_until_a_task_can_mine(spark):
    rng = random.Random(8)
    rows = [rng.choices(range(12), k=rng.randint(1, 9)) for _ in range(120)] + [[1, 2, 3, 4, 5]] * 9
    want = brute(rows, 4)
    assert max(map(len, want)) > 3
    for cells in (0, 30, 10**6):
        assert got(mine.mine(frame(spark, rows), 4, engine="growth", local_cells=cells)) == want
        assert got(mine.mine(frame(spark, rows), 4, engine="groups", local_cells=cells, groups=5)) == want


def test_groups_hold_their_share(spark):
    from tallyloom.operators import growth

    rng = random.Random(9)
    rows = [rng.choices(range(40), weights=[40 - k for k in range(40)], k=rng.randint(2, 12)) for _ in range(300)]
    long = baskets.explode_items(frame(spark, rows))
    found = paths.weighted(paths.filtered(long, paths.ranked_items(long, 2)))
    dealt = growth.item_groups(found, 6).collect()
    total = sum(r.cells for r in dealt)
    bounds = growth._bounds(growth.item_groups(found, 6))
    shards = growth.group_paths(found, bounds)
    sizes = {r.grp: r.cells for r in growth.group_sizes(shards).collect()}
    for g, lo, hi in bounds:
        own = [r for r in dealt if r.grp == g]
        assert {r["rank"] for r in own} == set(range(lo, hi + 1))
        assert sizes[g] <= sum(r.cells for r in own) <= total / 6 + max(r.cells for r in own)
    # each path once for each group that has an item on it, whole up to the last such item
    want = {}
    for r in found.collect():
        ranks = [s["rank"] for s in r.path]
        for g, lo, hi in bounds:
            if at := [k for k, x in enumerate(ranks) if lo <= x <= hi]:
                key = g, tuple(ranks[: at[-1] + 1])
                want[key] = want.get(key, 0) + r.w
    assert {(r.grp, tuple(r.prefix)): r.w for r in shards.collect()} == want


def test_a_chain_is_not_walked(spark, monkeypatch):
    """A transaction of 18 items, repeated: its 2^18 - 1 itemsets come from chains; no step makes states of them."""
    from tallyloom.operators import growth

    rows, seen = [list(range(18))] * 5, []
    write = growth.materialize

    def counted(df):
        out = write(df)
        if "prefix" in df.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(growth, "materialize", counted)
    out = mine.mine(frame(spark, rows), 3, engine="growth", local_cells=0)
    assert out.count() == 2**18 - 1 and out.filter("support = 5").count() == 2**18 - 1
    assert out.select("itemset").distinct().count() == 2**18 - 1 and sum(seen) <= 2 * 18
    tree = growth.array_tree([(1, 2, 3), (1, 2)], [2, 3])
    assert tree == ([1, 2, 3], [-1, 0, 1], [5, 5, 2])
    assert dict(growth.grown(tree, 2)) == {(1,): 5, (2,): 5, (2, 1): 5, (3,): 2, (3, 1): 2, (3, 2): 2, (3, 2, 1): 2}


def test_states_on_disk_are_bounded(spark, monkeypatch):
    """Chunks of a level are followed one after the other: the states that are on disk at once stay small, the rows the same."""
    rng = random.Random(3)
    rows = [rng.choices(range(14), k=9) for _ in range(150)]
    want, live, most = brute(rows, 5), {}, {}
    write, drop = mine.materialize, mine.release

    def materialize(df):
        out = write(df)
        if "prefix" in df.columns:
            live[id(out)] = out, out.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
        most[0] = max(most.get(0, 0), sum(n for _, n in live.values()))
        return out

    def release(*frames):
        for f in frames:
            live.pop(id(f), None)
        drop(*frames)

    monkeypatch.setattr(mine, "materialize", materialize)
    monkeypatch.setattr(mine, "release", release)
    found = {}
    for cells in (10**9, 400):
        most.clear()
        assert got(mine.mine(frame(spark, rows), 5, engine="levels", chunk_cells=cells)) == want
        assert not live
        found[cells] = most[0]
    first = sum(len(set(r)) * (len(set(r)) - 1) // 2 for r in rows)
    assert found[400] < found[10**9] and found[400] <= first + 2 * 400 * max(map(len, want))


def test_pointers_of_any_depth(spark):
    rng = random.Random(5)
    parent = {k: (None if k % 50 == 0 else rng.randrange(k - k % 50, k)) for k in range(300)}
    item = {k: f"i{k}" for k in parent}
    df = spark.createDataFrame([(k, p, item[k]) for k, p in parent.items()], "id long, parent long, item string")
    for r in mine.decode_pointers(df).collect():
        way, at = [], r.id
        while at is not None:
            way.append(item[at])
            at = parent[at]
        assert list(r["items"]) == way[::-1]
    deep = spark.createDataFrame([(k, k - 1 if k else None, k) for k in range(70)], "id long, parent long, item long")
    assert {r.id: len(r["items"]) for r in mine.decode_pointers(deep).collect()} == {k: k + 1 for k in range(70)}
    for rows, why in (([(1, 2, 7), (2, 3, 8), (3, 1, 9), (4, None, 1)], "cycle"), ([(1, 1, 7)], "cycle"), ([(1, 9, 7)], "isn't there")):
        with pytest.raises(ValueError, match=why):
            mine.decode_pointers(spark.createDataFrame(rows, "id long, parent long, item long")).collect()
    assert mine.decode_pointers(deep.limit(0)).count() == 0


def test_work_is_balanced_on_a_skewed_tree(spark):
    rng = random.Random(6)
    rows = [sorted(rng.sample(range(30), rng.choice([1, 2, 3, 25]))) for _ in range(200)]
    long = baskets.explode_items(frame(spark, rows))
    tree = paths.nodes(paths.weighted(paths.filtered(long, paths.ranked_items(long, 1))))
    by = {r.part: r.cost for r in paths.balanced(tree, 8).groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.col("depth") - 1).alias("cost")).collect()}
    mean = sum(by.values()) / 8
    assert len(by) == 8 and max(by.values()) <= 1.1 * mean
    assert paths.balanced(tree, 3).count() == tree.count()
