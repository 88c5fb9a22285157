import io
import os
import random

import pytest

from tallyloom.sources import basket_format as B
from tallyloom.sources import baskets


def test_every_line_once_at_any_split(monkeypatch):
    rng = random.Random(1)
    for read in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(B, "READ_BYTES", read)
        for case in range(40):
            text = b"".join(b"x" * rng.randrange(6) + b"\n" * rng.randrange(3) for _ in range(rng.randrange(12))) + b"end" * (case % 2)
            want = text.split(b"\n")
            want = want[:-1] if want[-1] == b"" else want
            for size in (1, 2, 5, 11, 1000):
                got = [x for at in range(0, len(text), size) for x in B.lines_of(io.BytesIO(text), at, min(at + size, len(text)))]
                assert got == want, (text, size)


def test_lines_as_the_text_source_has_them(spark, tmp_path):
    lines = ["1 2 3", "# note", "", "  7\t-8  +9 ", "1 2 x 3", "12abc 4", "5 99999999999 5", "3 99999999999999999999 4", " # later", "9223372036854775807 -9223372036854775808"]
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(reversed(lines)))
    (tmp_path / "in" / "_hidden").write_text("1 1 1\n")
    B.register(spark)
    shown = lambda df: sorted(map(repr, (r["items"] for r in df.select("items").collect())))
    for size in (3, 50, 10**6):
        read = spark.read.format("baskets").option("splitBytes", size).load(f"{tmp_path}/in")
        assert shown(read) == shown(baskets.read_transactions(spark, f"{tmp_path}/in", skip_comments=False))
        some = spark.read.format("baskets").option("splitBytes", size).option("skipComments", "true").load(f"{tmp_path}/in")
        assert shown(some) == shown(baskets.read_transactions(spark, f"{tmp_path}/in"))
    with pytest.raises(Exception, match="missing"):
        spark.read.format("baskets").load(f"{tmp_path}/missing").collect()


def test_commit_overwrite_and_abort(spark, tmp_path):
    B.register(spark)
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([([3, 1, 3],), ([],), (None,), ([5],)], "items array<bigint>").repartition(3)
    df.write.format("baskets").mode("append").save(path)
    df.limit(1).write.format("baskets").mode("append").save(path)
    read = spark.read.format("baskets").load(path)
    assert read.count() == 5 and not [f for f in os.listdir(path) if f.startswith("_")]
    assert sorted(r["items"] for r in read.collect())[-2:] == [[3, 1, 3], [5]]
    spark.createDataFrame([([8],)], "items array<bigint>").write.format("baskets").mode("overwrite").save(path)
    assert [r["items"] for r in spark.read.format("baskets").load(path).collect()] == [[8]]
    bad = spark.range(20).repartition(4).selectExpr("array(if(id = 13, raise_error('stop'), id)) AS items")
    with pytest.raises(Exception, match="stop"):
        bad.write.format("baskets").mode("append").save(path)
    assert [r["items"] for r in spark.read.format("baskets").load(path).collect()] == [[8]]
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    os.mkdir(tmp_path / "empty")
    assert spark.read.format("baskets").load(f"{tmp_path}/empty").count() == 0


def test_small_splits_share_tasks(monkeypatch):
    rng = random.Random(2)
    for tasks, most in ((1, 10**6), (3, 10**6), (64, 10**6), (2, 50)):
        monkeypatch.setattr(B, "TASKS", tasks, raising=False)
        monkeypatch.setattr(B, "TASK_BYTES", most, raising=False)
        for size in (1, 7, 100):
            files = [(f"f{k}", rng.randrange(200)) for k in range(rng.randrange(6))] + [("one", 1)]
            got = [(p, at, min(at + size, end)) for x in B.dealt(files, size) for p, start, end in x.runs for at in range(start, end, size)]
            assert got == [(p, at, min(at + size, n)) for p, n in files for at in range(0, n, size)]
            assert len(B.dealt(files, size)) <= max(tasks, -(-sum(n for _, n in files) // most)) and all(x.runs for x in B.dealt(files, size))


def test_many_small_splits_are_few_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k} {k + 1}\n" for k in range(3000)))
    B.register(spark)
    read = spark.read.format("baskets").option("splitBytes", 10).load(f"{tmp_path}/a.txt")
    assert read.rdd.getNumPartitions() <= 64
    assert sorted(r["items"] for r in read.collect()) == [[k, k + 1] for k in range(3000)]


def test_a_split_reads_little_beyond_its_end():
    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            out = super().read(size)
            self.n += len(out)
            return out

    source = Counted(b"1 2 3\n" * 500_000)
    assert len(list(B.lines_of(source, 6_000, 12_000))) == 1_000 and source.n < 20_000


def test_text_of_nulls():
    import pyarrow as pa

    assert B.text_of(pa.array([[3, -1], None, [], [7]], pa.list_(pa.int64()))) == b"3 -1\n\n\n7\n"
    assert B.text_of(pa.array([None, [1, 2], [3, 4]], pa.list_(pa.int64())).slice(1, 1)) == b"1 2\n"
