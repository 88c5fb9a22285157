import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.llm import registry

SF = "/root/testdata/sf0.001"


def canon(rows):
    return sorted(repr([None if x is None else x for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    frame = entry.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    assert canon(tuple(r) for r in frame.select(cols).collect()) == canon(con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())
