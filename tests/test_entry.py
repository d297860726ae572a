import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    return round(v, 3) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    duck.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in duck.description].index(n) for n in names]
    want = sorted(repr([cell(r[i]) for i in order]) for r in duck.fetchall())
    assert sorted(repr([cell(v) for v in r]) for r in df.select(*names).collect()) == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())
    assert any(k.startswith("op1_") for k in entry.queries()) == (entry.llm_registry is not None)
