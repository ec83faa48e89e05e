"""Every registered query of the library against its SQL, and the fixed numbers of the fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalog import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def same(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLES[name]})").fetchall()
    assert len(duck.execute(ORACLES[name]).description) == len(cols)
    got = [tuple(same(r[c]) for c in cols) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((tuple(same(x) for x in r) for r in found), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_fixed_numbers(spark, sf01):
    rows = QUERIES["assemble_2"](spark, sf01).agg(F.count(F.lit(1)), F.round(F.sum(F.col("sample_idx") * F.col("click")), 2)).first()
    assert tuple(rows) == (1315, 276735.33)
    assert tuple(QUERIES["monotonic_ms"](spark, sf01).agg(F.sum("fixed"), F.max("fixed")).first()) == (440794157, 105666)
    assert tuple(QUERIES["monotonic_unit"](spark, sf01).agg(F.sum("fixed"), F.max("fixed")).first()) == (189204459, 49012)
    assert QUERIES["nearest_frame"](spark, sf01).where("event_id >= 0").agg(F.sum("event_id")).first()[0] == 9011531
    assert QUERIES["pipeline_nested_literal"](spark, sf01).count() == 3940
    assert QUERIES["json_props"](spark, sf01).agg(F.sum("k")).first()[0] == 498223


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 132
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
