"""The driver contract and oracle parity of every registered query."""

import pytest

import __spark_entry__ as E
from hushwin.plans.catalog import QUERIES
from tests.parity import compare

SF01 = "/root/testdata/sf0.01"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def test_oracles():
    """Every query of the library itself has SQL; of the others, those that SQL can express."""
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_parity(spark, name):
    r = compare(spark, SF01, name, E.queries()[name], E.oracle_sql()[name])
    assert r["ok"], r


def test_queries_pin_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        r = compare(spark, SF01, "window_reduce_max", E.queries()["window_reduce_max"],
                    E.oracle_sql()["window_reduce_max"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r["ok"], r


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


def test_column_types_match_oracle(spark):
    from tests.parity import duck
    con = duck("/root/testdata/sf0.001")
    for name, sql in E.oracle_sql().items():
        q = E.queries()[name]
        s = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType))
             for f in q(spark, "/root/testdata/sf0.001").schema.fields}
        rel = con.sql(sql)
        assert s == dict(zip(rel.columns, map(str, rel.types))), name
