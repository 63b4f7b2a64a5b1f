"""Every query with SQL agrees with DuckDB at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(d: pd.DataFrame) -> list:
    d = d[sorted(d.columns)]
    return sorted(repr([None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) else x for x in r]) for r in d.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
