"""Every registered query of the library against its SQL in DuckDB, on small tables."""

import math

import duckdb
import pytest

from mnemora.plans import catalog
from mnemora.plans.views import TABLES

KEYS = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(pdf):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        try:
            return round(float(x), 5) if not isinstance(x, (str, bool, bytes)) else x
        except (TypeError, ValueError):
            return None if str(x) == "<NA>" else str(x)

    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, duck, sf_dir, key):
    got = catalog.QUERIES[key](spark, sf_dir).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[key]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "id", "score", "source"] and df.count() > 0
