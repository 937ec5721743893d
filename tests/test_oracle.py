"""Every query of the core library against its SQL, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from marginalia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, int | float | Decimal) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows or name == "cloze_cards"  # few texts hold its patterns
    if (sql := registry.oracle_sql().get(name)) is not None:
        want = db.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
