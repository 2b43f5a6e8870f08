"""Every query against its SQL, run by another engine on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quire.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else x
    return int(x) if hasattr(x, "__index__") else x


def rows(frame):
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def other(small):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


KNOWN, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query(spark, small, other, name):
    found = KNOWN[name](spark, small).toPandas()
    if name in ORACLE:
        wanted = other.sql(ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found)
