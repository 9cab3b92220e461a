"""Every registered query of the engine against its DuckDB SQL, on the smallest tables."""

import math

import duckdb
import pytest

import sievemark.queries_reports  # noqa: F401
from sievemark.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else round(x, 9)
    return x


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    cursor = tables.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    by = sorted(range(len(names)), key=lambda k: names[k])
    wanted = [tuple(plain(r[k]) for k in by) for r in cursor.fetchall()]
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == [names[k] for k in by]
    found = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert ordered(found) == ordered(wanted)
