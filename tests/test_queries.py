"""Every registered query against its SQL."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pairwright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


# The cycle's queries are views of one plan, which test_cycle.py holds against a plain planner on the same tables.
@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("cycle_") or n in catalog.ORACLE))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert got or name in ("pair_identity_mutual", "synced_duplicates")  # none in the smallest tables
    if name in catalog.ORACLE:
        want = con.sql(catalog.ORACLE[name])
        assert sorted(want.columns) == names
        assert got == Counter(tuple(map(plain, r)) for r in want.select(*[f'"{n}"' for n in names]).fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 150 and set(catalog.ORACLE) <= set(entry.oracle_sql())
