"""Every catalogue query against its SQL in DuckDB, on the smallest driver tables."""

import math

import duckdb
import pytest

from girder.plans import exchange_catalogue, geometry_catalogue, review_catalogue, scene_catalogue, source_catalogue  # noqa: F401  they add their queries
from girder.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name].strip()})").fetchall()
    assert wanted, "the comparison would show nothing"
    assert plain(found.select(*columns).collect()) == plain(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
