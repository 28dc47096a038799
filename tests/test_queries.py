"""Every registered query of the core against its SQL."""

import math
import os

import duckdb
import pytest

from tessera.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return (0, "")
        return (1, round(float(v), 3) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else (2, str(v).split("+")[0])

    return sorted(tuple(one(v) for v in r) for r in rows)


def _near(a, b):
    return a == b or a[0] == b[0] == 1 and math.isclose(a[1], b[1], rel_tol=1e-5, abs_tol=2e-3)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = _plain(df.select(*[f"`{c}`" for c in columns]).collect())
    wanted = _plain(sql.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())
    assert len(found) == len(wanted)
    assert all(_near(a, b) for x, y in zip(found, wanted, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
