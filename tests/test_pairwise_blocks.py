import numpy as np
import pytest

from tessera.operators.pairwise import nearest, pairwise


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(0, 4, 3).astype(float).tolist()) for i in range(40)]
    schema = "key long, v array<double>"
    return rows, spark.createDataFrame(rows[::2], schema), spark.createDataFrame(rows, schema)


def _distance(x, y):
    return float(np.sqrt(np.sum((np.array(x) - np.array(y)) ** 2)))


def test_a_larger_second_table_is_met_in_blocks(tables):
    rows, left, right = tables
    for most in (1, 7, 100):
        got = sorted((r["a"], r["b"], round(r["euclidean"], 9)) for r in pairwise(left, right, "key", "v", most_rows=most).collect())
        assert got == sorted((a, b, round(_distance(x, y), 9)) for a, x in rows[::2] for b, y in rows)


def test_nearest_of_a_larger_second_table(tables):
    rows, left, right = tables
    for most in (7, 100):
        for others in (False, True):
            got = sorted((r["a"], r["rank"], r["b"], round(r["distance"], 9)) for r in nearest(left, right, "key", "v", 3, others_only=others, most_rows=most).collect())
            want = []
            for a, x in rows[::2]:
                best = sorted((_distance(x, y), b) for b, y in rows if not others or a != b)[:3]
                want += [(a, rank, b, round(d, 9)) for rank, (d, b) in enumerate(best)]
            assert got == sorted(want)
