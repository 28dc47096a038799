"""Neighbours found by products of matrices are those of distances added up one by one."""

import numpy as np
import pytest

from tessera.operators.pairwise import nearest, within


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(9)
    rows = [(i, (1e6 + r.integers(0, 3, 4) / 1000).tolist()) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [1.0, 2.0]), (63, [float("nan"), 0.0, 0.0, 0.0])]
    return rows, spark.createDataFrame(rows[::3], "key int, v array<double>"), spark.createDataFrame(rows, "key int, v array<double>")


def _distance(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    total = 0.0
    for p, q in zip(x, y, strict=True):
        total += (p - q) * (p - q)
    return float(np.sqrt(total))


def _order(d, b):
    return (d is None, d is not None and np.isnan(d), 0 if d is None or np.isnan(d) else d, b)


def test_ties_nulls_and_far_off_vectors(tables):
    rows, left, right = tables
    for others in (False, True):
        for most in (9, 1000):
            got = sorted((r["a"], r["rank"], r["b"], str(r["distance"])) for r in nearest(left, right, "key", "v", 5, others_only=others, most_rows=most).collect())
            want = []
            for a, x in rows[::3]:
                best = sorted(((_distance(x, y), b) for b, y in rows if not others or a != b), key=lambda p: _order(*p))[:5]
                want += [(a, i, b, str(d)) for i, (d, b) in enumerate(best)]
            assert got == sorted(want)


def test_pairs_within_a_radius(tables):
    rows, left, right = tables
    radius = _distance([1e6, 1e6], [1e6 + 0.002, 1e6 + 0.001])
    got = {(r["a"], r["b"]) for r in within(left, right, "key", "v", radius, most_rows=7).collect()}
    assert got == {(a, b) for a, x in rows[::3] for b, y in rows if (d := _distance(x, y)) is not None and d <= radius}
    assert within(left.limit(0), right, "key", "v", 1.0).count() == 0
    assert nearest(left, right.limit(0), "key", "v", 2).count() == 0
