"""Plans whose tasks stay small however many rows there are."""

import math

import numpy as np

from tessera.operators import metrics, splits


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_group_do_not_meet_in_one_task(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as string) AS g")
    for out in (splits.group_k_fold(df, "g", 3), splits.leave_one_group_out(df, "g"), splits.group_shuffle_split(df, "g", 2, 0.4), splits.predefined_split(df.selectExpr("id", "id % 4 - 1 AS f"), "f")):
        assert "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" in _plan(out)
        assert out.count() in (1000, 2000)


def test_partitions_of_rankings_grow_with_the_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(int(q), float(g), float(s)) for q, g, s in zip(r.integers(0, 40, 600), r.integers(0, 5, 600), r.integers(0, 6, 600), strict=True)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "q int, g double, s double")
    monkeypatch.setattr(metrics, "RANKED", 20, raising=False)
    for k in (None, 3):
        want = []
        for q in {q for q, _, _ in rows if q is not None}:
            own = sorted(((s, g) for p, g, s in rows if p == q), reverse=True)
            d = [1 / math.log2(i + 2) if k is None or i < k else 0.0 for i in range(len(own))]
            same = lambda s: [g for t, g in own if t == s]  # noqa: B023, E731
            dcg = sum(x * np.mean(same(s)) for x, (s, _) in zip(d, own, strict=True))
            ideal = sum(x * g for x, g in zip(d, sorted((g for _, g in own), reverse=True), strict=True))
            want.append(dcg / ideal if ideal else 0.0)
        out = metrics.dcg_score(df, "q", "g", "s", k, normalise=True)
        assert math.isclose(out.first()[0], np.mean(want), rel_tol=1e-9)
        plan = _plan(out)
        assert "hashpartitioning(q" in plan and ", 31)" in plan and "Join" not in plan
    assert metrics.dcg_score(df.limit(0), "q", "g", "s").first()[0] is None
