"""Counts of terms deal each text once, whatever its key."""

import math
from collections import Counter

from tessera.operators.text import CountVectorizer, TfidfVectorizer


def test_terms_are_counted_and_scaled_by_key(spark):
    rows = [(1, "one two two"), (1, "two three"), (2, "two"), (None, "one two"), (None, "one"), (3, None), (4, ""), (5, "three one")]
    df = spark.createDataFrame(rows, "k long, t string")
    counts = {}
    for k, t in rows:
        counts.setdefault(k, Counter()).update((t or "").split())
    model = CountVectorizer("k", "t", min_df=2).fit(df)
    want = Counter(t for c in counts.values() for t in c)
    assert {r["term"]: r["df"] for r in model.vocabulary.collect()} == want
    assert sorted((str(r["k"]), r["term"], r["n"]) for r in model.transform(df).collect()) == sorted((str(k), t, n) for k, c in counts.items() for t, n in c.items())
    for norm, size in (("l2", lambda v: math.sqrt(sum(x * x for x in v))), ("l1", sum), (None, lambda v: 1.0)):
        got = {(r["k"], r["term"]): r["weight"] for r in TfidfVectorizer("k", "t", norm=norm).fit(df).transform(df).collect() if r["k"] is not None}
        for k, c in counts.items():
            w = {t: n * (math.log((1 + len(rows)) / (1 + want[t])) + 1) for t, n in c.items()}
            assert all(math.isclose(got[k, t], x / size(list(w.values()))) for t, x in w.items() if k is not None)


def test_terms_are_not_dealt(spark):
    df = spark.createDataFrame([(i, f"one two{i % 3}") for i in range(30)], "k long, t string")
    for op in (CountVectorizer("k", "t"), TfidfVectorizer("k", "t")):
        out = op.fit(df).transform(df)
        assert out.count() == 60
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "hashpartitioning(term" not in plan and "hashpartitioning(k" in plan and ", term" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
