"""The power of most likelihood takes few passes, and is that of a finer search."""

import numpy as np

from tessera.operators.quantile import PowerTransformer


def _likelihood(x, p):
    u, t = np.log1p(np.abs(x)), np.where(x >= 0, p, 2 - p)
    y = np.sign(x) * np.where(np.abs(t) < 1e-12, u, np.expm1(t * u) / np.where(np.abs(t) < 1e-12, 1, t))
    return -len(x) / 2 * np.log(y.var()) + (p - 1) * np.sum(np.sign(x) * u)


def test_powers_of_few_passes(spark):
    r = np.random.default_rng(5)
    x = {"a": r.lognormal(0, 1, 3000), "b": r.normal(0, 2, 3000), "c": -r.lognormal(1, 0.5, 3000), "d": r.normal(50, 4, 3000)}
    df = spark.createDataFrame([(*map(float, v), None) for v in zip(*x.values(), strict=True)], "a double, b double, c double, d double, e double").cache()
    op, passes = PowerTransformer(list(x)), []
    whole = op._likelihoods
    op._likelihoods = lambda *args: passes.append(1) or whole(*args)
    op.fit(df)
    assert len(passes) <= 5
    for c, v in x.items():
        low, high = -3.0, 5.0
        while high - low > 1e-6:  # golden section
            a, b = high - (high - low) * 0.618033988749895, low + (high - low) * 0.618033988749895
            low, high = (low, b) if _likelihood(v, a) > _likelihood(v, b) else (a, high)
        assert abs(op.powers[c] - (low + high) / 2) < 1e-5
