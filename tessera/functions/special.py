"""Special functions of single numbers, for p-values of fitted statistics."""

from __future__ import annotations

import math


def _fraction(terms, tiny: float = 1e-300, most: int = 500) -> float:
    """A continued fraction by Lentz's method; terms gives (a, b) from the first."""
    _, b = terms(0)
    f = c = b or tiny
    d = 0.0
    for i in range(1, most):
        a, b = terms(i)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        step = c * d
        f *= step
        if abs(step - 1) < 1e-15:
            break
    return f


def beta_regularised(a: float, b: float, x: float) -> float:
    """Share of the beta distribution (a, b) below x."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a

    def terms(i: int) -> tuple[float, float]:
        if i < 1:
            return 0.0, 1.0
        k = i // 2
        return (k * (b - k) * x / ((a + i - 1) * (a + i)) if i % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + i - 1) * (a + i))), 1.0

    return front / _fraction(terms)


def gamma_upper(a: float, x: float) -> float:
    """Share of the gamma distribution (a) above x."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    return front / _fraction(lambda i: (0.0, x + 1 - a) if not i else (-i * (i - a), x + 2 * i + 1 - a))
