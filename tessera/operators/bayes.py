"""Naive Bayes: class sums in one job, a score for each class as an expression. Partial fits merge the sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.base import Estimator, Model, need, value


class ClassScores(Model):
    """The class of the highest score (the first on ties) and, with probabilities, an array of them."""

    def __init__(self, classes: Sequence, scores: Sequence[Column], output: str):
        self.classes, self.scores, self.output = list(classes), list(scores), output

    def transform(self, df: DataFrame) -> DataFrame:
        best = F.greatest(*self.scores) if len(self.scores) > 1 else self.scores[0]
        label = F.lit(None)
        for c, s in reversed(list(zip(self.classes, self.scores, strict=True))):
            label = F.when(s == best, F.lit(c)).otherwise(label)
        shares = [F.exp(s - best) for s in self.scores]
        total = sum(shares[1:], shares[0])
        return df.withColumns({self.output: label, f"{self.output}_probability": F.array(*[s / total for s in shares])})


class _NaiveBayes(Estimator):
    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", alpha: float = 1.0):
        self.columns, self.target, self.output, self.alpha = list(columns), target, output, alpha
        self.sums: dict = {}

    def partial_fit(self, df: DataFrame) -> Model:
        """Adds the rows of df to what was seen before."""
        need(df, [*self.columns, self.target])
        rows = df.groupBy(self.target).agg(F.count("*").alias("n"), *[x for i, c in enumerate(self.columns) for x in (F.sum(value(c)).alias(f"s{i}"), F.sum(value(c) ** 2).alias(f"q{i}"), F.sum((value(c) > 0).cast("double")).alias(f"b{i}"))]).collect()
        d = range(len(self.columns))
        for r in rows:
            new = [float(r["n"])] + [float(r[f"{k}{i}"] or 0.0) for k in "sqb" for i in d]
            old = self.sums.get(r[0], [0.0] * len(new))
            self.sums[r[0]] = [a + b for a, b in zip(old, new, strict=True)]
        return self.model()

    def fit(self, df: DataFrame) -> Model:
        self.sums = {}
        return self.partial_fit(df)

    def parts(self):
        d = len(self.columns)
        for label in sorted(self.sums):
            v = self.sums[label]
            yield label, v[0], v[1 : d + 1], v[d + 1 : 2 * d + 1], v[2 * d + 1 :]


class GaussianNB(_NaiveBayes):
    """Normal features of population variance plus 1e-9 of the largest variance."""

    def model(self) -> ClassScores:
        parts = list(self.parts())
        n = sum(p[1] for p in parts)
        d = len(self.columns)
        whole = [sum(p[3][i] for p in parts) / n - (sum(p[2][i] for p in parts) / n) ** 2 for i in range(d)]
        floor = 1e-9 * max(whole)
        scores = []
        for _, k, s, q, _b in parts:
            score = F.lit(math.log(k / n))
            for i, c in enumerate(self.columns):
                mean = s[i] / k
                var = max(q[i] / k - mean * mean, 0.0) + floor
                score = score - F.lit(0.5 * math.log(2 * math.pi * var)) - (value(c) - F.lit(mean)) ** 2 / F.lit(2 * var)
            scores.append(score)
        return ClassScores([p[0] for p in parts], scores, self.output)


class MultinomialNB(_NaiveBayes):
    """Counts with additive smoothing alpha."""

    def model(self) -> ClassScores:
        parts = list(self.parts())
        n, d = sum(p[1] for p in parts), len(self.columns)
        scores = []
        for _, k, s, _q, _b in parts:
            score = F.lit(math.log(k / n))
            for i, c in enumerate(self.columns):
                score = score + value(c) * F.lit(math.log((s[i] + self.alpha) / (sum(s) + self.alpha * d)))
            scores.append(score)
        return ClassScores([p[0] for p in parts], scores, self.output)


class ComplementNB(_NaiveBayes):
    """Weights from the counts of all other classes; the class prior has no part."""

    def model(self) -> ClassScores:
        parts = list(self.parts())
        d = len(self.columns)
        total = [sum(p[2][i] for p in parts) for i in range(d)]
        scores = []
        for _, _k, s, _q, _b in parts:
            rest = [total[i] - s[i] for i in range(d)]
            score = F.lit(0.0)
            for i, c in enumerate(self.columns):
                score = score - value(c) * F.lit(math.log((rest[i] + self.alpha) / (sum(rest) + self.alpha * d)))
            scores.append(score)
        return ClassScores([p[0] for p in parts], scores, self.output)


class BernoulliNB(_NaiveBayes):
    """Features above 0 or not."""

    def model(self) -> ClassScores:
        parts = list(self.parts())
        n = sum(p[1] for p in parts)
        scores = []
        for _, k, _s, _q, b in parts:
            score = F.lit(math.log(k / n))
            for i, c in enumerate(self.columns):
                share = (b[i] + self.alpha) / (k + 2 * self.alpha)
                score = score + F.when(value(c) > 0, F.lit(math.log(share))).otherwise(F.lit(math.log(1 - share)))
            scores.append(score)
        return ClassScores([p[0] for p in parts], scores, self.output)


class NearestCentroid(_NaiveBayes):
    """The class whose mean is nearest."""

    def model(self) -> ClassScores:
        parts = list(self.parts())
        scores = []
        for _, k, s, _q, _b in parts:
            scores.append(-sum(((value(c) - F.lit(s[i] / k)) ** 2 for i, c in enumerate(self.columns)), F.lit(0.0)))
        return ClassScores([p[0] for p in parts], scores, self.output)
