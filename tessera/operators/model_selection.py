"""Scores of estimators on held-out rows, searches over settings, and estimators made of others.

An estimator writes its prediction to `output` and knows its `target`. Folds are a column, so a fold's training and
test rows are filters of one table.
"""

from __future__ import annotations

import copy
import itertools
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators import metrics
from tessera.operators.base import Estimator, Model, value
from tessera.operators.trees import _labels


@dataclass(frozen=True)
class Scorer:
    """A score of predictions, higher is better: `measure` takes (rows, target column, prediction column)."""

    measure: Callable[[DataFrame, str, str], float]
    sign: float = 1.0

    def __call__(self, model: Model, df: DataFrame, target: str, output: str) -> float:
        return self.sign * self.measure(model.transform(df), target, output)


def make_scorer(measure: Callable[[DataFrame, str, str], DataFrame | float], greater_is_better: bool = True) -> Scorer:
    def one(df: DataFrame, y: str, p: str) -> float:
        found = measure(df, y, p)
        found = found.first()[0] if isinstance(found, DataFrame) else found
        return float("nan") if found is None else float(found)

    return Scorer(one, 1.0 if greater_is_better else -1.0)


def _regression(name: str) -> Callable:
    return lambda df, y, p: metrics.regression_metric(df, name, y, p)


def _average(score: str, average: str) -> Callable:
    return lambda df, y, p: metrics.averaged_score(df, y, p, score, average)


SCORERS: dict[str, Scorer] = {
    "accuracy": make_scorer(metrics.accuracy_score),
    "balanced_accuracy": make_scorer(metrics.balanced_accuracy_score),
    "r2": make_scorer(_regression("r2_score")),
    "neg_mean_squared_error": make_scorer(_regression("mean_squared_error"), False),
    "neg_mean_absolute_error": make_scorer(_regression("mean_absolute_error"), False),
    "neg_median_absolute_error": make_scorer(_regression("median_absolute_error"), False),
    "explained_variance": make_scorer(_regression("explained_variance_score"), True),
    "neg_max_error": make_scorer(_regression("max_error"), False),
    "matthews_corrcoef": make_scorer(metrics.matthews_corrcoef),
    **{f"{s}_{a}": make_scorer(_average(s, a)) for s in ("precision", "recall", "f1") for a in ("macro", "micro", "weighted")},
    "roc_auc": make_scorer(metrics.roc_auc_score),
    "average_precision": make_scorer(metrics.average_precision_score),
    "neg_log_loss": make_scorer(metrics.log_loss, False),
    "neg_brier_score": make_scorer(metrics.brier_score_loss, False),
}


def get_scorer_names() -> list[str]:
    return sorted(SCORERS)


def get_scorer(scoring: str | Scorer) -> Scorer:
    if isinstance(scoring, Scorer):
        return scoring
    if scoring not in SCORERS:
        raise InvalidParameter(f"unknown score {scoring}")
    return SCORERS[scoring]


def check_scoring(estimator: Estimator, scoring: str | Scorer | None = None) -> Scorer:
    """The scorer asked for; else accuracy of what gives classes, r2 of other estimators."""
    if scoring is not None:
        return get_scorer(scoring)
    return SCORERS["accuracy" if "Classif" in type(estimator).__name__ or type(estimator).__name__.endswith(("NB", "SVC", "Analysis")) else "r2"]


def _folds(df: DataFrame, fold: str) -> list:
    return sorted(r[0] for r in df.select(fold).where(F.col(fold) >= 0).distinct().collect())


def cross_validate(estimator: Estimator, df: DataFrame, fold: str = "fold", scoring: str | Scorer | None = None, train_scores: bool = False) -> list[dict]:
    """A dict for each fold: test_score, and train_score if asked for. Rows of fold -1 always train."""
    scorer, out = check_scoring(estimator, scoring), []
    for k in _folds(df, fold):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        model = copy.deepcopy(estimator).fit(train)
        row = {"fold": k, "test_score": scorer(model, test, estimator.target, estimator.output)}
        if train_scores:
            row["train_score"] = scorer(model, train, estimator.target, estimator.output)
        out.append(row)
    return out


def cross_val_score(estimator: Estimator, df: DataFrame, fold: str = "fold", scoring: str | Scorer | None = None) -> list[float]:
    return [r["test_score"] for r in cross_validate(estimator, df, fold, scoring)]


def cross_val_predict(estimator: Estimator, df: DataFrame, fold: str = "fold") -> DataFrame:
    """Each row with the prediction of the model that was fitted on the other folds."""
    out = None
    for k in _folds(df, fold):
        part = copy.deepcopy(estimator).fit(df.where(F.col(fold) != k)).transform(df.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_test_score(estimator: Estimator, df: DataFrame, key: Sequence[str], fold: str = "fold", scoring: str | Scorer | None = None, n_permutations: int = 20, seed: int = 0) -> tuple[float, list[float], float]:
    """(score, scores with the target dealt anew among the rows, share of those at least as good)."""
    from tessera.operators.ranks import numbered

    score = float(np.mean(cross_val_score(estimator, df, fold, scoring)))
    rows, found = numbered(df, key, "__row"), []
    for i in range(n_permutations):
        mixed = df.withColumn("__o", F.xxhash64(F.lit(seed * 100_003 + i), *key))
        labels = numbered(mixed.select("__o", *key, F.col(estimator.target).alias("__y")), ["__o", *key], "__row").select("__row", "__y")
        dealt = rows.join(labels, "__row").withColumn(estimator.target, F.col("__y")).drop("__row", "__y")
        found.append(float(np.mean(cross_val_score(estimator, dealt, fold, scoring))))
    return score, found, (1 + sum(s >= score for s in found)) / (1 + n_permutations)


def learning_curve(estimator: Estimator, df: DataFrame, key: Sequence[str], fold: str = "fold", shares: Sequence[float] = (0.1, 0.33, 0.55, 0.78, 1.0), scoring: str | Scorer | None = None, seed: int = 0) -> list[dict]:
    """Scores of models that were fitted on a share of the training rows, by a hash of their key."""
    scorer, out = check_scoring(estimator, scoring), []
    place = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000))
    for share, k in itertools.product(shares, _folds(df, fold)):
        train = df.where(F.col(fold) != k).where(place < int(share * 1_000_000))
        model = copy.deepcopy(estimator).fit(train)
        out.append({"share": share, "fold": k, "train_score": scorer(model, train, estimator.target, estimator.output), "test_score": scorer(model, df.where(F.col(fold) == k), estimator.target, estimator.output)})
    return out


def validation_curve(make: Callable[..., Estimator], df: DataFrame, name: str, values: Sequence, fold: str = "fold", scoring: str | Scorer | None = None) -> list[dict]:
    """Train and test scores for each value of one setting."""
    return [{name: v, **row} for v in values for row in cross_validate(make(**{name: v}), df, fold, scoring, True)]


# --- settings ---


class ParameterGrid:
    """All combinations of lists of values, names in order, the last one changing first."""

    def __init__(self, grid: dict[str, Sequence] | Sequence[dict[str, Sequence]]):
        self.grids = [grid] if isinstance(grid, dict) else list(grid)

    def __iter__(self) -> Iterator[dict]:
        for grid in self.grids:
            names = sorted(grid)
            yield from (dict(zip(names, v, strict=True)) for v in itertools.product(*[grid[n] for n in names]))

    def __len__(self) -> int:
        return sum(math.prod(len(v) for v in g.values()) for g in self.grids)


class Distribution:
    """Values to be drawn."""

    def sample(self, r: random.Random):
        raise NotImplementedError


@dataclass(frozen=True)
class Uniform(Distribution):
    low: float
    high: float

    def sample(self, r):
        return r.uniform(self.low, self.high)


@dataclass(frozen=True)
class LogUniform(Distribution):
    low: float
    high: float

    def sample(self, r):
        return math.exp(r.uniform(math.log(self.low), math.log(self.high)))


@dataclass(frozen=True)
class IntUniform(Distribution):
    low: int
    high: int

    def sample(self, r):
        return r.randint(self.low, self.high)


@dataclass(frozen=True)
class Choice(Distribution):
    values: tuple

    def sample(self, r):
        return r.choice(self.values)


class ParameterSampler:
    """n_iter settings drawn from distributions or lists."""

    def __init__(self, distributions: dict[str, Distribution | Sequence], n_iter: int, seed: int = 0):
        self.distributions, self.n_iter, self.seed = distributions, n_iter, seed

    def __iter__(self) -> Iterator[dict]:
        r = random.Random(self.seed)
        for _ in range(self.n_iter):
            yield {n: d.sample(r) if isinstance(d, Distribution) else r.choice(list(d)) for n, d in sorted(self.distributions.items())}

    def __len__(self) -> int:
        return self.n_iter


class GridSearchCV(Estimator):
    """The setting of the best mean score over the folds (the first on ties), refitted on all rows. make(**setting) gives the estimator."""

    def __init__(self, make: Callable[..., Estimator], grid, fold: str = "fold", scoring: str | Scorer | None = None):
        self.make, self.grid, self.fold, self.scoring = make, grid, fold, scoring

    def candidates(self) -> list[dict]:
        return list(ParameterGrid(self.grid))

    def fit(self, df: DataFrame) -> Model:
        self.results = [{"params": p, "mean_test_score": float(np.mean(cross_val_score(self.make(**p), df, self.fold, self.scoring)))} for p in self.candidates()]
        self.best_params = self.results[int(np.nanargmax([r["mean_test_score"] for r in self.results]))]["params"]
        return self.make(**self.best_params).fit(df)


class RandomizedSearchCV(GridSearchCV):
    """GridSearchCV over n_iter drawn settings."""

    def __init__(self, make, distributions: dict, n_iter: int = 10, seed: int = 0, **options):
        super().__init__(make, None, **options)
        self.sampler = ParameterSampler(distributions, n_iter, seed)

    def candidates(self):
        return list(self.sampler)


class HalvingGridSearchCV(GridSearchCV):
    """Rounds on growing shares of the rows (a hash of `key`); the best 1 / factor of the settings go on."""

    def __init__(self, make, grid, key: Sequence[str], factor: int = 3, seed: int = 0, **options):
        super().__init__(make, grid, **options)
        self.key, self.factor, self.seed = list(key), factor, seed

    def fit(self, df):
        left = self.candidates()
        rounds = max(1, math.ceil(math.log(max(len(left), 1), self.factor)))
        place = F.pmod(F.xxhash64(F.lit(self.seed), *self.key), F.lit(1_000_000))
        self.results = []
        for k in range(rounds):
            rows = df.where(place < int(1_000_000 * self.factor ** (k - rounds + 1)))
            scores = [float(np.mean(cross_val_score(self.make(**p), rows, self.fold, self.scoring))) for p in left]
            self.results += [{"params": p, "round": k, "mean_test_score": s} for p, s in zip(left, scores, strict=True)]
            order = np.argsort(-np.array(scores), kind="stable")
            left = [left[i] for i in order[: max(1, math.ceil(len(left) / self.factor))]]
        self.best_params = left[0]
        return self.make(**self.best_params).fit(df)


class HalvingRandomSearchCV(HalvingGridSearchCV):
    def __init__(self, make, distributions: dict, key: Sequence[str], n_iter: int = 9, seed: int = 0, **options):
        super().__init__(make, None, key, seed=seed, **options)
        self.sampler = ParameterSampler(distributions, n_iter, seed)

    def candidates(self):
        return list(self.sampler)


# --- estimators made of others ---


class _Renamed(Model):
    """Models whose outputs a combination turns into one column."""

    def __init__(self, models: Sequence[Model], output: str, combine: Callable[[list[Column]], Column], inner: str):
        self.models, self.output, self.combine, self.inner = list(models), output, combine, inner

    def transform(self, df: DataFrame) -> DataFrame:
        columns, names = df.columns, []
        for i, model in enumerate(self.models):
            name = f"__m{i}"
            df = model.transform(df).withColumnRenamed(self.inner, name).select(*columns, *names, name)
            names.append(name)
        return df.withColumn(self.output, self.combine([F.col(n) for n in names])).drop(*names)


class OneVsRestClassifier(Estimator):
    """A model of each class against the rest; the class of the greatest output. make(target, output) gives an estimator of
    a number (a probability or margin) for labels 0 and 1."""

    def __init__(self, make: Callable[[str, str], Estimator], target: str, output: str = "prediction"):
        self.make, self.target, self.output = make, target, output

    def fit(self, df: DataFrame) -> Model:
        classes = _labels(df, self.target)
        models = [self.make("__y", "__score").fit(df.withColumn("__y", (F.col(self.target) == F.lit(c)).cast("double"))) for c in classes]

        def best(scores: list[Column]) -> Column:
            return F.element_at(F.lit(classes), F.array_position(F.array(*scores), F.array_max(F.array(*scores))).cast("int"))

        return _Renamed(models, self.output, best, "__score")


class OneVsOneClassifier(OneVsRestClassifier):
    """A model of each pair of classes; the class of most votes, then of the greatest sum of outputs (from 0 to 1)."""

    def fit(self, df):
        classes = _labels(df, self.target)
        pairs = list(itertools.combinations(range(len(classes)), 2))
        models = [self.make("__y", "__score").fit(df.where(F.col(self.target).isin(classes[i], classes[j])).withColumn("__y", (F.col(self.target) == F.lit(classes[j])).cast("double"))) for i, j in pairs]

        def best(scores: list[Column]) -> Column:
            totals = []
            for c in range(len(classes)):
                own = F.lit(0.0)
                for (i, j), s in zip(pairs, scores, strict=True):
                    if c in (i, j):
                        sure = s if c == j else 1 - s
                        own = own + F.when(sure > 0.5, 1.0).otherwise(0.0) + sure * 1e-6
                totals.append(own)
            return F.element_at(F.lit(classes), F.array_position(F.array(*totals), F.array_max(F.array(*totals))).cast("int"))

        return _Renamed(models, self.output, best, "__score")


class OutputCodeClassifier(OneVsRestClassifier):
    """Each class has a code of 0 and 1, drawn by the seed; a model for each place, the class of the nearest code."""

    def __init__(self, make, target, output="prediction", code_size: float = 1.5, seed: int = 0):
        super().__init__(make, target, output)
        self.code_size, self.seed = code_size, seed

    def fit(self, df):
        classes = _labels(df, self.target)
        rng = np.random.default_rng(self.seed)
        places = max(1, int(len(classes) * self.code_size))
        code = rng.integers(0, 2, (len(classes), places))
        for _ in range(1000):
            if len({tuple(r) for r in code}) == len(classes) and (code.min(axis=0) < code.max(axis=0)).all():
                break
            code = rng.integers(0, 2, (len(classes), places))
        models = []
        for j in range(places):
            ones = [c for c, bit in zip(classes, code[:, j], strict=True) if bit]
            models.append(self.make("__y", "__score").fit(df.where(F.col(self.target).isNotNull()).withColumn("__y", F.col(self.target).isin(ones).cast("double"))))

        def best(scores: list[Column]) -> Column:
            far = [sum(((s - float(bit)) ** 2 for s, bit in zip(scores, row, strict=True)), F.lit(0.0)) for row in code]
            return F.element_at(F.lit(classes), F.array_position(F.array(*far), F.array_min(F.array(*far))).cast("int"))

        return _Renamed(models, self.output, best, "__score")


class MultiOutputRegressor(Estimator):
    """An estimator for each target; make(target, output) gives it."""

    def __init__(self, make: Callable[[str, str], Estimator], targets: Sequence[str]):
        self.make, self.targets = make, list(targets)

    def fit(self, df: DataFrame) -> Model:
        return _Chained([self.make(t, f"{t}_prediction").fit(df) for t in self.targets])


class MultiOutputClassifier(MultiOutputRegressor):
    pass


class RegressorChain(Estimator):
    """An estimator for each target in turn, with the targets before it among its columns: true ones when it is fitted,
    predicted ones when it is applied. make(columns, target, output) gives it."""

    def __init__(self, make: Callable[[list[str], str, str], Estimator], columns: Sequence[str], targets: Sequence[str]):
        self.make, self.columns, self.targets = make, list(columns), list(targets)

    def fit(self, df: DataFrame) -> Model:
        models, known = [], df
        for i, t in enumerate(self.targets):
            before = [f"{u}_prediction" for u in self.targets[:i]]
            models.append(self.make([*self.columns, *before], t, f"{t}_prediction").fit(known))
            known = known.withColumn(f"{t}_prediction", F.col(t))
        return _Chained(models)


class ClassifierChain(RegressorChain):
    pass


class _Chained(Model):
    def __init__(self, models: Sequence[Model]):
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        for m in self.models:
            df = m.transform(df)
        return df


class TransformedTargetRegressor(Estimator):
    """An estimator on a function of the target; its predictions go back through the inverse. make(target, output) gives it."""

    def __init__(self, make: Callable[[str, str], Estimator], target: str, forward: Callable[[Column], Column], inverse: Callable[[Column], Column], output: str = "prediction"):
        self.make, self.target, self.forward, self.inverse, self.output = make, target, forward, inverse, output

    def fit(self, df: DataFrame) -> Model:
        inner = self.make("__y", "__out").fit(df.withColumn("__y", self.forward(value(self.target))))
        return _Renamed([inner], self.output, lambda c: self.inverse(c[0]), "__out")


class FixedThresholdClassifier(Estimator):
    """Label 1 where a probability is at least the threshold. make(target, output) gives the probability."""

    def __init__(self, make: Callable[[str, str], Estimator], target: str, threshold: float = 0.5, output: str = "prediction"):
        self.make, self.target, self.threshold, self.output = make, target, threshold, output

    def fit(self, df: DataFrame) -> Model:
        at = self.threshold
        return _Renamed([self.make(self.target, "__p").fit(df)], self.output, lambda c: (c[0] >= at).cast("int"), "__p")


class TunedThresholdClassifierCV(FixedThresholdClassifier):
    """The threshold of `thresholds` that gives the best score of held-out rows."""

    def __init__(self, make, target, fold: str = "fold", scoring: str | Scorer = "balanced_accuracy", thresholds: int = 50, output: str = "prediction"):
        super().__init__(make, target, 0.5, output)
        self.fold, self.scoring, self.thresholds = fold, scoring, thresholds

    def fit(self, df):
        held = cross_val_predict(_Named(self.make(self.target, "__p"), self.target, "__p"), df, self.fold).select(self.target, "__p")
        low, high = held.agg(F.min("__p"), F.max("__p")).first()
        scorer, best = get_scorer(self.scoring), None
        for t in np.linspace(low, high, self.thresholds).tolist():
            s = scorer.sign * scorer.measure(held.withColumn(self.output, (F.col("__p") >= t).cast("int")), self.target, self.output)
            if best is None or s > best[0]:
                best = (s, t)
        self.best_score, self.threshold = best
        return super().fit(df)


class _Named(Estimator):
    def __init__(self, inner: Estimator, target: str, output: str):
        self.inner, self.target, self.output = inner, target, output

    def fit(self, df):
        return self.inner.fit(df)


class CalibratedClassifierCV(Estimator):
    """Probabilities of held-out scores: each fold's model with a logistic (sigmoid) or isotonic map fitted on that fold; the mean over folds."""

    def __init__(self, make: Callable[[str, str], Estimator], target: str, fold: str = "fold", method: str = "sigmoid", output: str = "probability"):
        if method not in ("sigmoid", "isotonic"):
            raise InvalidParameter("method sigmoid or isotonic")
        self.make, self.target, self.fold, self.method, self.output = make, target, fold, method, output

    def fit(self, df: DataFrame) -> Model:
        from tessera.operators.linear import LogisticRegression
        from tessera.operators.regression import IsotonicRegression

        models = []
        for k in _folds(df, self.fold):
            inner = self.make(self.target, "__s").fit(df.where(F.col(self.fold) != k))
            held = inner.transform(df.where(F.col(self.fold) == k))
            map_ = LogisticRegression(["__s"], self.target, "__p", C=1e12) if self.method == "sigmoid" else IsotonicRegression("__s", self.target, "__p")
            models.append(_Chained([inner, map_.fit(held)]))
        return _Renamed(models, self.output, lambda c: sum(c[1:], c[0]) / len(c), "__p")


class SelfTrainingClassifier(Estimator):
    """Rows without a label get the model's where it is sure; the model is fitted again, up to `rounds` times.

    make(target) gives an estimator that writes prediction and prediction_probability.
    """

    def __init__(self, make: Callable[[str], Estimator], target: str, threshold: float = 0.75, rounds: int = 10):
        self.make, self.target, self.threshold, self.rounds = make, target, threshold, rounds

    def fit(self, df: DataFrame) -> Model:
        given = df.withColumn("__y", F.col(self.target))
        model = self.make("__y").fit(given.where("__y is not null"))
        before = -1
        for _ in range(self.rounds):
            told = model.transform(df)
            told = told.withColumn("__y", F.coalesce(F.col(self.target), F.when(F.array_max("prediction_probability") >= self.threshold, F.col("prediction"))))
            told = told.select(*df.columns, "__y").where("__y is not null")
            now = told.count()
            if now == before:
                break
            before, model = now, self.make("__y").fit(told)
        return model


def make_pipeline(*steps):
    from tessera.operators.base import Pipeline

    return Pipeline(*steps)


class FeatureUnion(Estimator):
    """Transformers that are each fitted on the same rows; all add their columns."""

    def __init__(self, *steps):
        self.steps = steps

    def fit(self, df: DataFrame) -> Model:
        return _Chained([s.fit(df) if isinstance(s, Estimator) else s for s in self.steps])


def make_union(*steps) -> FeatureUnion:
    return FeatureUnion(*steps)


def permutation_importance(model: Model, df: DataFrame, columns: Sequence[str], key: Sequence[str], target: str, output: str, scoring: str | Scorer, n_repeats: int = 5, seed: int = 0) -> dict[str, list[float]]:
    """For each column how much the score falls when its values are dealt anew among the rows."""
    from tessera.operators.ranks import numbered

    scorer = get_scorer(scoring)
    base = scorer(model, df, target, output)
    rows, out = numbered(df, key, "__row"), {}
    for c in columns:
        out[c] = []
        for r in range(n_repeats):
            mixed = numbered(df.select(F.xxhash64(F.lit(seed * 1009 + r), *key).alias("__o"), *key, F.col(c).alias("__v")), ["__o", *key], "__row").select("__row", "__v")
            dealt = rows.join(mixed, "__row").withColumn(c, F.col("__v")).drop("__row", "__v")
            out[c].append(base - scorer(model, dealt, target, output))
    return out


def partial_dependence(model: Model, df: DataFrame, column: str, grid: Sequence[float], output: str) -> DataFrame:
    """The mean prediction with the column set to each value of the grid: one pass."""
    points = df.drop(column).withColumn(column, F.explode(F.lit([float(g) for g in grid])))
    return model.transform(points).groupBy(F.col(column).alias("value")).agg(F.avg(output).alias("average"))


# --- what a display would draw ---


def learning_curve_display(rows: list[dict]) -> dict[str, tuple[list, list]]:
    """Mean train and test scores by share."""
    shares = sorted({r["share"] for r in rows})
    return {s: (shares, [float(np.mean([r[f"{s}_score"] for r in rows if r["share"] == x])) for x in shares]) for s in ("train", "test")}


def validation_curve_display(rows: list[dict], name: str) -> dict[str, tuple[list, list]]:
    values = list(dict.fromkeys(r[name] for r in rows))
    return {s: (values, [float(np.mean([r[f"{s}_score"] for r in rows if r[name] == x])) for x in values]) for s in ("train", "test")}


def decision_boundary(model: Model, spark, x: str, y: str, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """The model's output on a grid of two columns."""
    return model.transform(spark.createDataFrame([(float(a), float(b)) for a in xs for b in ys], f"`{x}` double, `{y}` double"))
