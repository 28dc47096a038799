"""Decision trees and ensembles over histograms.

Columns are cut into at most MAX_BINS bins once (exact midpoints of the distinct values where these are few, else
approximate quantiles). A level of all trees is one pass: each task adds up its rows' statistics by tree, node, column and
bin, a shuffle adds the tasks' sums, and what reaches the driver is bounded by nodes, columns and bins. Trees are
small arrays, so a row's node is found again from its bins in every pass and nothing but the binned table is stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, InvalidParameter
from tessera.operators.base import Estimator, Model, need, value
from tessera.plans.storage import stored

MAX_BINS = 255
#: Distinct labels that a classifier takes at most.
MAX_CLASSES = 1000


def bin_edges(df: DataFrame, columns: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending thresholds of each column; a value's bin is the number of thresholds below it."""
    need(df, columns)
    counted = df.agg(*[F.approx_count_distinct(value(c)) for c in columns], F.count("*")).first()
    if not counted[-1]:
        raise InsufficientSamples("no rows to fit on")
    out = []
    for c, n in zip(columns, counted, strict=False):
        if n <= max_bins * 1.2:
            known = [r[0] for r in df.select(value(c).alias("v")).where("v is not null").distinct().limit(max_bins + 1).collect()]
            if len(known) <= max_bins:
                known = np.sort(np.array(known, float))
                out.append((known[1:] + known[:-1]) / 2)
                continue
        at = [k / max_bins for k in range(1, max_bins)]
        out.append(np.unique(np.array(df.agg(F.percentile_approx(value(c), at, 20 * max_bins)).first()[0], float)))
    return out


@dataclass
class Tree:
    """Nodes in arrays; feature -1 is a leaf, rows go left if their bin is at most `cut`."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    stats: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, left: np.ndarray, right: np.ndarray, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        for side, stats in ((self.left, left), (self.right, right)):
            side[node] = len(self.feature)
            for column, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.stats, stats), (self.gain, 0.0)):
                column.append(v)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            here = at[inner]
            at[inner] = np.where(bins[inner, f[inner]] <= cut[here], left[here], right[here])


def binned(df: DataFrame, columns: Sequence[str], edges: Sequence[np.ndarray], keep: Sequence[Column]) -> DataFrame:
    """Stored rows: id (any number), bins (a byte pair for each column, missing values last) and the columns to keep."""
    rows = df.select(F.array(*[value(c) for c in columns]).alias("x"), *keep)
    names = [c for c in rows.columns if c != "x"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in _bins(batch.column(0), edges)], pa.binary()), *batch.columns[1:]], ["bins", *names])

    kinds = ", ".join(["bins binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x"]])
    return stored(rows.mapInArrow(cut, kinds).withColumn("id", F.monotonically_increasing_id()))


def _bins(column: pa.Array, edges: Sequence[np.ndarray]) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), len(edges))
    out = np.empty(x.shape, np.uint16)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
        out[np.isnan(x[:, j]), j] = len(e) + 1
    return out


def _unit(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the row and the salt alone."""
    x = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(11)).astype(float) / 2**53


@dataclass(frozen=True)
class Growth:
    """How trees grow."""

    max_depth: int = 6
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None
    random_cut: bool = False
    min_gain: float = 1e-12
    seed: int = 0


def grow(rows: DataFrame, edges: Sequence[np.ndarray], count: int, channels: int, statistics: Callable, score: Callable, how: Growth) -> list[Tree]:
    """`count` trees at once. statistics(batch columns, bins, tree) gives the weight and other channels of each row,
    score(channels) what a node is worth; a split's gain is the children's worth less the parent's."""
    d = len(edges)
    sizes = [len(e) + 2 for e in edges]
    width = max(sizes)
    rng = np.random.default_rng(how.seed)
    trees = [Tree() for _ in range(count)]
    frontier = [(t, 0) for t in range(count)]
    for _ in range(how.max_depth):
        if not frontier:
            break
        place = [{n: i for i, (t, n) in enumerate(frontier) if t == k} for k in range(count)]
        held = trees

        def add(batches: Iterator[pa.RecordBatch], place=place, held=held, n=len(frontier)) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n * d * width, channels))
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(batch.num_rows, d)
                columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "bins"}
                for t, tree in enumerate(held):
                    if not place[t]:
                        continue
                    to = np.full(len(tree.feature), -1)
                    to[list(place[t])] = list(place[t].values())
                    at = to[tree.nodes(own)]
                    values = statistics(columns, own, t)
                    use = np.flatnonzero((at >= 0) & (values[:, 0] != 0))
                    for j in range(d):
                        cell = (at[use] * d + j) * width + own[use, j]
                        for c in range(channels):
                            total[:, c] += np.bincount(cell, values[use, c], len(total))
            cells = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(cells), *[pa.array(total[cells, c]) for c in range(channels)]], ["cell", *[f"c{c}" for c in range(channels)]])

        kinds = ", ".join(["cell long", *[f"c{c} double" for c in range(channels)]])
        sums = rows.mapInArrow(add, kinds).groupBy("cell").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(channels)]).toPandas()
        table = np.zeros((len(frontier) * d * width, channels))
        table[sums["cell"].to_numpy()] = sums[[f"c{c}" for c in range(channels)]].to_numpy()
        table = table.reshape(len(frontier), d, width, channels)
        following = []
        for (t, n), sheet in zip(frontier, table, strict=True):
            tree = trees[t]
            whole = sheet[0].sum(axis=0)
            tree.stats[n] = whole
            features = range(d) if how.max_features is None else np.sort(rng.permutation(d)[: how.max_features])
            best = (how.min_gain * max(1.0, abs(float(score(whole[None])[0]))), -1, 0)
            if whole[0] >= how.min_samples_split:
                for j in features:
                    left = np.cumsum(sheet[j], axis=0)[:-1]
                    right = whole - left
                    fits = (left[:, 0] >= how.min_samples_leaf) & (right[:, 0] >= how.min_samples_leaf) & (left[:, 0] > 0) & (right[:, 0] > 0)
                    if how.random_cut and fits.any():
                        chosen = rng.choice(np.flatnonzero(fits))
                        fits[:] = False
                        fits[chosen] = True
                    if fits.any():
                        gain = np.where(fits, score(left) + score(right) - score(whole[None]), -np.inf)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), int(j), k)
            if best[1] >= 0:
                gain, j, k = best
                left = np.cumsum(sheet[j], axis=0)[k]
                following += [(t, m) for m in tree.split(n, j, k, left, whole - left, gain)]
        frontier = following
    return trees


def gini(c: np.ndarray) -> np.ndarray:
    """Channels: rows, then one for each class."""
    return (c[:, 1:] ** 2).sum(axis=1) / np.maximum(c[:, 0], 1e-300)


def entropy(c: np.ndarray) -> np.ndarray:
    k = c[:, 1:]
    return (k * np.log(np.maximum(k, 1e-300))).sum(axis=1) - c[:, 0] * np.log(np.maximum(c[:, 0], 1e-300))


def variance(c: np.ndarray) -> np.ndarray:
    """Channels: weight, weighted target."""
    return c[:, 1] ** 2 / np.maximum(c[:, 0], 1e-300)


class TreeModel(Model):
    """Trees whose leaves' values are combined; `leaf` turns a leaf's statistics into its value, `combine` the trees' values."""

    def __init__(self, columns: Sequence[str], edges: Sequence[np.ndarray], trees: list[Tree], leaf: Callable, combine: Callable, classes: Sequence | None, output: str):
        self.columns, self.edges, self.trees, self.leaf, self.combine, self.classes, self.output = list(columns), list(edges), trees, leaf, combine, classes, output

    def values(self) -> list[np.ndarray]:
        return [np.array([self.leaf(s) for s in t.stats]) for t in self.trees]

    def raw(self) -> Callable:
        edges, trees, values, combine = self.edges, self.trees, self.values(), self.combine

        def of(bins: np.ndarray) -> np.ndarray:
            return combine([v[t.nodes(bins)] for t, v in zip(trees, values, strict=True)])

        def predict(column: pa.Array) -> np.ndarray:
            return of(_bins(column, edges))

        return predict

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the prediction and, for classes, an array of their probabilities."""
        need(df, self.columns)
        predict = self.raw()
        several = self.classes is not None

        @F.pandas_udf("array<double>" if several else "double")
        def run(x: pd.Series) -> pd.Series:
            found = predict(pa.array(x.tolist(), pa.list_(pa.float64())))
            return pd.Series(list(found) if several else found)

        out = run(F.array(*[value(c) for c in self.columns]))
        if not several:
            return df.withColumn(self.output, out)
        chance = f"{self.output}_probability"
        best = F.array_position(F.col(chance), F.array_max(chance)).cast("int")
        return df.withColumn(chance, out).withColumn(self.output, F.element_at(F.lit(list(self.classes)), best))

    def feature_importances(self) -> np.ndarray:
        """Each column's share of the gains, averaged over the trees."""
        out = np.zeros((len(self.trees), len(self.columns)))
        for row, tree in zip(out, self.trees, strict=True):
            np.add.at(row, [f for f in tree.feature if f >= 0], [g for f, g in zip(tree.feature, tree.gain, strict=True) if f >= 0])
            row /= max(row.sum(), 1e-300)
        return out.mean(axis=0)

    def apply(self, df: DataFrame, output: str = "leaf") -> DataFrame:
        """Adds an array of each tree's leaf number."""
        edges, trees = self.edges, self.trees

        @F.pandas_udf("array<int>")
        def run(x: pd.Series) -> pd.Series:
            bins = _bins(pa.array(x.tolist(), pa.list_(pa.float64())), edges)
            return pd.Series(list(np.stack([t.nodes(bins) for t in trees], axis=1).astype(np.int32)))

        return df.withColumn(output, run(F.array(*[value(c) for c in self.columns])))

    def threshold(self, tree: Tree, node: int) -> float:
        e = self.edges[tree.feature[node]]
        return float(e[tree.cut[node]]) if tree.cut[node] < len(e) else float("inf")


def export_text(model: TreeModel, tree: int = 0, digits: int = 2) -> str:
    """A tree as indented rules."""
    t, values = model.trees[tree], model.values()[tree]
    lines: list[str] = []

    def walk(node: int, depth: int) -> None:
        bar = "|   " * depth + "|--- "
        if t.feature[node] < 0:
            v = values[node]
            lines.append(bar + (f"class: {model.classes[int(np.argmax(v))]}" if model.classes is not None else f"value: [{float(v):.{digits}f}]"))
            return
        name, at = model.columns[t.feature[node]], model.threshold(t, node)
        for sign, child in (("<=", t.left[node]), (">", t.right[node])):
            lines.append(f"{bar}{name} {sign:<2} {at:.{digits}f}")
            walk(child, depth + 1)

    walk(0, 0)
    return "\n".join(lines) + "\n"


def export_graphviz(model: TreeModel, tree: int = 0) -> str:
    """A tree in the DOT language."""
    t, values = model.trees[tree], model.values()[tree]
    lines = ["digraph Tree {", 'node [shape=box, fontname="helvetica"] ;']
    for n, f in enumerate(t.feature):
        label = f"value = {np.round(values[n], 3)}" if f < 0 else f"{model.columns[f]} <= {model.threshold(t, n):.4g}"
        lines.append(f'{n} [label="{label}"] ;')
        lines += [f"{n} -> {m} ;" for m in (t.left[n], t.right[n]) if f >= 0]
    return "\n".join([*lines, "}"])


def _labels(df: DataFrame, target: str) -> list:
    found = sorted(r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise InvalidParameter(f"{target} has more than {MAX_CLASSES} labels")
    if not found:
        raise InsufficientSamples("no labelled rows")
    return found


def _number(target: str, classes: list) -> Column:
    return (F.array_position(F.lit(classes), F.col(target)) - 1).cast("int")


class _Trees(Estimator):
    """Settings that all trees share. Rows without a target are left out; a missing value goes right."""

    count, bootstrap, random_cut = 1, False, False

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", max_depth: int = 6, min_samples_split: int = 2, min_samples_leaf: int = 1, max_features: int | str | None = None, max_bins: int = MAX_BINS, seed: int = 0, **more):
        self.columns, self.target, self.output, self.max_bins, self.seed = list(columns), target, output, max_bins, seed
        if max_depth < 0 or min_samples_leaf < 1 or not 2 <= max_bins < 2**15:
            raise InvalidParameter("max_depth from 0, min_samples_leaf from 1, max_bins from 2")
        d = len(self.columns)
        named = {None: None, "sqrt": max(1, int(d**0.5)), "log2": max(1, int(np.log2(d)))}
        features = named[max_features] if max_features in named else int(max_features)
        self.growth = Growth(max_depth, min_samples_split, min_samples_leaf, features, self.random_cut, seed=seed)
        for k, v in more.items():
            if not hasattr(self, k):
                raise InvalidParameter(f"unknown setting {k}")
            setattr(self, k, v)

    def weights(self, columns: dict, tree: int) -> np.ndarray:
        """Rows' weights in a tree: Poisson(1) numbers by row for a bootstrap, else 1."""
        n = len(columns["id"])
        if not self.bootstrap:
            return np.ones(n)
        u = _unit(columns["id"], self.seed * 1_000_003 + tree + 1)
        return np.searchsorted(np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)]), u).astype(float)


class _Classifier(_Trees):
    criterion = "gini"

    def fit(self, df: DataFrame) -> TreeModel:
        classes = _labels(df, self.target)
        edges = bin_edges(df, self.columns, self.max_bins)
        rows = binned(df.where(F.col(self.target).isNotNull()), self.columns, edges, [_number(self.target, classes).alias("y")])
        weights, k = self.weights, len(classes)

        def statistics(columns: dict, bins: np.ndarray, tree: int) -> np.ndarray:
            w = weights(columns, tree)
            return np.concatenate([w[:, None], w[:, None] * (columns["y"][:, None] == np.arange(k))], axis=1)

        trees = grow(rows, edges, self.count, k + 1, statistics, {"gini": gini, "entropy": entropy, "log_loss": entropy}[self.criterion], self.growth)
        trees = _rooted(trees, rows, statistics, k + 1)
        return TreeModel(self.columns, edges, trees, lambda s: s[1:] / max(s[0], 1e-300), lambda v: sum(v) / len(v), classes, self.output)


class _Regressor(_Trees):
    def fit(self, df: DataFrame) -> TreeModel:
        edges = bin_edges(df, self.columns, self.max_bins)
        rows = binned(df.where(value(self.target).isNotNull()), self.columns, edges, [value(self.target).alias("y")])
        weights = self.weights

        def statistics(columns: dict, bins: np.ndarray, tree: int) -> np.ndarray:
            w = weights(columns, tree)
            return np.stack([w, w * columns["y"]], axis=1)

        trees = _rooted(grow(rows, edges, self.count, 2, statistics, variance, self.growth), rows, statistics, 2)
        return TreeModel(self.columns, edges, trees, lambda s: s[1] / max(s[0], 1e-300), lambda v: sum(v) / len(v), None, self.output)


def _rooted(trees: list[Tree], rows: DataFrame, statistics: Callable, channels: int) -> list[Tree]:
    """Trees of depth 0 have no statistics yet: those of all rows."""
    if any(len(t.stats[0]) == 0 for t in trees):
        one = grow(rows.withColumn("bins", F.lit(b"\0\0")), [np.zeros(0)], len(trees), channels, statistics, lambda c: np.zeros(len(c)), Growth(1, 2**62))
        for t, o in zip(trees, one, strict=True):
            t.stats[0] = o.stats[0]
    return trees


class DecisionTreeClassifier(_Classifier):
    """One tree; criterion gini, entropy or log_loss."""


class DecisionTreeRegressor(_Regressor):
    """One tree by squared error."""


class ExtraTreeClassifier(_Classifier):
    """One tree whose cuts are drawn at random."""

    random_cut = True


class ExtraTreeRegressor(_Regressor):
    random_cut = True


class _Forest:
    count, bootstrap = 20, True

    def __init__(self, *args, n_estimators: int = 20, max_features: int | str | None = "sqrt", **kwargs):
        super().__init__(*args, max_features=max_features, **kwargs)
        self.count = n_estimators


class RandomForestClassifier(_Forest, _Classifier):
    """Trees on bootstrap samples, some columns tried at each node; probabilities are averaged."""


class RandomForestRegressor(_Forest, _Regressor):
    """Trees on bootstrap samples; values are averaged."""


class ExtraTreesClassifier(_Forest, _Classifier):
    """Trees with random cuts on all rows."""

    bootstrap, random_cut = False, True


class ExtraTreesRegressor(_Forest, _Regressor):
    bootstrap, random_cut = False, True


class BaggingClassifier(_Forest, _Classifier):
    """Trees on bootstrap samples with all columns at each node."""

    def __init__(self, *args, max_features: int | None = None, **kwargs):
        super().__init__(*args, max_features=max_features, **kwargs)


class BaggingRegressor(_Forest, _Regressor):
    def __init__(self, *args, max_features: int | None = None, **kwargs):
        super().__init__(*args, max_features=max_features, **kwargs)


class RandomTreesEmbedding(Estimator):
    """An array with each tree's leaf number: totally random trees, no target."""

    def __init__(self, columns: Sequence[str], n_estimators: int = 10, max_depth: int = 5, output: str = "leaf", seed: int = 0):
        self.columns, self.n_estimators, self.max_depth, self.output, self.seed = list(columns), n_estimators, max_depth, output, seed

    def fit(self, df: DataFrame) -> _Embedding:
        noise = (F.xxhash64(F.lit(self.seed), *self.columns) % 1_000_003).cast("double")
        inner = ExtraTreesRegressor(self.columns, "__noise", n_estimators=self.n_estimators, max_depth=self.max_depth, max_features=1, seed=self.seed)
        return _Embedding(inner.fit(df.withColumn("__noise", noise)), self.output)


class _Embedding(Model):
    def __init__(self, trees: TreeModel, output: str):
        self.trees, self.output = trees, output

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.apply(df, self.output)


class IsolationForest(Estimator):
    """Anomaly scores 2 ** (-mean path / expected path) of random trees on samples of about max_samples rows (hash of the row's number).

    A leaf of n sample rows adds the expected path of n. The score is from 0 to 1, higher for rows that part early.
    """

    def __init__(self, columns: Sequence[str], n_estimators: int = 50, max_samples: int = 256, output: str = "anomaly", seed: int = 0):
        self.columns, self.n_estimators, self.max_samples, self.output, self.seed = list(columns), n_estimators, max_samples, output, seed

    def fit(self, df: DataFrame) -> TreeModel:
        edges = bin_edges(df, self.columns)
        rows = binned(df, self.columns, edges, [])
        n = rows.count()
        share, seed = min(1.0, self.max_samples / n), self.seed

        def statistics(columns: dict, bins: np.ndarray, tree: int) -> np.ndarray:
            w = (_unit(columns["id"], seed * 1_000_003 + tree + 1) < share).astype(float)
            return np.stack([w, w], axis=1)

        depth = int(np.ceil(np.log2(max(2, min(self.max_samples, n)))))
        how = Growth(depth, 2, 1, 1, True, min_gain=-np.inf, seed=seed)
        trees = grow(rows, edges, self.n_estimators, 2, statistics, lambda c: np.zeros(len(c)), how)
        trees = _rooted(trees, rows, statistics, 2)
        usual = _path(min(self.max_samples, n))
        for tree in trees:
            depth_of = {0: 0}
            for k, f in enumerate(tree.feature):
                if f >= 0:
                    depth_of[tree.left[k]] = depth_of[tree.right[k]] = depth_of[k] + 1
            tree.stats = [np.array([depth_of[k] + _path(s[0] if len(s) else 0)]) for k, s in enumerate(tree.stats)]
        return TreeModel(self.columns, edges, trees, lambda s: s[0], lambda v: 2.0 ** (-(sum(v) / len(v)) / usual), None, self.output)


def _path(n: float) -> float:
    """The expected depth at which a search in a random tree of n rows ends."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class _Boosted(_Trees):
    """Trees on gradients, one after the other; leaves are Newton steps sum(g) / (sum(h) + l2)."""

    n_estimators, learning_rate, l2, subsample = 20, 0.1, 0.0, 1.0

    def boost(self, df: DataFrame, y: Column, base: np.ndarray, gradients: Callable, classes: list | None, link: Callable) -> TreeModel:
        edges = bin_edges(df, self.columns, self.max_bins)
        rows = binned(df, self.columns, edges, [y.alias("y")])
        k, rate, l2, share, seed = len(base), self.learning_rate, self.l2, self.subsample, self.seed
        score = lambda c: c[:, 1] ** 2 / np.maximum(c[:, 2] + l2, 1e-300)
        leaf = lambda s: rate * s[1] / max(s[2] + l2, 1e-300)
        trees: list[Tree] = []
        for step in range(self.n_estimators):
            before = [(t, np.array([leaf(s) for s in t.stats])) for t in trees]

            def statistics(columns: dict, bins: np.ndarray, tree: int, before=before, step=step) -> np.ndarray:
                if tree == 0 or columns.get("raw") is None:
                    raw = np.tile(base, (len(bins), 1))
                    for i, (t, v) in enumerate(before):
                        raw[:, i % k] += v[t.nodes(bins)]
                    columns["raw"] = raw
                g, h = gradients(columns["y"], columns["raw"], tree)
                w = np.ones(len(g)) if share >= 1 else (_unit(columns["id"], seed * 1_000_003 + step + 1) < share).astype(float)
                return np.stack([w, w * g, w * h], axis=1)

            new = grow(rows, edges, k, 3, statistics, score, self.growth)
            trees += _rooted(new, rows, statistics, 3)

        def combine(values: list[np.ndarray]) -> np.ndarray:
            raw = np.stack([base[c] + sum(values[c::k]) for c in range(k)], axis=1)
            return link(raw)

        return TreeModel(self.columns, edges, trees, leaf, combine, classes, self.output)


class GradientBoostingRegressor(_Boosted):
    """loss squared_error, absolute_error (steps of the sign) or huber (bounded at delta)."""

    loss, delta = "squared_error", 1.0

    def fit(self, df: DataFrame) -> TreeModel:
        df = df.where(value(self.target).isNotNull())
        first = F.avg(value(self.target)) if self.loss == "squared_error" else F.percentile_approx(value(self.target), 0.5, 100_000)
        base = df.agg(first).first()[0]
        if base is None:
            raise InsufficientSamples("no rows to fit on")
        loss, delta = self.loss, self.delta

        def gradients(y: np.ndarray, raw: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray]:
            g = y - raw[:, 0]
            if loss == "absolute_error":
                g = np.sign(g)
            elif loss == "huber":
                g = np.clip(g, -delta, delta)
            return g, np.ones(len(g))

        return self.boost(df, value(self.target), np.array([float(base)]), gradients, None, lambda raw: raw[:, 0])


class GradientBoostingClassifier(_Boosted):
    """Log loss: one tree a step for two classes, one for each of more."""

    def fit(self, df: DataFrame) -> TreeModel:
        df = df.where(F.col(self.target).isNotNull())
        classes = _labels(df, self.target)
        counts = dict(df.groupBy(_number(self.target, classes).alias("y")).count().collect())
        prior = np.array([counts[i] for i in range(len(classes))], float) / sum(counts.values())
        y = _number(self.target, classes)
        if len(classes) == 2:
            base = np.array([np.log(prior[1] / prior[0])])

            def gradients(y: np.ndarray, raw: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray]:
                p = 1 / (1 + np.exp(-raw[:, 0]))
                return y - p, p * (1 - p)

            def link(raw: np.ndarray) -> np.ndarray:
                p = 1 / (1 + np.exp(-raw[:, 0]))
                return np.stack([1 - p, p], axis=1)

            return self.boost(df, y, base, gradients, classes, link)

        def shares(raw: np.ndarray) -> np.ndarray:
            e = np.exp(raw - raw.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        def several(y: np.ndarray, raw: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
            p = shares(raw)[:, c]
            return (y == c) - p, p * (1 - p)

        return self.boost(df, y, np.log(prior), several, classes, shares)


class HistGradientBoostingRegressor(GradientBoostingRegressor):
    """GradientBoostingRegressor with leaves of at least 20 rows, as its trees are grown from histograms anyway."""

    def __init__(self, *args, min_samples_leaf: int = 20, **kwargs):
        super().__init__(*args, min_samples_leaf=min_samples_leaf, **kwargs)


class HistGradientBoostingClassifier(GradientBoostingClassifier):
    def __init__(self, *args, min_samples_leaf: int = 20, **kwargs):
        super().__init__(*args, min_samples_leaf=min_samples_leaf, **kwargs)


class AdaBoostClassifier(_Classifier):
    """Shallow trees, each on rows weighted by the mistakes so far (SAMME); votes are weighted by ln((1 - e) / e) + ln(K - 1)."""

    n_estimators = 10

    def __init__(self, *args, max_depth: int = 1, n_estimators: int = 10, learning_rate: float = 1.0, **kwargs):
        super().__init__(*args, max_depth=max_depth, **kwargs)
        self.n_estimators, self.learning_rate = n_estimators, learning_rate

    def fit(self, df: DataFrame) -> TreeModel:
        classes = _labels(df, self.target)
        edges = bin_edges(df, self.columns, self.max_bins)
        rows = binned(df.where(F.col(self.target).isNotNull()), self.columns, edges, [_number(self.target, classes).alias("y")])
        k = len(classes)
        trees, votes = [], []
        for _ in range(self.n_estimators):
            before = list(zip(trees, votes, strict=True))

            def statistics(columns: dict, bins: np.ndarray, tree: int, before=before) -> np.ndarray:
                log = np.zeros(len(bins))
                for t, vote in before:
                    log += vote * (np.array([s[1:].argmax() for s in t.stats])[t.nodes(bins)] != columns["y"])
                w = np.exp(log - sum(v for _, v in before))
                return np.concatenate([w[:, None], w[:, None] * (columns["y"][:, None] == np.arange(k))], axis=1)

            new = _rooted(grow(rows, edges, 1, k + 1, statistics, gini, Growth(self.growth.max_depth, 0, 1e-300, None)), rows, statistics, k + 1)[0]
            leaves = [s for s, f in zip(new.stats, new.feature, strict=True) if f < 0]
            wrong = 1 - sum(s[1:].max() for s in leaves) / sum(s[0] for s in leaves)
            if wrong >= 1 - 1 / k and trees:
                break
            trees.append(new)
            votes.append(self.learning_rate * (np.log((1 - wrong) / max(wrong, 1e-12)) + np.log(k - 1)) if k > 1 else 1.0)
            if wrong <= 1e-12:
                break

        def combine(values: list[np.ndarray]) -> np.ndarray:
            total = sum(vote * (v == v.max(axis=1, keepdims=True)) for v, vote in zip(values, votes, strict=True))
            return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

        return TreeModel(self.columns, edges, trees, lambda s: np.eye(k)[s[1:].argmax()], combine, classes, self.output)


class AdaBoostRegressor(_Regressor):
    """Trees on rows weighted by their linear loss so far (R2); the prediction is the weighted median of the trees'."""

    def __init__(self, *args, max_depth: int = 3, n_estimators: int = 10, learning_rate: float = 1.0, **kwargs):
        super().__init__(*args, max_depth=max_depth, **kwargs)
        self.n_estimators, self.learning_rate = n_estimators, learning_rate

    def fit(self, df: DataFrame) -> TreeModel:
        edges = bin_edges(df, self.columns, self.max_bins)
        rows = binned(df.where(value(self.target).isNotNull()), self.columns, edges, [value(self.target).alias("y")])
        trees, votes, greatest = [], [], []
        mean = lambda s: s[1] / max(s[0], 1e-300)
        for _ in range(self.n_estimators):
            before = list(zip(trees, votes, greatest, strict=True))

            def losses(t: Tree, columns: dict, bins: np.ndarray) -> np.ndarray:
                return np.abs(columns["y"] - np.array([mean(s) for s in t.stats])[t.nodes(bins)])

            def weights(columns: dict, bins: np.ndarray, before=before, losses=losses) -> np.ndarray:
                log = np.zeros(len(bins))
                for t, vote, top in before:
                    log += -vote * (1 - losses(t, columns, bins) / max(top, 1e-300))
                return np.exp(log)

            def statistics(columns: dict, bins: np.ndarray, tree: int, weights=weights) -> np.ndarray:
                w = weights(columns, bins)
                return np.stack([w, w * columns["y"]], axis=1)

            new = _rooted(grow(rows, edges, 1, 2, statistics, variance, Growth(self.growth.max_depth, 0, 1e-300, None)), rows, statistics, 2)[0]

            def spread(batches: Iterator[pa.RecordBatch], new=new, weights=weights, losses=losses) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                        columns = {"y": batch.column("y").to_numpy(zero_copy_only=False)}
                        loss, w = losses(new, columns, bins), weights(columns, bins)
                        yield pa.RecordBatch.from_arrays([pa.array([loss.max()]), pa.array([float((w * loss).sum())]), pa.array([float(w.sum())])], ["top", "loss", "w"])

            top, loss, w = rows.mapInArrow(spread, "top double, loss double, w double").agg(F.max("top"), F.sum("loss"), F.sum("w")).first()
            average = loss / max(top * w, 1e-300)
            if average >= 0.5 and trees:
                break
            trees.append(new)
            greatest.append(top)
            votes.append(self.learning_rate * np.log((1 - average) / max(average, 1e-12)))
            if top <= 0:
                break

        def combine(values: list[np.ndarray]) -> np.ndarray:
            v, w = np.stack(values, axis=1), np.array(votes)
            order = np.argsort(v, axis=1, kind="stable")
            half = np.cumsum(w[order], axis=1) >= 0.5 * w.sum()
            return np.take_along_axis(v, np.take_along_axis(order, half.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]

        return TreeModel(self.columns, edges, trees, mean, combine, None, self.output)


class VotingClassifier(Estimator):
    """The label that most of several classifiers give (ties: the first in order), or of the highest mean probability (voting soft).

    Members are estimators that write the same output and, for soft voting, output_probability over the same classes.
    """

    def __init__(self, members: Sequence[Estimator], output: str = "prediction", voting: str = "hard"):
        self.members, self.output, self.voting = list(members), output, voting

    def fit(self, df: DataFrame) -> _Voted:
        return _Voted([m.fit(df) for m in self.members], self.output, self.voting)


class VotingRegressor(VotingClassifier):
    """The mean of several regressors' predictions."""

    def __init__(self, members: Sequence[Estimator], output: str = "prediction"):
        super().__init__(members, output, "mean")


class _Voted(Model):
    def __init__(self, models: Sequence[Model], output: str, voting: str):
        self.models, self.output, self.voting = models, output, voting

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"__vote{i}" for i in range(len(self.models))]
        own = f"{self.output}_probability"
        columns = df.columns
        for name, model in zip(names, self.models, strict=True):
            df = model.transform(df)
            df = df.withColumnRenamed(own if self.voting == "soft" else self.output, name).select(*columns, *[c for c in names if c in {*df.columns, name} and (c == name or c in df.columns)])
        votes = [F.col(n) for n in names]
        if self.voting == "mean":
            out = sum(votes[1:], votes[0]) / len(votes)
        elif self.voting == "soft":
            total = F.aggregate(F.array(*votes), F.transform(votes[0], lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
            out = F.element_at(F.lit(list(self.models[0].classes)), F.array_position(total, F.array_max(total)).cast("int"))
        else:
            all_ = F.array_sort(F.array(*votes))
            counted = F.transform(F.array_distinct(all_), lambda x: F.struct((-F.size(F.filter(all_, lambda v: v == x))).alias("n"), x.alias("x")))
            out = F.array_min(counted)["x"]
        return df.withColumn(self.output, out).drop(*names)
