"""Clusters by density, mixtures, splits and label spreading."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, InvalidParameter
from tessera.operators.base import Estimator, Model, need, value
from tessera.operators.decomposition import KMeans, NearestCentre
from tessera.operators.factors import landmarks
from tessera.operators.graphs import connected_components
from tessera.operators.linear import gram
from tessera.plans.storage import stored


def near_pairs(df: DataFrame, key: str, columns: Sequence[str], eps: float) -> DataFrame:
    """a, b and distance of all pairs of different rows within eps, by few columns: rows meet in cells of a grid of width eps,
    of which each row is sent to its neighbours, so no row is compared with all."""
    need(df, [key, *columns])
    x = [value(c).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(key).alias("k"), *x).dropna()
    cell = [F.floor(F.col(f"x{i}") / F.lit(float(eps))).alias(f"g{i}") for i in range(len(columns))]
    own = rows.select("k", *[f"x{i}" for i in range(len(columns))], *cell)
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(offsets)]) for offsets in itertools.product((-1, 0, 1), repeat=len(columns))])
    sent = own.withColumn("o", F.explode(around)).select(F.col("k").alias("a"), *[F.col(f"x{i}").alias(f"a{i}") for i in range(len(columns))], *[(F.col(f"g{i}") + F.col(f"o.o{i}")).alias(f"g{i}") for i in range(len(columns))])
    met = sent.join(own, [f"g{i}" for i in range(len(columns))]).where(F.col("a") != F.col("k"))
    d = F.sqrt(sum(((F.col(f"a{i}") - F.col(f"x{i}")) ** 2 for i in range(len(columns))), F.lit(0.0)))
    return met.select("a", F.col("k").alias("b"), d.alias("distance")).where(F.col("distance") <= eps)


class DBSCAN:
    """cluster: the number of the group of core rows (at least min_samples rows within eps, itself included) that reach
    each other within eps, and of the rows within eps of one of them (of the group with the least core key); -1 for noise.
    Groups are numbered by their least key."""

    def __init__(self, key: str, columns: Sequence[str], eps: float = 0.5, min_samples: int = 5, output: str = "cluster"):
        if eps <= 0 or min_samples < 1:
            raise InvalidParameter("eps above 0, min_samples from 1")
        self.key, self.columns, self.eps, self.min_samples, self.output = key, list(columns), eps, min_samples, output

    def fit_transform(self, df: DataFrame) -> DataFrame:
        from tessera.operators.ranks import numbered

        pairs = stored(near_pairs(df, self.key, self.columns, self.eps).select("a", "b"))
        degrees = pairs.groupBy("a").agg((F.count("*") + 1).alias("n"))
        keys = df.select(F.col(self.key).alias("a"))
        core = stored((keys.join(degrees, "a", "left").where(F.coalesce("n", F.lit(1)) >= self.min_samples)).select("a"))
        linked = pairs.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi")
        parts = stored(connected_components(core.withColumnRenamed("a", "node"), linked.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        edge = pairs.join(core, "a", "left_anti").join(parts.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("component"))
        every = parts.select(F.col("node").alias("a"), "component").unionByName(edge)
        names = numbered(parts.select("component").distinct(), ["component"], "__c")
        out = every.join(names, "component").select(F.col("a").alias(self.key), F.col("__c").cast("int").alias(self.output))
        return df.join(out, self.key, "left").withColumn(self.output, F.coalesce(self.output, F.lit(-1)))


class MiniBatchKMeans(KMeans):
    """Centres from batches of about batch_size rows (by a hash of the key), each moved by 1 / rows seen; one job a batch."""

    def __init__(self, columns: Sequence[str], key: Sequence[str], n_clusters: int = 8, batch_size: int = 1024, batches: int = 20, seed: int = 0, **options):
        super().__init__(columns, n_clusters, **options)
        self.key, self.batch_size, self.batches, self.seed = list(key), batch_size, batches, seed

    def fit(self, df: DataFrame) -> NearestCentre:
        n = df.count()
        start = landmarks(df, self.columns, self.key, max(self.n_clusters * 50, 100), self.seed)
        centres = np.array(self.centres, float) if self.centres is not None else kmeans_plusplus(start, self.n_clusters, self.seed)
        seen = np.zeros(len(centres))
        parts = max(1, n // self.batch_size)
        for k in range(self.batches):
            batch = df.where(F.pmod(F.xxhash64(F.lit(self.seed + 1 + k), *self.key), F.lit(parts)) == 0)
            for r in NearestCentre(self.columns, centres, self.output).transform(batch).groupBy(self.output).agg(F.count("*"), *[F.avg(value(c)) for c in self.columns]).collect():
                seen[r[0]] += r[1]
                centres[r[0]] += (np.array(list(r)[2:]) - centres[r[0]]) * r[1] / seen[r[0]]
        return NearestCentre(self.columns, centres, self.output)


def kmeans_plusplus(rows: np.ndarray, n_clusters: int, seed: int = 0) -> np.ndarray:
    """Rows drawn in turn with a chance that goes with the squared distance from those drawn before."""
    r = np.random.default_rng(seed)
    if len(rows) < n_clusters:
        raise InsufficientSamples("fewer rows than clusters")
    centres = [rows[r.integers(len(rows))]]
    near = ((rows - centres[0]) ** 2).sum(axis=1)
    for _ in range(n_clusters - 1):
        total = near.sum()
        pick = int(np.searchsorted(np.cumsum(near), r.uniform() * total)) if total > 0 else int(r.integers(len(rows)))
        centres.append(rows[min(pick, len(rows) - 1)])
        near = np.minimum(near, ((rows - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres, float)


class BisectingKMeans(KMeans):
    """The cluster of the largest sum of squares is cut in two until there are n_clusters."""

    def fit(self, df: DataFrame) -> NearestCentre:
        rows = stored(df.select(*[value(c).alias(c) for c in self.columns]).dropna().withColumn("__leaf", F.lit(0)))
        leaves = 1
        while leaves < self.n_clusters:
            spread = sum((F.var_pop(c) for c in self.columns), F.lit(0.0)) * F.count("*")
            worst = rows.groupBy("__leaf").agg(spread.alias("s")).orderBy(F.desc("s"), "__leaf").first()
            if not worst or not worst["s"]:
                break
            part = rows.where(F.col("__leaf") == worst[0])
            model = KMeans(self.columns, 2, max_iter=self.max_iter, tol=self.tol, output="__half").fit(part)
            rows = stored(model.transform(rows).withColumn("__leaf", F.when((F.col("__leaf") == worst[0]) & (F.col("__half") == 1), F.lit(leaves)).otherwise(F.col("__leaf"))).drop("__half"))
            leaves += 1
        found = rows.groupBy("__leaf").agg(*[F.avg(c) for c in self.columns]).orderBy("__leaf").collect()
        return NearestCentre(self.columns, np.array([list(r)[1:] for r in found]), self.output)


class GaussianMixture(Estimator):
    """Normal components by expectation maximisation, one aggregate job a step: sums of shares, of x and of x x' for each component.

    Starts from given means, or k-means++ on a bounded sample, with the whole covariance. covariance full or diag.
    """

    def __init__(self, columns: Sequence[str], n_components: int = 2, covariance: str = "full", means: Sequence[Sequence[float]] | None = None, key: Sequence[str] | None = None, max_iter: int = 100, tol: float = 1e-6, reg: float = 1e-6, output: str = "component", seed: int = 0):
        if covariance not in ("full", "diag"):
            raise InvalidParameter("covariance full or diag")
        self.columns, self.n_components, self.covariance, self.means, self.key, self.max_iter, self.tol, self.reg, self.output, self.seed = list(columns), n_components, covariance, means, key, max_iter, tol, reg, output, seed

    prior = 0.0  # rows that each component is thought to have had

    def fit(self, df: DataFrame) -> _Mixture:
        n, mean, p = gram(df, self.columns)
        d, k = len(self.columns), self.n_components
        scale = np.sqrt(np.maximum(np.diag(p) / n, 1e-300))
        first = np.array(self.means, float) if self.means is not None else kmeans_plusplus(landmarks(df, self.columns, self.key or self.columns, 2000, self.seed), k, self.seed)
        mu, weight = (first - mean) / scale, np.full(k, 1 / k)
        start = p / n / np.outer(scale, scale)
        cov = np.stack([np.diag(np.diag(start)) if self.covariance == "diag" else start] * k) + self.reg * np.eye(d)
        rows = stored(df.select(*[((value(c) - float(m)) / float(s)).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(self.columns, mean, scale, strict=True))]).dropna())
        pairs = [(i, j) for i in range(d) for j in range(i, d) if self.covariance == "full" or i == j]
        last = -np.inf
        for _ in range(self.max_iter):
            z = [F.col(f"x{i}") for i in range(d)]
            logs = rows.select("*", *[_log_normal(z, w, m, c).alias(f"l{a}") for a, (w, m, c) in enumerate(zip(weight, mu, cov, strict=True))])
            top = F.greatest(*[f"l{a}" for a in range(k)]) if k > 1 else F.col("l0")
            logs = logs.withColumn("top", top)
            logs = logs.withColumn("total", F.col("top") + F.ln(sum((F.exp(F.col(f"l{a}") - F.col("top")) for a in range(k)), F.lit(0.0))))
            shares = logs.select("total", *[f"x{i}" for i in range(d)], *[F.exp(F.col(f"l{a}") - F.col("total")).alias(f"r{a}") for a in range(k)])
            row = shares.agg(
                F.avg("total"), *[F.sum(f"r{a}") for a in range(k)], *[F.sum(F.col(f"r{a}") * F.col(f"x{i}")) for a in range(k) for i in range(d)],
                *[F.sum(F.col(f"r{a}") * F.col(f"x{i}") * F.col(f"x{j}")) for a in range(k) for i, j in pairs],
            ).first()
            now, at = row[0], 1 + k + k * d
            size = np.array(row[1 : 1 + k])
            mu = np.array(row[1 + k : at]).reshape(k, d) / np.maximum(size, 1e-300)[:, None]
            cov = np.zeros((k, d, d))
            for a in range(k):
                for q, (i, j) in enumerate(pairs):
                    cov[a, i, j] = cov[a, j, i] = row[at + a * len(pairs) + q] / max(size[a], 1e-300) - mu[a, i] * mu[a, j]
                cov[a] += self.reg * np.eye(d)
            weight = (size + self.prior) / (size + self.prior).sum()
            if abs(now - last) < self.tol:
                break
            last = now
        self.weights, self.log_likelihood = weight, float(now - np.log(scale).sum())
        return _Mixture(self.columns, weight, mu * scale + mean, cov * np.outer(scale, scale), self.output)


def _log_normal(x: list, weight: float, mean: np.ndarray, cov: np.ndarray):
    inverse = np.linalg.inv(cov)
    front = math.log(max(weight, 1e-300)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * len(mean) * math.log(2 * math.pi)
    y = [v - F.lit(float(m)) for v, m in zip(x, mean, strict=True)]
    far = sum((F.lit(float(inverse[i, j]) * (1 if i == j else 2)) * y[i] * y[j] for i in range(len(y)) for j in range(i, len(y)) if inverse[i, j]), F.lit(0.0))
    return F.lit(front) - 0.5 * far


class BayesianGaussianMixture(GaussianMixture):
    """GaussianMixture whose weights have a Dirichlet prior of `prior` - 1 rows for each component, at least 0."""

    def __init__(self, *args, prior: float = 1.0, **kwargs):
        super().__init__(*args, **kwargs)
        self.prior = max(prior - 1, 0.0)


class _Mixture(Model):
    def __init__(self, columns, weights, means, covariances, output):
        self.columns, self.weights, self.means, self.covariances, self.output = columns, weights, means, covariances, output

    def transform(self, df: DataFrame) -> DataFrame:
        logs = [_log_normal([value(c) for c in self.columns], w, m, v) for w, m, v in zip(self.weights, self.means, self.covariances, strict=True)]
        best = F.array_max(F.array(*logs))
        return df.withColumn(self.output, (F.array_position(F.array(*logs), best) - 1).cast("int"))


class LabelPropagation:
    """Labels spread over a table of edges (u, v, weight): each node's share of a label becomes the weighted mean of its
    neighbours'; labelled nodes keep theirs (alpha 0) or mix 1 - alpha of it in (LabelSpreading)."""

    def __init__(self, iterations: int = 30, alpha: float = 0.0):
        self.iterations, self.alpha = iterations, alpha

    def normalised(self, both: DataFrame) -> DataFrame:
        total = both.groupBy("u").agg(F.sum("weight").alias("t"))
        return both.join(total, "u").select("u", "v", (F.col("weight") / F.col("t")).alias("w"))

    def fit_transform(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """nodes (node, label or null); gives node and label, null where no label reaches."""
        both = stored(self.normalised(edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))))
        given = stored(nodes.where("label is not null").select("node", "label", F.lit(1.0).alias("share")))
        now = given
        for _ in range(self.iterations):
            told = both.join(now, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node"), "label").agg(F.sum(F.col("w") * F.col("share")).alias("share"))
            if self.alpha:
                told = told.select("node", "label", (F.col("share") * self.alpha).alias("share")).unionByName(given.select("node", "label", F.lit(1 - self.alpha).alias("share"))).groupBy("node", "label").agg(F.sum("share").alias("share"))
            else:
                told = told.join(given.select("node"), "node", "left_anti").unionByName(given)
                whole = told.groupBy("node").agg(F.sum("share").alias("t"))
                told = told.join(whole, "node").select("node", "label", (F.col("share") / F.col("t")).alias("share"))
            now = stored(told)
        best = now.groupBy("node").agg(F.min(F.struct((-F.round("share", 12)).alias("s"), "label")).alias("best"))
        return nodes.select("node").join(best.select("node", "best.label"), "node", "left")


class LabelSpreading(LabelPropagation):
    def __init__(self, iterations: int = 30, alpha: float = 0.2):
        super().__init__(iterations, alpha)

    def normalised(self, both):
        total = both.groupBy("u").agg(F.sum("weight").alias("t"))
        return both.join(total, "u").join(total.select(F.col("u").alias("v"), F.col("t").alias("t2")), "v").select("u", "v", (F.col("weight") / F.sqrt(F.col("t") * F.col("t2"))).alias("w"))


def silhouette_samples(df: DataFrame, key: str, columns: Sequence[str], label: str) -> DataFrame:
    """Each row's silhouette by squared Euclidean distance, from cluster sums (no pairs): (b - a) / max(a, b); 0 in clusters of one row."""
    x = [value(c) for c in columns]
    norm = sum((v * v for v in x), F.lit(0.0))
    sums = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"), F.sum(norm).alias("__q"), *[F.sum(v).alias(f"__s{i}") for i, v in enumerate(x)])
    met = df.select(key, F.col(label).alias("__own"), norm.alias("__norm"), *[v.alias(f"__x{i}") for i, v in enumerate(x)]).crossJoin(F.broadcast(sums))
    total = F.col("__n") * F.col("__norm") + F.col("__q") - 2 * sum((F.col(f"__x{i}") * F.col(f"__s{i}") for i in range(len(x))), F.lit(0.0))
    own = F.col("__own") == F.col("__l")
    found = met.groupBy(key).agg(F.max(F.when(own, F.when(F.col("__n") > 1, total / (F.col("__n") - 1)))).alias("a"), F.min(F.when(~own, total / F.col("__n"))).alias("b"))
    return found.select(key, F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def silhouette_score(df: DataFrame, key: str, columns: Sequence[str], label: str) -> DataFrame:
    return silhouette_samples(df, key, columns, label).agg(F.avg("silhouette").alias("silhouette"))
