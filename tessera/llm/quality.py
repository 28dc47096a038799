"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Each passage is described by measures
that don't depend on the language and encoded by a layer; gated attention weighs the passages, and
the weighted representation is scored. All weights are learnt from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SCORED_AT_ONCE, adam, labelled_sample, release_memory, text_buffers, with_score, word_hashes

#: Labelled documents of each class that the model is fitted on at most.
PER_CLASS = 2000
PASSAGE = 64
CODE, GATE = 16, 8

#: Byte classes: other, lower, upper, digit, space, full stop and the like, comma, bar, exclamation, symbol, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 10 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".?;:" else 6 if _c in ",'" else 7 if _c == "|" else 8 if _c == "!" else 9 if _b > 32 else 0
_CLASSES = 11
MEASURES = _CLASSES + 8


def passages(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and measures of every passage."""
    h, starts, ends = word_hashes(buf)
    if not len(h):
        return np.empty(0, np.int64), np.empty((0, MEASURES))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first_word = np.searchsorted(doc, np.arange(len(offsets) - 1))
    index = np.arange(len(h)) - first_word[doc]
    new = index % PASSAGE == 0
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    n = len(first)
    words = np.bincount(number, minlength=n).astype(float)
    last = np.concatenate([first[1:], [len(h)]]) - 1
    begin, end = starts[first], ends[last]
    owner = np.repeat(np.arange(n), end - begin)
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange(len(owner))
    kinds = np.bincount(owner * _CLASSES + _CLASS[buf[at]], minlength=n * _CLASSES).reshape(n, _CLASSES) / (end - begin)[:, None]
    length = ends - starts
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])

    def distinct(key: np.ndarray, size: int) -> np.ndarray:
        order = np.lexsort((h, key))
        k, v = key[order], h[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
        return np.bincount(k[fresh], minlength=size)

    per = lambda values: np.bincount(number, values, n) / words
    in_doc = distinct(doc, len(offsets) - 1) / np.maximum(np.bincount(doc, minlength=len(offsets) - 1), 1)
    mean = per(length)
    x = np.column_stack([
        kinds,
        np.log1p(mean),
        np.sqrt(np.maximum(per(length.astype(float) ** 2) - mean**2, 0)) / (1 + mean),
        per(again),
        distinct(number, n) / words,
        in_doc[doc[first]],
        per(length <= 1),
        per(_CLASS[buf[ends - 1]] >= 7),
        np.log1p(words) / np.log1p(PASSAGE),
    ])
    return doc[first], x


def _unpack(w: np.ndarray):
    shapes = [(MEASURES, CODE), (CODE,), (CODE, GATE), (GATE,), (CODE, GATE), (GATE,), (GATE,), (CODE,), (1,)]
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(w[at : at + size].reshape(shape))
        at += size
    return out, at


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def _forward(self, doc: np.ndarray, x: np.ndarray, n: int):
        (w1, b1, v, bv, u, bu, a, c, d), _ = _unpack(self.weights)
        code = np.tanh(x @ w1 + b1)
        t, g = np.tanh(code @ v + bv), 1 / (1 + np.exp(-(code @ u + bu)))
        e = (t * g) @ a
        top = np.full(n, -np.inf)
        np.maximum.at(top, doc, e)
        weight = np.exp(e - top[doc])
        weight /= np.bincount(doc, weight, n)[doc]
        bag = np.stack([np.bincount(doc, weight * code[:, k], n) for k in range(CODE)], axis=1)
        score = 1 / (1 + np.exp(-np.clip(bag @ c + d[0], -40, 40)))
        return code, t, g, weight, bag, score

    def scores(self, doc: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of n documents (0 for those without passages) and the attention that each passage gets."""
        if not len(doc):
            return np.zeros(n), np.empty(0)
        *_, weight, _, score = self._forward(doc, (x - self.mean) / self.scale, n)
        return np.where(np.bincount(doc, minlength=n) > 0, score, 0.0), weight


def fit(rows: list[tuple[str, int]], steps: int = 250, seed: int = 11) -> QualityModel:
    """Fits on (text, label) rows, both classes counting the same; without both, every text with words scores the share of label 1."""
    docs, parts = [], []
    for first, buf, offsets in text_buffers(pa.array([t for t, _ in rows], pa.string()), SCORED_AT_ONCE):
        d, x = passages(buf, offsets)
        docs.append(d + first)
        parts.append(x)
    y = np.array([label for _, label in rows], float)
    size = _unpack(np.zeros(10**5))[1]
    if not 0 < y.sum() < len(y):
        w = np.zeros(size)
        w[-1] = -40 if not y.sum() else 40
        return QualityModel(np.zeros(MEASURES), np.ones(MEASURES), w)
    doc, x = np.concatenate(docs), np.concatenate(parts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    has = np.bincount(doc, minlength=len(y)) > 0
    share = np.where(y == 1, 0.5 / max(1, y[has].sum()), 0.5 / max(1, (1 - y)[has].sum())) * has

    def gradient(w: np.ndarray, _: int) -> np.ndarray:
        (w1, b1, v, bv, u, bu, a, c, d), _ = _unpack(w)
        code, t, g, weight, bag, score = QualityModel(mean, scale, w)._forward(doc, x, len(y))
        out = (score - y) * share
        d_code = weight[:, None] * out[doc][:, None] * c
        value = (code - bag[doc]) @ c
        d_e = weight * value * out[doc]
        d_tg = d_e[:, None] * a
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_code += d_t @ v.T + d_g @ u.T
        d_in = d_code * (1 - code * code)
        parts = [x.T @ d_in, d_in.sum(0), code.T @ d_t, d_t.sum(0), code.T @ d_g, d_g.sum(0), (t * g).T @ d_e, np.where(has[:, None], bag, 0).T @ out, np.array([out.sum()])]
        return np.concatenate([p.reshape(-1) for p in parts]) + 1e-5 * w

    start = np.random.default_rng(seed).normal(0, 0.3, size)
    return QualityModel(mean, scale, adam(gradient, start, steps, 0.02))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fits on at most `per_class` documents of each value of labels.quality."""
    model = fit(labelled_sample(docs, labels, "quality", per_class))
    release_memory()
    return model


SCORED = "doc_id long, score double, passages int, best_passage int"


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, number of passages and the one with most attention (-1 without any) of every row of docs (doc_id, text).

    The model has a fixed size. Texts that are null or have no words score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offsets in text_buffers(batch.column(1)):
                n = len(offsets) - 1
                doc, x = passages(buf, offsets)
                value, weight = model.scores(doc, x, n)
                count = np.bincount(doc, minlength=n)
                best = np.full(n, -1)
                order = np.lexsort((-np.arange(len(doc)), weight))
                best[doc[order]] = order - (np.cumsum(count) - count)[doc[order]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(value), pa.array(count, pa.int32()), pa.array(best, pa.int32())], ["doc_id", "score", "passages", "best_passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def annotated(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with their columns and score."""
    return with_score(docs, lambda buf, offsets: model.scores(*passages(buf, offsets), len(offsets) - 1)[0])
