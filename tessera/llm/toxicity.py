"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A sentence's score is the logistic function of a bias and the weights of its distinct words and of
their first bytes (inflected forms share them). A document is toxic unless every sentence is clean:
1 - product(1 - sentence score). The weights follow the gradient of the documents' log-likelihood
through that product, so each toxic document picks the sentences that explain it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import adam, labelled_sample, release_memory, text_buffers, with_score, word_hashes

#: Labelled documents of each class that the model is fitted on at most.
PER_CLASS = 3000
BITS = 18
#: Features that enter the model: the most telling ones of at least so many documents.
FEATURES, MIN_DOCUMENTS = 3000, 4
PREFIXES = (4, 5, 6)
#: What all negative documents together count for, against all positive ones.
NEGATIVE = 4.0
#: A sentence at least so likely to be toxic is an offending one.
OFFENDING = 0.3

_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def _features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (a row for words and each prefix length; 0 is none), word starts and ends."""
    h, starts, ends = word_hashes(buf, between=_BETWEEN, prefixes=PREFIXES)
    return np.where(h == 0, 0, (h >> np.uint64(64 - BITS)) | np.uint64(1)).astype(np.int32), starts, ends


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # one for each feature number
    bias: float

    def sentences(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, first byte, end and logit of every sentence that has words."""
        feature, starts, ends = _features(buf)
        if not len(starts):
            none = np.empty(0, np.int64)
            return none, none, none, np.empty(0)
        number = np.cumsum(_STOP[buf])[starts]  # texts are separated by line feeds
        first = np.flatnonzero(np.diff(number, prepend=-1))
        row, at = np.nonzero(self.weights[feature])
        seen = np.unique(number[at] << BITS | feature[row, at])  # a word that a sentence repeats counts once
        logit = np.bincount(np.searchsorted(number[first], seen >> BITS), self.weights[seen & ((1 << BITS) - 1)], len(first)) + self.bias
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        return np.searchsorted(offsets, starts[first], side="right") - 1, starts[first], ends[last], logit

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The noisy-or of each text's sentences; 0 without words."""
        doc, _, _, logit = self.sentences(buf, offsets)
        return -np.expm1(-np.bincount(doc, np.logaddexp(0, logit), len(offsets) - 1))


def fit(rows: list[tuple[str, int]], steps: int = 300) -> ToxicityModel:
    """Fits on (text, label) rows; without rows of both classes every score is the share of label 1."""
    labels = np.array([y for _, y in rows], float)
    weights = np.zeros(1 << BITS)
    if not 0 < labels.sum() < len(labels):
        return ToxicityModel(weights, -40.0 if not labels.sum() else 40.0)
    texts = pa.array([t for t, _ in rows])

    def occurrences():
        """Document, sentence and feature of every occurrence, a few MB of text at a time."""
        base = 0
        for first, buf, offsets in text_buffers(texts):
            feature, starts, _ = _features(buf)
            if not len(starts):
                continue
            number = np.cumsum(_STOP[buf])[starts] + base
            base = int(number[-1]) + 1
            doc = np.searchsorted(offsets, starts, side="right") - 1 + first
            yield from ((doc[row > 0], number[row > 0], row[row > 0]) for row in feature)

    size = 1 << BITS
    with1, all_ = np.zeros(size), np.zeros(size)
    for doc, _, feature in occurrences():
        seen = np.unique(doc << BITS | feature)
        all_ += np.bincount(seen & (size - 1), minlength=size)
        with1 += np.bincount(seen & (size - 1), labels[seen >> BITS], size)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = np.log((with1 + 0.5) / (n1 + 1)) - np.log((all_ - with1 + 0.5) / (n0 + 1))
    tell = np.where((all_ >= MIN_DOCUMENTS) & (odds > 0), odds * np.sqrt(with1), 0)
    chosen = np.sort(np.argsort(-tell, kind="stable")[:FEATURES])
    chosen = chosen[tell[chosen] > 0]
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    features, sentences, every, owners = [], [], [], []
    for doc, number, feature in occurrences():
        kept = place[feature] >= 0
        seen = np.unique(number[kept] << BITS | place[feature[kept]])
        features.append(seen & (size - 1))
        sentences.append(seen >> BITS)
        new = np.flatnonzero(np.diff(number, prepend=-1))
        every.append(number[new])
        owners.append(doc[new])
    everyone, at = np.unique(np.concatenate(every), return_index=True)
    owner = np.concatenate(owners)[at]
    f, s = np.concatenate(features), np.searchsorted(everyone, np.concatenate(sentences))

    def gradient(w: np.ndarray, _: int) -> np.ndarray:
        z = np.bincount(s, w[f], len(everyone)) + w[-1]
        total = np.bincount(owner, np.logaddexp(0, z), len(labels))
        outer = np.where(labels == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), NEGATIVE) / np.where(labels == 1, n1, n0)
        each = outer[owner] / (1 + np.exp(-z))
        g = np.bincount(f, each[s], len(w))
        g[:-1] += 2e-5 * w[:-1]
        g[-1] = each.sum()
        return g

    fitted = adam(gradient, np.append(np.zeros(len(chosen)), -5.0), steps, 0.1)
    weights[chosen] = np.maximum(fitted[:-1], 0)
    return ToxicityModel(weights, float(fitted[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fits on at most `per_class` documents of each value of labels.toxic."""
    model = fit(labelled_sample(docs, labels, "toxic", per_class))
    release_memory()
    return model


SCORED = "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and the offending sentences (code points from start to end, score) of every row of docs (doc_id, text).

    The model has a fixed size. Null and empty texts score 0 and have no sentences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offsets in text_buffers(batch.column(1)):
                doc, start, end, logit = model.sentences(buf, offsets)
                n = len(offsets) - 1
                total = -np.expm1(-np.bincount(doc, np.logaddexp(0, logit), n))
                share = 1 / (1 + np.exp(-logit))
                point = np.cumsum((buf & 0xC0) != 0x80)
                bad = [[] for _ in range(n)]
                for i in np.flatnonzero(share >= OFFENDING).tolist():
                    zero = point[offsets[doc[i]]]
                    bad[doc[i]].append({"start": int(point[start[i]] - zero), "end": int(point[end[i] - 1] - zero) + 1, "score": float(share[i])})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(total), pa.array(bad, kind)], ["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def annotated(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with their columns and score."""
    return with_score(docs, model.scores)
