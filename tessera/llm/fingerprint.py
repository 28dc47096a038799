"""Document fingerprints: a homomorphic hash of a text's multiset of paragraphs.

A paragraph (a run without line feeds) is hashed to a wide vector; a fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo a power of two. So it doesn't depend on the order of
paragraphs, and paragraphs can be added or taken away by adding or subtracting their vectors.
The vector has two parts:

* LANES numbers modulo 2**64 hashed from the paragraph's bytes: equal sums mean equal multisets;
* WIDTH numbers modulo 2**16 that count the paragraph's pairs of neighbouring words with signs: the
  squared length of a difference estimates how many pairs two texts don't share, which gives likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, text_buffers, word_hashes

LANES, WIDTH = 8, 256
#: Rows in a group of neighbouring documents.
PER_GROUP = 1024

_FEED = np.zeros(256, bool)
_FEED[10] = True
_SALT = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_EMPTY = mix(_SALT)
_FIRST, _SECOND = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def vectors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprint of each text: uint64 (n, LANES) and uint16 (n, WIDTH)."""
    n = len(offsets) - 1
    paragraph, starts, _ = word_hashes(buf, lower=False, between=_FEED)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.searchsorted(doc, np.arange(n + 1))
    exact = np.zeros((n, LANES), np.uint64)
    for lane in range(LANES):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(paragraph + _SALT[lane]))])
        exact[:, lane] = sums[cuts[1:]] - sums[cuts[:-1]]
    feeds = np.concatenate([[0], np.cumsum(buf == 10)])
    blank = feeds[offsets[1:]] - feeds[offsets[:-1]] - np.diff(cuts)  # each text ends in a line feed of its own
    exact += blank.astype(np.uint64)[:, None] * _EMPTY
    word, starts, _ = word_hashes(buf, lower=False)
    if not len(word):
        return exact, np.zeros((n, WIDTH), np.uint16)
    line = feeds[starts]
    joined = line[1:] == line[:-1]
    alone = np.concatenate([[True], ~joined]) & np.concatenate([~joined, [True]])
    pair = mix(mix(word[:-1] + _FIRST) * np.uint64(3) + word[1:])[joined]
    feature = np.concatenate([pair, mix(word[alone] + _SECOND)])
    owner = np.searchsorted(offsets, np.concatenate([starts[:-1][joined], starts[alone]]), side="right") - 1
    place = owner * WIDTH + (feature & np.uint64(WIDTH - 1)).astype(np.int64)
    sign = ((feature >> np.uint64(32)) & np.uint64(1)).astype(np.float64) * 2 - 1
    counts = np.bincount(place, sign, n * WIDTH).astype(np.int64).reshape(n, WIDTH)
    return exact, counts.astype(np.uint16)


def add(a: tuple, b: tuple) -> tuple:
    """The fingerprint of both texts' paragraphs together."""
    return a[0] + b[0], a[1] + b[1]


def remove(a: tuple, b: tuple) -> tuple:
    """The fingerprint of a without the paragraphs of b."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """1 for equal fingerprints, else an estimate of twice the shared word pairs over all of both, from 0 to 1."""
    x, y = a[1].view(np.int16).astype(np.float64), b[1].view(np.int16).astype(np.float64)
    apart = (a[1] - b[1]).view(np.int16).astype(np.float64)
    whole = (x * x).sum(axis=-1) + (y * y).sum(axis=-1)
    value = np.clip(1 - (apart * apart).sum(axis=-1) / np.maximum(whole, 1), 0, 1) * (whole > 0)
    return np.where((a[0] == b[0]).all(axis=-1) & (a[1] == b[1]).all(axis=-1), 1.0, value)


def encoded(fingerprint: tuple) -> list[str]:
    """Text form of each row."""
    return [base64.b64encode(e.tobytes() + s.tobytes()).decode() for e, s in zip(*fingerprint, strict=True)]


def decoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(base64.b64decode(t) for t in texts), np.uint8).reshape(len(texts), LANES * 8 + WIDTH * 2)
    return raw[:, : LANES * 8].copy().view("<u8"), raw[:, LANES * 8 :].copy().view("<u2")


def of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [vectors(buf, offsets) for _, buf, offsets in text_buffers(texts)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs (doc_id, text); null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoded(of_texts(batch.column(1))))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _groups(docs: DataFrame, per_group: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest doc_id of each run of about `per_group` documents, ascending.

    From the ids alone; one pair of numbers for each run comes to the driver. A null id counts as the least.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    parts = max(1, -(-ids.count() // per_group))
    if parts == 1:
        runs = ids.agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low is not null")
    else:
        runs = ids.repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    bounds = sorted((r["low"], r["high"]) for r in runs.collect())
    return np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, per_group: int = PER_GROUP) -> DataFrame:
    """Fingerprints every row of docs (doc_id, text) and its edited text, whose last third comes from the next document.

    The next document is the one with the next lower doc_id, after the lowest the highest; rows that repeat
    a doc_id follow each other by text, and a null doc_id stands after all others. Documents are grouped in runs of
    neighbouring ids, each with a copy of the first document of the run that follows. Null is an empty text.
    """
    lows, highs = _groups(docs, per_group)
    last = len(lows) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pc.fill_null(batch.column(0), -(2**63)).to_numpy()
            run = np.searchsorted(lows, key, side="right") - 1
            heads = np.flatnonzero(highs[run] == key)
            rows = pa.array(np.concatenate([np.arange(len(key)), heads]))
            to = np.concatenate([run, np.where(run[heads] == last, 0, run[heads] + 1)])
            kind = np.concatenate([np.zeros(len(key)), np.ones(len(heads))])
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(kind.astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], ["run", "copy", "doc_id", "text"])

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.append_column("key", pc.fill_null(rows.column("doc_id"), -(2**63)))
        rows = rows.append_column("whole", pc.fill_null(rows.column("text"), ""))
        rows = rows.sort_by([("copy", "ascending"), ("key", "descending"), ("whole", "ascending")])
        n = pc.sum(pc.equal(rows.column("copy"), 0)).as_py()
        rows = rows.slice(0, n + 1)
        texts = rows.column("whole").to_pylist()
        changed = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:], strict=False)]
        own, new = of_texts(rows.column("whole").combine_chunks()), of_texts(pa.array(changed))
        mine, after = (own[0][:n], own[1][:n]), (own[0][1:], own[1][1:])
        return pa.table({
            "doc_id": rows.column("doc_id").slice(0, n),
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": encoded(mine),
            "edited_fingerprint": encoded(new),
            "near_edited": likeness(mine, new),
            "near_next": likeness(mine, after),
        })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(place, "run long, copy int, doc_id long, text string").groupBy("run").applyInArrow(work, EDITED)
