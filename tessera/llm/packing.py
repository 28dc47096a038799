"""Best-fit packing of token sequences, certified by dual-feasible lower bounds.

Documents are tokenised once into pieces of at most the capacity. Pieces are dealt to partitions
of bounded size, in turn by length, so that all have the same mixture of lengths; each partition packs its pieces by best-fit decreasing and compares its bin count
with the largest of a family of dual-feasible-function bounds. A partition that meets its bound is
certified and final (but for its emptiest bin, whose slack only other partitions can use). One with a
gap keeps its full bins and exchanges all other documents: they are dealt anew among fewer partitions
and packed again, until one partition holds what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, small_batches
from tessera.llm.words import word_tokenizer

CAPACITY = 2048
PER_PARTITION = 8192
ROUNDS = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of several bounds on the number of bins that any packing needs.

    Each dual-feasible function maps lengths so that whatever fits one bin still sums to at most 1:
    thresholds (long items count as a whole bin, short ones as nothing) and roundings
    floor((k+1)x)/k, which leave x as it is where (k+1)x is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    number, mass = np.cumsum(counts), np.cumsum(counts * size)
    least = np.arange(0, capacity // 2 + 1)
    whole = number[-1] - number[capacity - least]
    middle = mass[capacity - least] - np.where(least > 0, mass[np.maximum(least - 1, 0)], 0)
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in 1/(k * capacity) of a bin
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item of a list in descending order, and the fill of every bin.

    Bins wait in stacks by free space; the fullest bin that still has room is the lowest set bit
    of an integer with a bit for each stack in use.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fills = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        if fit := used >> n:
            space = n + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                used ^= 1 << space
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        rest = space - n
        if rest:
            free[rest].append(b)
            used |= 1 << rest
    return bins, offsets, np.array(fills, np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: its ids (and a closing id 0) cut every `capacity` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer)
        for batch in batches:
            out = ([], [], [], [], [])
            for first, texts in _runs(batch.column(1)):
                for doc, data in zip(batch.column(0).slice(first, len(texts)).to_pylist(), encode(texts), strict=True):
                    data += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _runs(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about `most` characters, small enough for a processor's own cache; null is empty."""
    texts, first, size = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if texts and size + len(text) > most:
            yield first, texts
            texts, first, size = [], i, 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def _dealing(k: int, parts: int):
    """Adds the partition that a piece goes to: within each task, in turn by length."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.lexsort((batch.column("ids_crc32").to_numpy(), batch.column("length").to_numpy()))
            start = zlib.crc32(f"{k} {TaskContext.get().partitionId()}".encode())
            part = np.empty(len(order), np.int32)
            part[order] = (start + np.arange(len(order))) % parts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return deal


def _placing(k: int, last: bool, capacity: int):
    """Packs one partition of round k; sequence_id is -1 where the document is to be exchanged."""

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        keep = np.ones(len(fills), bool)
        if not last:
            if len(fills) > lower_bound(lengths, capacity):
                keep = fills == capacity
            elif fills.min() < capacity:
                keep[fills.argmin()] = False
        number = np.where(keep[bins], (k << 56) + (int(key[0]) << 24) + bins, -1)
        return rows.drop(columns="part").assign(sequence_id=number, offset=offsets)

    return place


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces().

    Repeated rows are packed each on its own, ties are ordered by (doc_id, piece, ids_crc32), an empty
    table gives an empty result. Every round works on groups of about `per_partition` pieces; rows
    leave with a place, or without one to be dealt anew.
    """
    waiting, done = checkpointed(items), []
    for k in range(rounds):
        n = waiting.count()
        parts = max(1, -(-n // per_partition))
        last = parts == 1 or k == rounds - 1

        placed = waiting.mapInArrow(_dealing(k, parts), f"{PIECES}, part int").repartitionByRange(parts, "part").groupBy("part").applyInPandas(_placing(k, last, capacity), PACKED)
        if last:
            done.append(placed)
            break
        placed = checkpointed(placed)
        done.append(placed.where("sequence_id >= 0"))
        waiting = placed.where("sequence_id < 0").select(*items.columns)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents (doc_id, text) into as few sequences of `capacity` tokens as it can.

    Null or empty texts are a single id 0. A null doc_id is kept as it is.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)
