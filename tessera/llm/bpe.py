"""Byte-level BPE by replaying merges over a corpus of distinct words, and its inverse.

Texts are cut at white space into chunks; each new distinct chunk of a batch is split by the
tokenizer's pattern, and its distinct matches form the corpus. One array holds the symbols of all
of them. An inverted index leads from each pair's rank to the positions where it stands; ranks are
applied from the lowest, at all their positions at once, and only the touched neighbours get new
index entries.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that are gathered before their new words are replayed together.
BATCH_CHARS = 4_000_000
#: Distinct chunks whose ids a worker remembers; beyond it those go that the last batches did not have.
CACHED = 150_000
_NONE = np.int32(2**31 - 1)
_WINDOW = 1024
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: As coarse a split as no match of the pattern crosses.
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes lists of words by the ranks of byte strings, exactly as merging the lowest pair of each word would."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._fill(np.array(keys, np.uint64), np.array(values, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, _NONE, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slots[left]
            empty = self.keys[s] == np.uint64(2**64 - 1)
            self.keys[s[empty]] = keys[left[empty]]
            won = self.keys[s] == keys[left]
            self.values[s[won]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], _NONE)
        left = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            found = self.keys[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def one(self, word: bytes) -> list[int]:
        """A single word, pair by pair."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(words), np.uint8)
        if not len(data):
            return [b""] * len(words)
        ends = np.cumsum([len(w) for w in words])
        symbol = self.first[data]
        n = len(symbol)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends[ends > 0] - 1] = -1
        starts = np.concatenate([[0], ends[:-1]])
        before[starts[starts < n]] = -1
        rank = np.full(n, _NONE, np.int32)
        at = np.flatnonzero(after >= 0).astype(np.int32)
        rank[at] = self.pair_ranks(symbol[at], symbol[at + 1])
        at = at[rank[at] < _NONE]
        log_rank, log_at, odd = [rank[at]], [at], []
        while log_at:
            ranks, places = np.concatenate(log_rank), np.concatenate(log_at)
            live = rank[places] == ranks
            ranks, places = ranks[live], places[live]
            if not len(ranks):
                break
            top = int(ranks.min()) // _WINDOW * _WINDOW + _WINDOW
            now = ranks < top
            log_rank, log_at = [ranks[~now]], [places[~now]]
            ranks, places = ranks[now], places[now]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            index = {r: [p] for r, p in zip(ranks[cuts].tolist(), np.split(places, cuts[1:]), strict=True)}
            heap = list(index)
            heapq.heapify(heap)
            while heap:
                r = heapq.heappop(heap)
                found = index.pop(r)
                p = found[0] if len(found) == 1 else np.concatenate(found)
                p = p[rank[p] == r]
                if not len(p):
                    continue
                right = after[p]
                if (rank[right] == r).any():  # occurrences that overlap: the leftmost of a run goes first
                    p = np.unique(p)
                    chained = np.concatenate([[False], after[p[:-1]] == p[1:]])
                    run = np.arange(len(p)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
                    p = p[run % 2 == 0]
                    right = after[p]
                beyond = after[right]
                symbol[p] = r
                rank[right] = _NONE
                symbol[right] = -1
                after[p] = beyond
                has = beyond >= 0
                before[beyond[has]] = p[has]
                left = before[p]
                touched = np.concatenate([p, left[left >= 0]])
                follow = after[touched]
                new = np.full(len(touched), _NONE, np.int32)
                has = follow >= 0
                new[has] = self.pair_ranks(symbol[touched[has]], symbol[follow[has]])
                rank[touched] = new
                some = new < _NONE
                if not some.any():
                    continue
                new, touched = new[some], touched[some]
                if new.min() < r:
                    odd.append(touched[new < r])
                soon = new < top
                if soon.any():
                    for value, place in zip(new[soon].tolist(), touched[soon], strict=True):
                        if value in index:
                            index[value].append(place[None])
                        else:
                            index[value] = [place[None]]
                            heapq.heappush(heap, value)
                    new, touched = new[~soon], touched[~soon]
                if len(new):
                    log_rank.append(new)
                    log_at.append(touched)
        alive = np.flatnonzero(symbol >= 0)
        cuts = np.searchsorted(alive, ends)
        data = symbol[alive].astype("<u4").tobytes()
        out = [data[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        if odd:  # a merge gave rise to an earlier one: such words are merged one by one, in their own order
            for w in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist():
                out[w] = np.array(self.one(words[w]), "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def _replay(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids; keeps the ids of chunks between calls."""
    import regex

    replay, fine = _replay(path), regex.compile(pattern)
    recent: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def chunks(text: str) -> list[str]:
        return fine.findall(text) if _ODD_SPACE.search(text) else _COARSE.findall(text)

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal recent, older
        seen: set[str] = set()  # texts are cut twice, since the chunks of a whole batch would take much more memory
        for text in texts:
            seen.update(chunks(text))
        if len(recent) > CACHED:
            recent, older = {}, recent
        seen.difference_update(recent)
        recent.update((c, older[c]) for c in seen if c in older)
        seen.difference_update(older)
        words = list({w for c in seen for w in fine.findall(c)})
        ids = dict(zip(words, replay.encode([w.encode() for w in words]), strict=True))
        for chunk in seen:
            recent[chunk] = b"".join([ids[w] for w in fine.findall(chunk)])
        return [b"".join([recent[c] for c in chunks(text)]) for text in texts]

    return encode


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _decoded(ids: pa.Array, token: dict[int, bytes]) -> pa.Array:
    return pa.array([b"".join([token[i] for i in np.frombuffer(x.as_py() or b"", "<u4").tolist()]) for x in ids], pa.binary())


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, batch_chars: int = BATCH_CHARS, decode: bool = False) -> DataFrame:
    """doc_id and ids, the little-endian unsigned 32-bit ids of the whole text, for every row of docs (doc_id, text).

    Null or empty texts have no ids. Rows are taken in runs of about `batch_chars` characters, which bounds memory.
    With decode there is also decoded, as of bpe_decode, made from the ids by the same worker.
    """
    schema = "doc_id long, ids binary" + ", decoded binary" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(ranks, pattern)
        keys, texts, chars = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = pa.array(encode(texts), pa.binary())
            columns = [pa.array(keys, pa.int64()), ids] + [_decoded(ids, _tokens(ranks))] * decode
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= batch_chars:
                    yield flush()
                    keys, texts, chars = [], [], 0
        if keys:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds decoded, the bytes that the ids stand for, to rows of doc_id and ids. Unknown ids raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(batch.column(1), _tokens(ranks))], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
