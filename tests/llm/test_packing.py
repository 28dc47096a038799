import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import best_fit_decreasing, lower_bound, pack, packed_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def _least_bins(items, capacity):
    best = [len(items)]

    def go(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins) if b + rest[0] <= capacity}.values()):
            go(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(items, reverse=True), [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bound_never_exceeds_the_optimum(seed):
    r = random.Random(seed)
    items = np.array(sorted((r.randint(1, 24) for _ in range(9)), reverse=True))
    bins, offsets, fills = best_fit_decreasing(items, 24)
    assert lower_bound(items, 24) <= _least_bins(items.tolist(), 24) <= len(fills)
    assert fills.max() <= 24 and fills.sum() == items.sum()


def _check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(docs_of):
    texts = [None, "", "hello world", "Hello, world! " * 900, "é́ \x1c x\x01y <|endoftext|>", "a " * 2047, "a " * 2048, "dup", "dup"]
    rows = packed_documents(docs_of(texts), PATH).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r["length"] for r in own] == [len(ids[a : a + 2048]) for a in range(0, len(ids), 2048)]
        assert [r["start"] for r in own] == [2048 * k for k in range(len(own))]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
    _check(rows, 2048)


def test_exchange_between_partitions_keeps_every_row(spark):
    r = random.Random(5)
    items = [(i, 0, 0, r.randint(1, 100), 7) for i in range(900)] + [(1, 0, 0, 50, 7)] * 3 + [(None, 0, 0, 40, 7)]
    df = spark.createDataFrame(items, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack(df, 100, per_partition=300).collect()
    assert len(rows) == len(items)
    assert _check(rows, 100) <= lower_bound(np.array([x[3] for x in items]), 100) + 3


def test_empty_table(docs_of, spark):
    assert packed_documents(docs_of(["x"]).where("false"), PATH).count() == 0
