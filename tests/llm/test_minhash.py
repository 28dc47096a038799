import random
import re

import pytest
from pyspark.sql import Row

from tessera.llm import minhash
from tessera.llm.graph import connected_components
from tessera.llm.minhash import near_duplicates


def _brute(docs, k, percent):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    least = {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in docs}


def _texts(seed, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 40)) for _ in range(r.randint(20, 80))) for _ in range(8)]
    out = [None, "", "  \n", "one", "ONE", "one two", "É x y", "é x y"]
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(["new", "Words", "here"])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 256), (5, 80, 4)])
def test_against_all_pairs(docs_of, monkeypatch, k, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = _texts(k)
    want = _brute(dict(enumerate(texts)), k, percent)
    got = {r["doc_id"]: r for r in near_duplicates(docs_of(texts), k, percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_null_and_repeated_ids(docs_of):
    rows = [Row(None, "a b c d"), Row(None, "a b c d"), Row(4, "a b c d"), Row(4, "p q r s"), Row(9, "p q r s"), Row(7, "a b c d")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates(docs_of(rows), 3, 85).collect())
    assert got == [("4", "4", True), ("4", "4", True), ("7", "4", False), ("9", "4", False), ("None", "None", True), ("None", "None", True)]


def test_empty_table(docs_of):
    assert near_duplicates(docs_of(["x"]).where("false")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
