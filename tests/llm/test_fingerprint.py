import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from tessera.llm import fingerprint as fp


def _print(*texts):
    return fp.of_texts(pa.array(list(texts)))


def test_order_does_not_matter_but_content_does():
    a, b, c, d, e = (fp.encoded(_print(t))[0] for t in ("x y\nz z\nx y", "z z\nx y\nx y", "x y\nz z", "x y\n\nz z", "X y\nz z"))
    assert a == b and len({a, c, d, e}) == 4
    assert fp.encoded(_print("")) == fp.encoded(_print(""))


def test_paragraphs_are_added_and_taken_away():
    whole, part, rest = _print("one two three\nfour five\nsix"), _print("four five"), _print("one two three\nsix")
    joined = fp.add(part, rest)
    assert fp.encoded(joined) == fp.encoded(whole)
    assert fp.encoded(fp.remove(whole, part)) == fp.encoded(rest)
    assert fp.encoded(fp.decoded(fp.encoded(whole))) == fp.encoded(whole)


def test_likeness_follows_shared_word_pairs():
    r = random.Random(2)
    words = [f"w{r.randint(0, 5000)}" for _ in range(900)]
    text = " ".join(words)
    for share in (0.0, 0.3, 0.6, 0.9):
        cut = int(900 * share)
        other = " ".join(words[:cut] + [f"v{r.randint(0, 5000)}" for _ in range(900 - cut)])
        assert abs(float(fp.likeness(_print(text), _print(other))[0]) - share) < 0.15
    assert fp.likeness(_print(text), _print(text))[0] == 1 and fp.likeness(_print(""), _print("a"))[0] == 0


@pytest.mark.parametrize("per_group", [1000, 5])
def test_edited_against_plain_version(docs_of, per_group):
    r = random.Random(4)
    texts = ["".join(r.choice("ab é\n😀 xyz") for _ in range(r.randint(0, 80))) for _ in range(40)] + [None, "", "same", "same"]
    rows = [Row(i * 3, t) for i, t in enumerate(texts)] + [Row(None, "without id"), Row(6, "again"), Row(6, "b second")]
    got = fp.edited(docs_of(rows).repartition(5), per_group).collect()
    order = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)
    order.sort(key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = _print(t), _print(new), _print(after)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.encoded(a)[0], fp.encoded(b)[0], round(float(fp.likeness(a, b)[0]), 9), round(float(fp.likeness(a, c)[0]), 9)))
    found = [(-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(found) == sorted(want)


def test_tables_of_one_and_none(docs_of):
    one = fp.edited(docs_of(["abcdef"])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fp.edited(docs_of(["x"]).where("false")).count() == 0
    assert fp.fingerprints(docs_of([None, ""])).select("fingerprint").distinct().count() == 1
    assert np.isclose(one[0]["near_next"], 1)
