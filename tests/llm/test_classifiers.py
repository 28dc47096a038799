import random

import numpy as np
import pytest

from tessera.llm import quality, toxicity

BAD = ["idiot", "moron", "scum"]


def _sentence(r, n=12):
    return " ".join("".join(r.choice("bcdlmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def _toxic_rows(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [_sentence(r) for _ in range(r.randint(2, 8))]
        if i % 3 == 0:
            k = r.randrange(len(parts))
            words = parts[k].split()
            words.insert(3, r.choice(BAD) + r.choice(["", "s", "ic"]))
            parts[k] = " ".join(words)
        rows.append((" ".join(parts), int(i % 3 == 0)))
    return rows


def _likelihood(model, text):
    """Noisy-or of plain sentence scores."""
    import re

    clean = 1.0
    for s in re.split(r"[.!?\n]", text):
        if not s.strip():
            continue
        buf = np.frombuffer((s + "\n").encode(), np.uint8)
        feature, starts, _ = toxicity._features(buf)
        z = model.bias + sum(model.weights[f] for f in set(feature.reshape(-1).tolist())) if len(starts) else None
        clean *= 1 if z is None else 1 / (1 + np.exp(z))
    return 1 - clean


def test_toxicity_learns_sentences_from_document_labels(docs_of):
    model = toxicity.fit(_toxic_rows(1))
    held = _toxic_rows(2, 150)
    got = {r["doc_id"]: r for r in toxicity.score(docs_of([t for t, _ in held]), model).collect()}
    right = sum((got[i]["score"] >= 0.3) == bool(y) for i, (_, y) in enumerate(held))
    assert right >= 145
    for i, (text, y) in enumerate(held):
        assert np.isclose(got[i]["score"], _likelihood(model, text), atol=1e-9)
    found = [any(b in text[s["start"] : s["end"]] for s in got[i]["offending"] for b in BAD) for i, (text, y) in enumerate(held) if y]
    assert sum(found) >= 0.95 * len(found)


def test_toxicity_edges(docs_of):
    model = toxicity.fit(_toxic_rows(1, 90))
    texts = [None, "", "...\n\n!", "é idiot ü. " + "plain words here. " * 4000, "same idiot", "same idiot"]
    rows = sorted(toxicity.score(docs_of(texts), model).collect(), key=lambda r: r["doc_id"])
    assert [r["score"] for r in rows[:3]] == [0, 0, 0] and rows[4]["score"] == rows[5]["score"] > 0.3
    first = rows[3]["offending"][0]
    assert texts[3][first["start"] : first["end"]] == "é idiot ü"
    assert toxicity.score(docs_of(["x"]).where("false"), model).count() == 0
    assert toxicity.fit([("a", 0)]).scores(np.frombuffer(b"word\n", np.uint8), np.array([0, 5]))[0] < 0.01
    annotated = toxicity.annotated(docs_of(texts), model).collect()
    assert {r["doc_id"]: (r["text"], r["extra"], r["score"]) for r in annotated} == {r["doc_id"]: (texts[r["doc_id"]], "x", r["score"]) for r in rows}


def _quality_rows(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(_sentence(r, r.randint(5, 40)) for _ in range(r.randint(2, 8)))
        if i % 2:
            words = text.split()
            kind = r.randrange(3)
            text = " ".join(w.upper() + "!!" for w in words) if kind == 0 else " ".join(w + "###" for w in words) if kind == 1 else " ".join(w for w in words[:5] for _ in range(15))
        rows.append((text, 1 - i % 2))
    return rows


def test_quality_on_held_out_documents(docs_of):
    model = quality.fit(_quality_rows(1))
    held = _quality_rows(2, 150)
    got = {r["doc_id"]: r for r in quality.score(docs_of([t for t, _ in held]), model).collect()}
    assert sum((got[i]["score"] >= 0.3) == bool(y) for i, (_, y) in enumerate(held)) >= 145
    assert all(0 <= r["best_passage"] < r["passages"] for r in got.values())


def test_quality_gradient(monkeypatch):
    seen = {}

    def probe(gradient, start, steps, rate):
        seen.update(g=gradient, w=start)
        return start

    monkeypatch.setattr(quality, "adam", probe)
    rows = _quality_rows(3, 24)
    model = quality.fit(rows)
    docs, parts = [], []
    for first, buf, offsets in quality.text_buffers(quality.pa.array([t for t, _ in rows])):
        d, x = quality.passages(buf, offsets)
        docs.append(d + first)
        parts.append(x)
    doc, x = np.concatenate(docs), (np.concatenate(parts) - model.mean) / model.scale
    y = np.array([v for _, v in rows], float)

    def loss(w):
        s = quality.QualityModel(model.mean, model.scale, w)._forward(doc, x, len(y))[-1]
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        return -(share * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() + 0.5e-5 * (w @ w)

    g = seen["g"](seen["w"], 1)
    for k in range(0, len(g), 37):
        step = np.zeros_like(g)
        step[k] = 1e-5
        assert (loss(seen["w"] + step) - loss(seen["w"] - step)) / 2e-5 == pytest.approx(g[k], abs=1e-6)


def test_quality_edges(docs_of):
    model = quality.fit(_quality_rows(1, 60))
    texts = [None, "", " \n ", "word", "same here", "same here", "very long " * 30_000]
    rows = sorted(quality.score(docs_of(texts), model).collect(), key=lambda r: r["doc_id"])
    assert [(r["score"], r["passages"], r["best_passage"]) for r in rows[:3]] == [(0, 0, -1)] * 3
    assert rows[4]["score"] == rows[5]["score"] and rows[6]["passages"] == -(-60_000 // quality.PASSAGE)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs_of(["x"]).where("false"), model).count() == 0
