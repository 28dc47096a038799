"""How much of a table a Python worker holds at a time."""

import numpy as np
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.common import BATCH_BYTES, SCORED_AT_ONCE, small_batches, with_score

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batch_bytes(spark):
    yield lambda: int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    spark.conf.unset(CONF)


def test_scores_are_worked_out_for_a_bounded_run_of_texts(docs_of, batch_bytes):
    docs = docs_of(["x" * 10_000] * 300 + [None, ""]).coalesce(1)
    rows = with_score(docs, lambda buf, offsets: np.full(len(offsets) - 1, float(len(buf)))).collect()
    assert len(rows) == 302 and max(r["score"] for r in rows) <= SCORED_AT_ONCE + 10_001
    assert batch_bytes() == BATCH_BYTES


def test_a_smaller_bound_stays(spark, batch_bytes):
    spark.conf.set(CONF, "1000")
    small_batches(spark)
    assert batch_bytes() == 1000


def test_training_works_on_bounded_runs_and_gives_memory_back(docs_of, spark, monkeypatch):
    sizes, released, passages = [], [], quality.passages
    monkeypatch.setattr(quality, "passages", lambda buf, offsets: (sizes.append(len(buf)), passages(buf, offsets))[1])
    for module in (quality, toxicity):
        monkeypatch.setattr(module, "release_memory", lambda: released.append(1))
    docs = docs_of([f"some words of text {i} {'vile awful' if i % 2 else 'kind'} " * 500 for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    quality.train(docs, labels)
    toxicity.train(docs, labels)
    assert len(sizes) > 1 and max(sizes) <= SCORED_AT_ONCE + 12_000 and len(released) == 2
