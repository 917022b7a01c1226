"""The corpus pipeline, stage by stage, against brute force on a small table."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from funnelkit.llm.shared import written  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows, the first entry being the input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "test"))
    return out


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.orderBy("doc_id").collect()]


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality_stage(stages):
    kept = {i for i, _ in texts(stages[1])}
    for doc_id, text in texts(stages[0]):
        if brute.quality(text)[-1]:
            assert doc_id not in kept
    assert len(kept) > 0.8 * stages[0].count()


def test_line_stage(stages):
    before = texts(stages[1])
    wanted = brute.line_dedup(before)
    assert texts(stages[2]) == [(i, wanted[i, t][0]) for i, t in before]
    changed = {i for i, t in before if wanted[i, t][2]}
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.doc_id in changed)


def test_simhash_stage(stages):
    found = brute.simhash(texts(stages[2]))
    assert [i for i, _ in texts(stages[3])] == sorted({c for _, _, c in found})


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in brute.decontamination(texts(stages[3]), items) if not r[5]]
    assert [i for i, _ in texts(stages[4])] == clean


def test_packing_stage(spark, stages):
    kept = {i for i, _ in texts(stages[4])}
    assert {r.doc_id for r in stages[5].collect()} == kept
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stages[5].collect()))
