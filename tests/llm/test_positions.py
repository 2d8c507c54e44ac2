"""Training positions against the schedules, integrated numerically."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import mixing


@pytest.mark.parametrize("schedules", [mixing.SCHEDULES, ((0.0, 1.0, 0.0, 2.0), (1.0, 0.0), (2.0, 2.0, 1.0))])
def test_positions_invert_the_schedules(spark, schedules):
    rows = [(k, f"s{k % 4}", 1 + k * 7 % 23) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.curriculum(docs, 400, schedules=schedules, rows_per_bucket=16).collect()
    times = np.linspace(0, 1, 200_001)
    for k, source in enumerate(sorted({r["source"] for r in got})):
        knots = schedules[k % len(schedules)]
        weight = np.interp(times, np.linspace(0, 1, len(knots)), knots)
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        mine = [r for r in got if r["source"] == source]
        demand *= mine[0]["target"] / demand[-1]
        takes = sorted((p, r["size"]) for r in mine for p in r["positions"])
        assert len(takes) > 40
        # Readings in the order of their positions: the middle word of each is what is demanded by then.
        before = 0
        for position, size in takes:
            assert abs(np.interp(position, times, demand) - (before + size / 2)) < 0.02
            before += size
        assert abs(before - mine[0]["target"]) <= 12
        assert all(0 <= p <= 1 for p, _ in takes)


def test_training_order(spark):
    docs = spark.createDataFrame([(k, f"word {'x ' * (k % 9)}", "en", f"s{k % 3}") for k in range(300)], "doc_id long, text string, lang string, source string")
    sized = mixing.with_size(docs)
    ordered = mixing.in_training_order(mixing.curriculum(sized, 300, rows_per_bucket=8)).collect()
    positions = [r["position"] for r in ordered]
    assert positions == sorted(positions) and len(positions) > 300
    assert [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()] == [r["doc_id"] for r in ordered]


def test_op7_reads_its_digest_from_the_mix(spark, sf_dir, monkeypatch):
    """What is taken comes from the stored readings in training order: without some of them it is less."""
    from tidemark.llm import mixing

    whole = {r["doc_id"]: r["taken"] for r in mixing.op7_mixing(spark, sf_dir).select("doc_id", "taken").collect()}
    ordered = mixing.in_training_order
    monkeypatch.setattr(mixing, "in_training_order", lambda mixed: ordered(mixed).where("doc_id % 2 = 0"))
    part = {r["doc_id"]: r["taken"] for r in mixing.op7_mixing(spark, sf_dir).select("doc_id", "taken").collect()}
    assert part == {k: 0 if k % 2 else v for k, v in whole.items()} and sum(part.values()) < sum(whole.values())
