"""Blocking by cells against plain Python: distinct pairs without a comparison, and tasks as many as the pairs need."""

import random

import pytest
from loomgraph.operators import relational as R
from loomgraph.operators import resolve as X
from pyspark.sql import functions as F

rng = random.Random(7)
ROWS = {
    "one row an id": [(i, rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(9), i % 5) for i in range(60)],
    "repeated ids": [(rng.randrange(25), rng.choice("abcd"), rng.choice([None, 1, 2, 3, 4]), i) for i in range(50)] + [(None, "a", 1, 0)],
    "empty": [],
}


def pairs(rows, *keys):
    return {(r[0], s[0]) for r in rows for s in rows if r[0] is not None and s[0] is not None and r[0] < s[0] and any(r[k] is not None and r[k] == s[k] for k in keys)}


@pytest.mark.parametrize("kind", ROWS)
def test_pairs_once(spark, kind, monkeypatch):
    monkeypatch.setattr(R, "CELL", 7)
    rows = ROWS[kind]
    df = spark.createDataFrame(rows, "id long, u string, v long, z long")
    got = [(r.a, r.b) for r in R.block_pairs(df, F.col("u")).collect()]
    assert set(got) == pairs(rows, 1) and len(got) == len(set(got))
    got = [(r.a, r.b) for r in X.candidate_pairs(df, {"u": F.col("u"), "v": F.col("v")}).collect()]
    assert set(got) == pairs(rows, 1, 2) and len(got) == len(set(got))
    got = sorted((r.a, r.b, r.x.z, r.y.z) for r in R.met_in_blocks(df, [F.col("u"), F.col("v")], "id", ["z"]).collect())
    assert got == sorted((a, b, r[3], s[3]) for a, b in pairs(rows, 1, 2) for r in rows if r[0] == a for s in rows if s[0] == b)


def test_tasks_by_pairs(spark, monkeypatch):
    """A block of few bytes and many pairs is made by many tasks, and no pair is compared with others (before: one task, a distinct)."""
    monkeypatch.setattr(R, "CELL", 20)
    monkeypatch.setattr(R, "CELL_PAIRS", 2_000)
    got = R.block_pairs(spark.range(200).select("id", F.lit(1).alias("k")), F.col("k"))
    assert got.rdd.getNumPartitions() >= 10 and got.count() == 200 * 199 // 2
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_threshold_sweep_of_nothing(spark):
    scored = spark.createDataFrame([(0.5, True), (0.9, False), (0.2, True)], "score double, same boolean")
    got = {r.threshold: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in X.threshold_sweep(scored, [0.3, 0.95]).collect()}
    assert got == {0.3: (1, 1, 1, 0.5, 0.5), 0.95: (0, 0, 2, None, 0.0)}
    assert X.threshold_sweep(scored.limit(0), [0.3]).count() == 0
