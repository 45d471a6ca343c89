"""Ordered operators over stretches of a key against one pass over the whole key."""

import random

import pytest
from pyspark.sql import functions as F

from tonalframe.operators import intervals as I
from tonalframe.operators import windows as W


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(k, t, rng.choice([None, None, 1, 5, 9, 3])) for k in range(5) for t in sorted(rng.sample(range(200), rng.choice([1, 4, 40])))]


@pytest.mark.parametrize("width", [1, 7, 60, 1000])
@pytest.mark.parametrize("own", [True, False])
def test_by_parts(spark, rows, width, own):
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(4)
    part = F.floor(F.col("t") / width)
    for kind, use in (("last", lambda x: x[-1] if x else None), ("max", lambda x: max(x, default=None)), ("sum", sum)):
        got = {(r.k, r.t): r.out for r in W.by_parts(df, ["k"], ["t"], part, kind, F.col("v"), "out", own).collect()}
        assert got == {(k, t): use([v for a, b, v in rows if a == k and (b <= t if own else b < t) and v is not None]) for k, t, _ in rows}


@pytest.mark.parametrize("width", [5, 1000])
def test_what_rests_on_it(spark, rows, width):
    df, part = spark.createDataFrame(rows, "k long, t long, v long").repartition(4), F.floor(F.col("t") / width)
    clusters = {(r.k, r["first"], r["last"], r.n) for r in W.gap_clusters(df, ["k"], "t", 4, "t", part).collect()}
    want, state, gate, top, kept = [], {}, {}, {}, set()
    for k, t, v in rows:
        if state.get(k) is not None and t - state[k][2] <= 4:
            state[k][2:] = [t, state[k][3] + 1]
        else:
            state[k] = [k, t, t, 1]
            want.append(state[k])
        gate[k, t] = True if v is not None and v > 4 else False if v is not None and v < 2 else gate.get((k, top.get(("at", k))), False)
        top["at", k] = t
    assert clusters == {tuple(x) for x in want}
    got = {(r.k, r.t): r.open for r in W.hysteresis(df, ["k"], ["t"], F.col("v") > 4, F.col("v") < 2, part).collect()}
    assert got == gate
    high = {}
    for k, t, v in rows:
        if v is not None and (k not in high or v >= high[k]):
            kept.add((k, t))
            high[k] = v
    assert {(r.k, r.t) for r in W.monotonic(df.where("v is not null"), ["k"], ["t"], "v", part).collect()} == kept
    points = df.select("k", F.col("t").alias("id"), "t")
    states = df.where("v is not null").select("k", F.col("t").alias("id"), "t", "v")
    found = {(r.k, r.t): r.v for r in I.as_of(points, states, ["k"], "t", "v", "id", width).collect()}
    assert found == {(k, t): next((v for a, b, v in reversed(rows) if a == k and b <= t and v is not None), None) for k, t, _ in rows}
