"""Measures against brute force and on borders."""

import random

from pyspark.sql import functions as F

from tonalframe.operators import measures as M


def test_double_bars_pair_up(spark):
    rng = random.Random(3)
    charts = {c: sorted(rng.randrange(150) for _ in range(rng.randrange(1, 12))) for c in range(40)}
    rows = spark.createDataFrame([(c, i, x) for c, xs in charts.items() for i, x in enumerate(xs)], "chart long, i long, x long")
    got = {}
    for r in M.double_bars_merged(rows, ["chart"], "x", "i").collect():
        got.setdefault(r.chart, []).append(r.x)
    for c, xs in charts.items():
        want = []
        while xs:
            n = 2 if len(xs) > 1 and xs[1] - xs[0] <= 16 else 1
            want.append(sum(xs[:n]) // n)
            xs = xs[n:]
        assert sorted(got[c]) == want


def test_measure_of_a_box(spark):
    measures = spark.createDataFrame([(1, 0, 10, 50), (1, 1, 50, 90), (1, 2, 120, 160)], "row long, m long, x0 long, x1 long")
    boxes = spark.createDataFrame([(1, x) for x in (0, 10, 30, 50, 51, 100, 110, 160, 900)] + [(2, 5)], "row long, x long")
    got = {(r.row, r.x): r.measure for r in M.measure_of(boxes, measures, ["row"], "x", "m").collect()}
    assert got == {(1, 0): 0, (1, 10): 0, (1, 30): 0, (1, 50): 0, (1, 51): 1, (1, 100): 1, (1, 110): 2, (1, 160): 2, (1, 900): 2, (2, 5): 0}


def test_partial_measures(spark):
    rows = [(1, i, w, 4.0, m) for i, (w, m) in enumerate([(40, 1.0), (100, None), (100, None), (100, 4.0), (45, 4.0)])]
    rows += [(2, 0, 30, 4.0, 4.0), (2, 1, 100, 4.0, None), (2, 2, 30, 4.0, None), (3, 0, 0, 4.0, None), (3, 1, 50, 4.0, None)]
    rows = spark.createDataFrame(rows, "page long, i long, w long, beats double, sung double")
    first, last = F.col("i") == 0, F.col("i").isin(2, 4)
    found = M.partial_measures(rows, ["page"], "w", first | last, "beats", "sung", first, F.lit(False))
    got = {(r.page, r.i): r.new_beats for r in found.collect()}
    # A sung pickup takes its own beats, a full last measure stays, a very narrow pickup and a last measure take their share of the bar.
    assert got == {(1, 0): 1.0, (1, 1): 4.0, (1, 2): 4.0, (1, 3): 4.0, (1, 4): 4.0, (2, 0): 1.0, (2, 1): 4.0, (2, 2): 1.0, (3, 0): 4.0, (3, 1): 4.0}


def test_beats_by_pieces(spark):
    beats = {1: [0, 10, 40, 40, 100], 2: [50], 3: [20, 20, 60], 4: []}
    points = spark.createDataFrame([(m, t) for m in beats for t in (-5, 0, 5, 10, 20, 25, 40, 55, 60, 80, 100, 120)], "m long, t long")
    ticks = spark.createDataFrame([(m, t) for m, ts in beats.items() for t in ts], "m long, t long")

    def brute(ts, t):
        if t <= 0 or t >= 100:
            return 0.0 if t <= 0 else 4.0
        for i, (a, b) in enumerate(zip(ts, ts[1:], strict=False)):
            if a <= t <= b and b > a:
                return (i + (t - a) / (b - a)) * 4 / (len(ts) - 1)
        return t / 100 * 4

    got = M.beat_in_measure(points, ticks, ["m"], F.lit(0), F.lit(100), 4.0).collect()
    assert len(got) == 48 and all(abs(r.beat - brute(beats[r.m], r.t)) < 1e-9 for r in got)


def test_nearest_free_notes():
    rng = random.Random(4)
    for _ in range(200):
        notes = sorted(rng.randrange(30) / 2 for _ in range(rng.randrange(12)))
        chars = sorted(rng.randrange(30) / 2 for _ in range(rng.randrange(12)))
        taken, want = set(), []
        for c in chars:
            away, i = min(((abs(t - c), i) for i, t in enumerate(notes) if i not in taken), default=(9, -1))
            want.append(i if away <= 2 else -1)
            taken.add(want[-1])
        assert M.nearest_free(chars, notes) == want
