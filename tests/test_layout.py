"""Orientation of stacked chords, names, layout and fingers against plain versions and fixed cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalframe.functions import fingering as H
from tonalframe.functions import spelling as N
from tonalframe.functions.theory import DEFAULT_KEYS
from tonalframe.operators import layout as L
from tonalframe.operators import orientation as O


def plain_orientation(bars):
    """bars: (raw, melody) in order."""
    quality = lambda t: re.fullmatch(r"[b#]?[1-7][b#]?(.*)", t)[1] not in ("", "maj", "Maj")
    degree = lambda t: int(re.match(r"[b#]?([1-7])", t)[1])
    proofs, scores = {"top": 0, "bottom": 0}, {"top": 0.0, "bottom": 0.0}
    lines = {"top": [], "bottom": []}
    for raw, melody in bars:
        extended = bool(re.search(r"/(b9|#9|#11|9|11|13)", raw))
        parts = [raw] if extended else raw.split("/")
        sung = re.search("[1-7]", melody or "")
        if len(parts) == 2:
            top_q, low_q = map(quality, parts)
            proofs["top"] += low_q and not top_q
            proofs["bottom"] += top_q and not low_q
        for reading in scores:
            if len(parts) == 1:
                bass = parts[0]
            else:
                bass = parts[0] if low_q and not top_q else parts[1] if top_q and not low_q else parts[reading == "bottom"]
                if sung:
                    chord = parts[reading == "top"]
                    d, rest = degree(chord), re.fullmatch(r"[b#]?[1-7][b#]?(.*)", chord)[1]
                    steps = [0, 2, 4] + [6] * ("7" in rest) + [1] * ("9" in rest) + [3] * ("11" in rest or "sus" in rest)
                    scores[reading] += 3 if int(sung[0]) in {(d - 1 + k) % 7 + 1 for k in steps} else -1
            lines[reading].append(degree(bass))
    for reading, line in lines.items():
        streak = 0
        for a, b in zip(line, line[1:], strict=False):
            down = (a - b) % 7 == 1
            streak = streak + 1 if down else 0
            scores[reading] += (2 + 1.5 * (streak > 1)) if down else 1.5 if (b - a) % 7 == 1 else 0.5 if a == b else -1
    gap = round(scores["top"] - scores["bottom"], 2)
    if (proofs["top"] > 0) != (proofs["bottom"] > 0):
        return ("top_is_bass" if proofs["top"] else "bottom_is_bass"), max(abs(gap), 10.0 * sum(proofs.values()))
    return ("top_is_bass" if gap > 0 else "bottom_is_bass"), abs(gap)


def test_stacked_orientation(spark):
    rng = random.Random(12)
    charts = {}
    for chart in range(60):
        kinds = ["", "", ""] if chart % 3 else ["", "m", "7"]
        token = lambda kinds=kinds: f"{rng.randint(1, 7)}{rng.choice(kinds)}"
        charts[chart] = [(rng.choice([f"{token()}/{token()}", f"{token()}/{token()}", token(), f"{token()}/9"]), rng.choice([None, "", "0 3 1", "5.", "- 7"])) for _ in range(rng.randint(1, 14))]
    charts[60] = [(f"{a}/{b}", None) for a, b in [(1, 3), (7, 3), (6, 3), (5, 3)]]  # the upper parts walk down
    charts[61] = [("1", None), ("4", None)]
    rows = [(c, i, *bar) for c, bars in charts.items() for i, bar in enumerate(bars)]
    df = spark.createDataFrame(rows, "chart long, bar long, raw string, melody string").repartition(3)
    got = {r.chart: (r.orientation, r.margin) for r in O.stacked_orientation(df, "chart", ["bar"]).collect()}
    assert got == {c: plain_orientation(bars) for c, bars in charts.items()}
    assert got[60][0] == "top_is_bass" and got[61] == ("bottom_is_bass", 0.0) and len({x for x, _ in got.values()}) == 2


# The notes of major keys.
SCALES = {
    "C": "C D E F G A B", "G": "G A B C D E F#", "D": "D E F# G A B C#", "A": "A B C# D E F# G#", "E": "E F# G# A B C# D#", "B": "B C# D# E F# G# A#", "F#": "F# G# A# B C# D# E#",
    "F": "F G A Bb C D E", "Bb": "Bb C D Eb F G A", "Eb": "Eb F G Ab Bb C D", "Ab": "Ab Bb C Db Eb F G", "Db": "Db Eb F Gb Ab Bb C",
}


def test_names():
    assert set(SCALES) == set(DEFAULT_KEYS)
    for key, scale in SCALES.items():
        assert [N.degree_name(key, d) for d in range(1, 8)] == scale.split()
        for pc in range(12):
            assert N.pc_of(N.spelled(key, pc)) == pc and len(N.spelled(key, pc)) <= 2
    assert [N.spelled("C", p) for p in (1, 3, 6, 8, 10)] == ["C#", "Eb", "F#", "Ab", "Bb"]
    assert [N.spelled("F", p) for p in (6, 8, 11, 1, 3)] == ["Gb", "Ab", "Cb", "Db", "Eb"] and N.spelled("Db", 11) == "Cb" and N.spelled("A", 0) == "C"
    assert N.degree_name("F#", 7, -1) == "E" and N.degree_name("F", 4) == "Bb" and N.degree_name("C", 1, 1) == "C#" and N.degree_name("F#", 7, 1) == "F#"


def test_note_name(spark):
    rows = [(p, t) for p in range(-3, 15) for t in range(14)]
    df = spark.createDataFrame(rows, "p int, t int")
    assert all(r.x == N.spelled(DEFAULT_KEYS[r.t % 12], r.p % 12) for r in df.select("p", "t", N.note_name(F.col("p"), F.col("t")).alias("x")).collect())


def test_pruned_bars():
    """Each step takes the line whose loss leaves the smaller standard deviation, worked out anew."""
    rng = random.Random(3)
    assert L.pruned([0, 100, 110, 200], 30) == [0, 100, 200] and L.pruned([0, 5], 30) == [0, 5] and L.pruned([], 3) == []
    assert L.pruned([0, 100, 200, 220], 30, 15) == [0, 100, 200, 220]
    for _ in range(300):
        bars = sorted(rng.sample(range(1000), rng.randint(2, 12)))
        got, want = L.pruned(bars, 60), list(bars)
        while len(want) > 2:
            widths = np.diff(want)
            if widths.min() >= 60:
                break
            i = int(widths.argmin())
            a, b = want[:i] + want[i + 1 :], want[: i + 1] + want[i + 2 :]
            want = a if round(np.std(np.diff(a)), 6) <= round(np.std(np.diff(b)), 6) else b
        assert got == want, bars


def test_regularity():
    assert L.regularity([0, 100, 200, 300], 9) == (1, 300.0, 9) and L.regularity([5], 1) == (0, 0.0, 0) and L.regularity([], 0) == (0, 0.0, 0)
    assert L.regularity([0, 10, 300], 3) == (1, 150.0, 3)  # two lines, one of them doubled
    assert L.regularity([60 * k for k in range(9)], 9) == (0, 0.0, 0)
    uneven = L.regularity([0, 60, 300], 3)
    assert uneven[0] == 1 and uneven[1] == pytest.approx(300 * (1 - 0.6)) and L.regularity([0, 250, 500], 3)[1] == 400.0


def test_rows_of():
    assert L.rows_of([100] * 9, [False] * 9, 10_000) == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert L.rows_of([400, 400, 400], [False] * 3, 900) == [0, 0, 1] and L.rows_of([2000, 2000, 10], [False] * 3, 900) == [0, 0, 1]
    assert L.rows_of([100] * 5, [True, False, False, True, False], 10_000) == [0, 0, 0, 1, 1] and L.rows_of([], [], 1) == []
    rng = random.Random(5)
    for _ in range(100):
        needs, new = [rng.randint(50, 500) for _ in range(20)], [rng.random() < 0.2 for _ in range(20)]
        rows = L.rows_of(needs, new, 1000)
        for r in set(rows):
            mine = [k for k, x in enumerate(rows) if x == r]
            assert mine == list(range(mine[0], mine[-1] + 1)) and len(mine) <= 4
            assert len(mine) < 3 or sum(needs[k] for k in mine) <= 960
            assert len(mine) < 4 or sum(needs[k] for k in mine) <= 900 and not new[mine[3]]


def test_fingers(spark):
    cases = [([], [], []), ([60], [1], [5]), ([60, 64], [1, 3], [5, 3]), ([60, 67], [1, 4], [5, 2]), ([60, 72], [1, 5], [5, 1]), ([60, 64, 67], [1, 3, 5], [5, 3, 1]), ([64, 67, 72], [1, 2, 5], [5, 3, 1]),
             ([67, 72, 76], [1, 3, 5], [5, 3, 1]), ([48, 55, 60], [1, 3, 5], [5, 2, 1]), ([48, 55, 64], [1, 2, 5], [5, 3, 1]), ([67, 69, 72], [1, 2, 4], [5, 3, 1]), ([60, 65, 67], [1, 3, 5], [5, 3, 1]),
             ([60, 64, 67, 72], [1, 2, 3, 5], [5, 4, 2, 1]), ([60, 67, 69, 72], [1, 2, 4, 5], [5, 4, 2, 1]), ([60, 62, 64, 65, 67], [1, 2, 3, 4, 5], [5, 4, 3, 2, 1])]
    df = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(cases)], "i int, p array<int>")
    got = df.select("i", H.right_hand(F.col("p")).alias("r"), H.left_hand(F.col("p")).alias("l")).orderBy("i").collect()
    for r, (p, right, left) in zip(got, cases, strict=True):
        assert (r.r, r.l) == (right, left), p
    runs = [(0, 4, -1, 70), (3, 4, -1, 60), (0, 7, -1, 70), (0, 6, 1, 60), (4, 6, 1, 66), (5, 6, 1, 80), (2, 5, 0, 73), (0, 1, 0, 60)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(runs)], "k int, i int, n int, rising int, midi int")
    got = [r.f for r in df.orderBy("k").select(H.run_finger(*map(F.col, ("i", "n", "rising", "midi")), F.lit(None).cast("int")).alias("f")).collect()]
    assert got == [4, 1, 5, 1, 5, 5, 3, 1]
