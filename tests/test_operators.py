"""Operators against brute force and on borders."""

import random

import numpy as np
from pyspark.sql import functions as F

from tonalframe.operators import catalog, folds, intervals, pages, sequences, votes, windows


def test_votes_break_ties_by_first_seen(spark):
    rows = spark.createDataFrame([("s", 0, 1, "1", "1"), ("s", 0, 2, "4", "4"), ("s", 0, 3, "4M7", "4"), ("s", 0, 4, "1", "1"), ("s", 1, 1, "5", "5")], "song string, bar int, seen int, raw string, k string")
    got = {r.bar: r for r in votes.majority(rows, ["song", "bar"], "seen", "raw", "k").collect()}
    assert (got[0].winner, got[0].support, got[0].n_keys, got[0].alternatives) == ("1", 2, 2, ["4"])
    assert (got[1].winner, got[1].alternatives) == ("5", [])


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)
    span = lambda: (s := rng.randrange(100), s + rng.randrange(1, 30))
    a, b = [(i % 3, i, *span()) for i in range(60)], [(i % 3, i, *span()) for i in range(60)]
    left = spark.createDataFrame(a, "k long, a long, start long, end long")
    right = spark.createDataFrame(b, "k long, b long, r_start long, r_end long")
    got = sorted((r.a, r.b) for r in intervals.overlaps(left, right, ["k"], 7, 2).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] - 2 < y[3] and y[2] < x[3] + 2)


def test_folds():
    assert folds.apart([0, 0.1, 0.25, 0.3, 0.6], 0.2) == [True, False, True, False, True]
    assert folds.from_first([0, 3, 6, 7, 20], 5) == [1, 1, 2, 2, 3]
    assert folds.smoothed(list("ABABB"), [1] * 5) == list("AAABB")
    assert folds.absorbed(list("AAABCCCC"), 3, ("A", "B", "C")) == list("AAAACCCC")
    assert folds.absorbed(list("IIABBBIAAABIII"), 3, ("A", "B")) == list("IIBBBBIAAAAIII") and folds.absorbed(list("IIAI"), 3, ("A", "B")) == list("IIAI")
    assert folds.increasing([1, 1, 1.2], 4) == [1, 1.5, 2.0] and folds.increasing([4, 4], 4) == [3.5, 4] and folds.increasing([2, 3], 4) == [2, 3]
    assert folds.increasing([1, 1, 1], 1) == [1.0, 1.1, 1.2] and folds.increasing([], 4) == []


def test_songs_stream_across_batches(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("song"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = folds.fold(rows, "song", ["i"], ["i"], lambda x: list(range(len(x))), "n", "long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 5000 and all(r.n == r.i // 7 for r in got)


def test_viterbi_prefers_staying():
    o = np.log([[0.9, 0.1], [0.45, 0.55], [0.9, 0.1]])
    assert sequences.viterbi(o, np.array([[0, -1.0], [-1.0, 0]])) == [0, 0, 0]
    assert sequences.viterbi(o, np.zeros((2, 2))) == [0, 1, 0]


def test_lcs(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(30)]

    def lcs(a, b):
        return 0 if not a or not b else lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", sequences.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in got)


def test_pagination_ends(spark):
    rows = spark.createDataFrame([(f"{i:02}", i % 3 == 0) for i in range(10)], "key string, hidden boolean")
    first = sorted(tuple(r) for r in catalog.page_after(rows, "key", None, 3, ~F.col("hidden")).select("key", "next_cursor").collect())
    assert first == [("01", "04"), ("02", "04"), ("04", "04")]
    last = sorted(tuple(r) for r in catalog.page_after(rows, "key", "07", 5, ~F.col("hidden")).select("key", "next_cursor").collect())
    assert last == [("08", "08")]  # a hidden key remains


def test_tiling(spark):
    rows = spark.createDataFrame([(1, 0.5, 2.0), (1, 1.0, 9.0)], "bar int, at double, len double")
    got = sorted(tuple(r) for r in windows.tiled(rows, ["bar"], "at", "len", 4.0).collect())
    assert got == [(1, 0.0, 0.5, True), (1, 0.5, 0.5, False), (1, 1.0, 3.0, False)]


def test_json_and_pages():
    assert pages.closed('{"a": [1, 2], "b') == '{"a": [1, 2]}' and pages.closed('{"a": "x", "b') == '{"a": "x"}' and pages.closed('{"a": {"c": "]"}, "d": "e\\"f') == '{"a": {"c": "]"}}'
    assert pages.closed('{"a": tr') is None and pages.closed('{"a":') is None and pages.closed(None) is None and pages.closed("[1, 2") is None
    assert pages.lines_of("<p>a<script>x</script> b</p><nav>menu</nav>c<br>d") == ["a b", "c", "d"]


def test_sections_tile():
    rng = random.Random(9)
    for _ in range(300):
        spans = [(a := rng.randrange(40), a + rng.randrange(-2, 15), rng.choice(["verse", "chorus"])) for _ in range(rng.randrange(1, 6))]
        spans = [x for x in spans if x[0] <= x[1]]
        got = folds.tiled_sections(spans, 40)
        assert not spans or (got[0][0] == 0 and got[-1][1] == 39 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:], strict=False)))
    assert folds.tiled_sections([(6, 10, "verse"), (13, 20, "chorus")], 30) == [(0, 5, "intro"), (6, 12, "verse"), (13, 20, "chorus"), (21, 29, "outro")]


def test_near_repeats():
    assert folds.not_near(["1", "1", "4", "1"], [1.0, 1.2, 1.2, 1.3]) == [True, False, True, True]


def test_voice_leading_is_optimal():
    import itertools

    chords = [[0, 4, 7], [5, 9, 0], [7, 11, 2]]
    got = sequences.voice_leading(chords, {})
    cost = lambda p: sum(map(sequences.voicing_cost, p)) + sum(sequences.voicing_move(a, b) for a, b in itertools.pairwise(p))
    assert abs(cost(got) - min(map(cost, itertools.product(*map(sequences.voicings, chords))))) < 1e-9
    assert all({m % 12 for m in v} == set(c) for v, c in zip(got, chords, strict=True))


def test_bass_line_is_optimal():
    import itertools

    def cost(p):
        total = 0.5 * abs(p[0] - 43)
        for a, b in itertools.pairwise(p):
            d = abs(b - a)
            total += 0.8 * d - 2.0 * (d in (1, 2)) - (d in (3, 4)) + 3.0 * (d >= 7) + 0.3 * abs(b - 43)
        return total

    pcs = [0, 7, 9, 4, 5]
    options = [[m for m in range(36, 53) if m % 12 == pc] for pc in pcs]
    assert abs(cost(sequences.bass_line(pcs)) - min(map(cost, itertools.product(*options)))) < 1e-9


def test_lcs_of_sizes_around_the_bits_of_a_number(spark):
    def lcs(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
            best = row
        return best[-1]

    rng = random.Random(3)
    rows = [([rng.choice("abc") for _ in range(n)], [rng.choice("abc") for _ in range(m)]) for n in (0, 1, 30, 70) for m in (0, 1, 31, 61, 62, 63, 64, 70)] + [(["a"] * 62, ["a"] * 62), (["a"] * 70, ["a"] * 62), (["a"], ["b"] * 62)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", sequences.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in got)
