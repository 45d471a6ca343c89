"""Batch alignment and what is drawn from it, against plain versions cell by cell."""

import random
import time
import tracemalloc
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tonalframe.operators import alignment as A
from tonalframe.operators import consensus as C
from tonalframe.plans.votes import vote_key


def plain(s, gap, first="up"):
    """Total and steps of one alignment, written down cell by cell."""
    n, m = s.shape
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            ways = [best[i - 1, j - 1] + s[i - 1, j - 1]] if i and j else []
            ways += [best[i - 1, j] + gap] if i else []
            ways += [best[i, j - 1] + gap] if j else []
            if ways:
                best[i, j] = max(ways)
    steps, i, j = [], n, m
    same = lambda x, y: abs(x - y) < 1e-6
    while i or j:
        if i and j and same(best[i, j], best[i - 1, j - 1] + s[i - 1, j - 1]):
            i, j = i - 1, j - 1
            steps.append((i, j))
            continue
        alone = {"up": bool(i) and same(best[i, j], best[i - 1, j] + gap), "left": bool(j) and same(best[i, j], best[i, j - 1] + gap)}
        way = first if alone[first] else ({"up": "left", "left": "up"}[first])
        i, j = (i - 1, j) if way == "up" else (i, j - 1)
        steps.append((i, -1) if way == "up" else (-1, j))
    return best[n, m], steps[::-1]


@pytest.mark.parametrize("first", ["up", "left"])
def test_batches_of_pairs(first):
    rng = np.random.default_rng(2)
    n, m = rng.integers(0, 8, 80), rng.integers(0, 8, 80)
    scores = rng.choice([1.0, 0.7, 0.3, -0.6, 0.0], (80, 8, 8))
    total, k, i, j = A.best_pairs(scores, n, m, -0.4, first)
    for pair in range(80):
        want, steps = plain(scores[pair, : n[pair], : m[pair]], -0.4, first)
        assert total[pair] == pytest.approx(want) and list(zip(i[k == pair].tolist(), j[k == pair].tolist(), strict=True)) == steps


def score(a, b, kind):
    """Scores of two chords (root, bass, quality), None for a rest."""
    if kind != "chord" and (a[0] is None or b[0] is None):
        both = a[0] is None and b[0] is None
        return {"bar": (0.5, -0.5), "heard": (0.2, -0.5)}[kind][not both]
    d = (a[0] - b[0]) % 12
    base = (1.0 if a[1] == b[1] else 0.7) if d == 0 else 0.3 if d in (3, 4, 8, 9) or d == 6 and ("7" in a[2] or "7" in b[2]) else -0.6
    return base + 0.1 * (kind == "bar" and a[2] == b[2] and base > 0)


def chord(rng, rest=0.15):
    r = rng.randrange(12)
    return (None, None, None) if rng.random() < rest else (r, rng.choice([r, r, (r + 7) % 12]), rng.choice(["", "m", "7", "m7"]))


@pytest.mark.parametrize("kind", ["bar", "heard"])
@pytest.mark.parametrize("cells", [30, 2_000_000])
def test_aligned_songs(spark, kind, cells):
    rng = random.Random(len(kind))
    songs = {k: ([chord(rng) for _ in range(rng.choice([0, 1, 3, 9, 40]))], [chord(rng) for _ in range(rng.choice([0, 1, 3, 9, 40]))]) for k in range(40)}
    rows = [(k, side, at, *c) for k, both in songs.items() for side, chords in enumerate(both) for at, c in enumerate(chords)]
    rows = spark.createDataFrame(rows, "song long, side int, at int, root int, bass int, quality string").repartition(5)
    use = {"bar": A.bar_scores, "heard": A.heard_scores}[kind]
    for empty in (False, True):
        got = {}
        for r in A.aligned(rows, "song", "side", "at", use, empty=empty, cells=cells).collect():
            got.setdefault(r.song, []).append((r.i, r.j, round(r.score, 9), round(r.total, 9)))
        for k, (a, b) in songs.items():
            if not (a and b):
                assert (k in got) == (empty and bool(a or b))
                continue
            s = np.array([[score(x, y, kind) for y in b] for x in a])
            total, steps = plain(s, -0.4)
            assert got[k] == [(i, j, round(s[i, j] if i >= 0 and j >= 0 else -0.4, 9), round(total, 9)) for i, j in steps]


def test_star_votes_and_what_they_say(spark):
    """A reference and sources that leave bars out, change some and have two chords in others, against a plain vote."""
    rng = random.Random(3)
    names = ["1", "2m", "3m", "4", "5", "6m", "57", "4/6"]
    songs = {}
    for song in range(6):
        pattern = [[rng.choice(names) for _ in range(rng.choice([1, 1, 2]))] for _ in range(12)]
        for source in range(4):
            bars = [[rng.choice(names) if rng.random() < 0.15 else c for c in bar][: rng.choice([1, 2, 2])] for bar in pattern if rng.random() < 0.9]
            songs.setdefault(song, {})[song * 10 + source] = bars
    rows = [(s, src, b, p, c, len(bar)) for s, x in songs.items() for src, bars in x.items() for b, bar in enumerate(bars) for p, c in enumerate(bar)]
    charts = spark.createDataFrame(rows, "song long, source long, bar long, pos int, number string, n int").repartition(4)
    chosen = spark.createDataFrame([(s, s * 10 + 1) for s in songs], "song long, source long")
    votes = A.star_votes(C.first_chords(charts, "song", "source", "bar"), chosen, "song", "source", "bar")
    from pyspark.sql import functions as F

    got = {(r.song, r.ref_bar): (r.chords, r.support, sorted(r.alternatives), r.total) for r in C.voted(charts, votes, "song", "source", "bar", vote_key(F.col("number"))).collect()}
    from tonalframe.functions import theory as T

    known = charts.select("number").distinct().select("number", T.chord_degree(F.col("number")).alias("c"), vote_key(F.col("number")).alias("k")).collect()
    read = {r.number: (r.c.root, r.c.bass, r.c.quality) for r in known}
    key = {r.number: r.k for r in known}
    assert len(got) == sum(len(x[s * 10 + 1]) for s, x in songs.items())
    for s, x in songs.items():
        ref = x[s * 10 + 1]
        cast = [[] for _ in ref]
        for src in sorted(x):
            bars = x[src]
            if src == s * 10 + 1:
                pairs = [(i, i) for i in range(len(ref))]
            else:
                m = np.array([[score(read[a[0]], read[b[0]], "bar") for b in bars] for a in ref])
                pairs = [(i, j) for i, j in plain(m, -0.4)[1] if i >= 0 and j >= 0 and m[i, j] > -0.5]
            for i, j in pairs:
                cast[i].append(bars[j])
        for i, bars in enumerate(cast):
            size = Counter(map(len, bars)).most_common(1)[0][0]
            chords, support, others = [], [], []
            for p in range(size):
                tokens = [b[p] for b in bars if len(b) > p]
                ranked = Counter(key[t] for t in tokens).most_common()
                spelled = lambda k, tokens=tokens: Counter(t for t in tokens if key[t] == k).most_common(1)[0][0]
                chords.append(spelled(ranked[0][0]))
                support.append(ranked[0][1])
                others += [spelled(k) for k, _ in ranked[1:]]
            assert got[s, i][:2] == (chords, min(support)) and got[s, i][3] == 4, (s, i)
            assert set(got[s, i][2]) == set(others) or set(chords) & set(others)


def test_a_repeat_is_found_in_a_second_pass(spark):
    """A sheet that plays a source's verse twice: the second time has no partner in a global alignment."""
    verse = [(0, 0, ""), (9, 9, "m"), (5, 5, ""), (7, 7, "7"), (4, 4, "m"), (2, 2, "m")]
    sheet = spark.createDataFrame([(1, b, *c) for b, c in enumerate(verse * 2)], "song long, bar long, root int, bass int, quality string")
    sources = [(1, 7, b, *c) for b, c in enumerate(verse)] + [(1, 8, b, (r + 1) % 12, (r + 1) % 12, q) for b, (r, _, q) in enumerate(verse)]
    sources = spark.createDataFrame(sources, "song long, source long, bar long, root int, bass int, quality string")
    got = A.evidence(sheet, sources, "song", "source", "bar").collect()
    hits = sorted((r.i, r.j) for r in got if r.source == 7 and r.score == 1.0)
    assert hits == [(i, i % 6) for i in range(12)]
    assert sum(r.score for r in got if r.source == 7) == 12.0 and sum(r.score for r in got if r.source == 8) < 6


def test_normalised(spark):
    rows = [
        (1, 10, 0, ["C", " G/B "], 0), (1, 10, 1, [], 0), (1, 10, 2, ["Am", "F", "G7"], 0), (1, 10, 3, ["N.C.", ""], 0),
        (1, 11, 0, ["D", "A/C#"], 2), (1, 11, 1, ["Bm"], 2), (1, 12, 0, ["1", "57sus"], 5), (1, 12, 1, ["b7M7"], 5), (1, 12, 2, ["?"], 5),
    ]
    bars = spark.createDataFrame(rows, "song long, source long, bar long, tokens array<string>, played int")
    got = {}
    for r in C.normalised(bars, "song", "source", "bar", "tokens", "played").orderBy("source", "bar", "pos").collect():
        got.setdefault(r.source, []).append((r.bar, r.pos, r.number, r.n))
    assert got[10][:5] == [(0, 0, "1", 2), (0, 1, "5/7", 2), (1, 0, "6m", 1), (2, 0, "4", 1), (3, 0, "57", 1)] and got[10][5][0] == 4
    assert got[11] == [(0, 0, "1", 2), (0, 1, "5/7", 2), (1, 0, "6m", 1)] and got[12][:3] == [(0, 0, "1", 2), (0, 1, "57sus", 2), (1, 0, "b7maj7", 1)]


def test_lead_sheet(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, ["1", "4"], 2, ["5"], 3, "verse"), (1, 1, ["5"], 1, [], 3, "verse"), (1, 2, ["1", "2", "3"], 3, [], 4, "chorus")]
    bars = spark.createDataFrame(rows, "song long, bar long, chords array<string>, support long, alternatives array<string>, total long, label string")
    got = [tuple(r) for r in C.lead_sheet(bars, "song", "bar", F.col("label")).orderBy("bar", "beat").collect()]
    third = 4 / 3
    assert got[:3] == [(1, 0, "verse", 1.0, "1", "agree", 1), (1, 0, "verse", 3.0, "4", "agree", 1), (1, 1, None, 1.0, "5", "search_only", 0)]
    assert [round(r[3], 6) for r in got[3:]] == [1.0, round(1 + third, 6), round(1 + 2 * third, 6)] and {r[2] for r in got[3:]} == {"chorus"}


def test_placed_letters():
    draft = [(0.0, 0.2, "a"), (0.2, 0.4, "b"), (0.6, 0.8, "d")]
    assert A.placed(draft, "abcd", 0, 1, []) == [(0.0, 0.2, "a"), (0.2, 0.4, "b"), (0.4, 0.6, "c"), (0.6, 0.8, "d")]
    assert A.placed(draft, "abxyd", 0, 1, [0.42, 0.5, 0.58])[2:4] == [(0.42, 0.5, "x"), (0.5, 0.6, "y")]
    assert A.placed(draft, "ad", 0, 1, []) == [(0.0, 0.2, "a"), (0.6, 0.8, "d")] and A.placed(draft, "", 0, 1, []) == []
    assert A.placed([], "ab", 1.0, 2.0, []) == [(1.0, 1.5, "a"), (1.5, 2.0, "b")] and A.placed([], "ab", 1.0, 2.0, [1.1, 1.4]) == [(1.1, 1.4, "a"), (1.4, 2.0, "b")]
    rng = random.Random(7)
    for _ in range(200):
        draft = [(round(0.3 * i, 2), round(0.3 * i + 0.25, 2), rng.choice("abc")) for i in range(rng.randint(0, 8))]
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        got = A.placed(draft, text, 0.0, 3.0, [round(rng.random() * 3, 2) for _ in range(rng.randint(0, 9))])
        assert "".join(c for _, _, c in got) == text and all(e > s for s, e, _ in got) and all(a[0] <= b[0] for a, b in zip(got, got[1:], strict=False))


def plain_placed(draft, text, start, end, onsets):
    """placed, letter by letter."""
    n = len(text)
    if not n:
        return []
    times = [None] * n
    if draft:
        s = np.where(np.array([d[2] for d in draft])[:, None] == np.array(list(text))[None], 2.0, -1.0)[None]
        for i, j in zip(*A.best_pairs(s, np.array([len(draft)]), np.array([n]), -1.0, "left")[2:], strict=True):
            if i >= 0 and j >= 0:
                times[j] = [draft[i][0], draft[i][1]]
    gaps = np.flatnonzero(np.diff([0, *(t is None for t in times), 0]))
    for a, b in gaps.reshape(-1, 2).tolist():
        plain_fill(times, a, b, start, end, sorted(onsets), bool(draft))
    out = []
    for (s, e), letter in zip(times, text, strict=True):
        e = e if e > s else round(s + 0.05, 2)
        if out and s < out[-1][0]:
            s = out[-1][0]
            e = max(e, round(s + 0.05, 2))
        out.append((round(s, 2), round(e, 2), letter))
    return out


def plain_fill(times, a, b, start, end, onsets, anchored):
    k, n = b - a, len(times)
    if not anchored:
        each = max(0.05, (end - start) / n)
        near = [t for t in onsets if start - 0.1 <= t <= end + 0.1]
        if len(near) >= n:
            stops = [*near[1:n], end]
            times[:] = [[round(s, 2), round(e if e > s else s + each, 2)] for s, e in zip(near[:n], stops, strict=True)]
        else:
            times[:] = [[round(start + i * each, 2), round(min(end, start + i * each + each), 2)] for i in range(n)]
        return
    left, right = start if a == 0 else times[a - 1][1], end if b == n else times[b][0]
    if right <= left:  # no room: the neighbours give some of theirs
        if a:
            s, e = times[a - 1]
            left = s + 0.6 * max(0.05, e - s)
            times[a - 1][1] = round(left, 2)
        if b < n:
            s, e = times[b]
            right = s + 0.4 * max(0.05, e - s)
            times[b][0] = round(right, 2)
    near = [t for t in onsets if left - 0.05 <= t <= right + 0.05]
    if len(near) >= k:
        for i, (t, after) in enumerate(pairwise([*near[:k], right])):
            s = max(left, t)
            e = after if after > s else s + (right - s) / (k - i)
            times[a + i] = [round(s, 2), round(max(s + 0.04, e), 2)]
    else:
        step = max(0.05 * k, right - left) / k
        times[a:b] = [[round(left + i * step, 2), round(left + (i + 1) * step, 2)] for i in range(k)]


def lines_of(rng, count, size):
    for _ in range(count):
        text = "".join(rng.choice("abcdé𝒳語"[: rng.randint(2, 7)]) for _ in range(rng.randint(0, size)))
        x, draft, digits, steady = rng.random(), [], rng.choice([1, 2, 3, 6]), rng.random() < 0.8
        for c in text + "zz":
            if rng.random() < 0.75:
                draft.append((round(x, digits), round(x + rng.choice([-0.1, 0, 0.05, 0.18, 0.25, 0.5]), digits), c if rng.random() < 0.8 else "?"))
                x += rng.choice([0, 0.05, 0.125, 0.2, 0.3, 1, 1.005]) if steady else rng.uniform(-1, 1)
        start = rng.choice([0.0, 10.0, x, round(rng.uniform(-3, 3), 3)])
        end = start + rng.choice([0.2 * len(text), 0.0, -1, 3.0, 0.125])
        yield draft if rng.random() < 0.85 else [], text, start, end, sorted(round(start + rng.uniform(-0.5, 6), digits) for _ in range(rng.randint(0, 30)))


def side_by_side(lines):
    flat = lambda part, k: np.array([x[k] for line in lines for x in line[part]], float)
    sizes = lambda part: np.array([len(line[part]) for line in lines])
    heard = A.code_points("".join(d[2] for line in lines for d in line[0]))
    starts, ends = (np.array([line[k] for line in lines], float) for k in (2, 3))
    return A.code_points("".join(line[1] for line in lines)), sizes(1), heard, sizes(0), flat(0, 0), flat(0, 1), starts, ends, np.array([t for line in lines for t in line[4]], float), sizes(4)


@pytest.mark.parametrize("cells", [1, 200, 16_000_000])
def test_placed_lines_as_letter_by_letter(cells):
    """Many lines at once, in tables of any size: tables beyond `cells` are filled a few rows at a time."""
    lines = list(lines_of(random.Random(cells), 1500, 25))
    s, e = A.placed_lines(*side_by_side(lines), cells)
    want = [x for line in lines for x in plain_placed(*line)]
    assert list(zip(s.tolist(), e.tolist(), "".join(line[1] for line in lines), strict=True)) == want


def test_placed_lines_take_a_share_of_the_time():
    lines = list(lines_of(random.Random(1), 3000, 80))
    given, began = side_by_side(lines), time.process_time()
    A.placed_lines(*given)
    together, began = time.process_time() - began, time.process_time()
    for line in lines[::10]:
        plain_placed(*line)
    assert together < time.process_time() - began  # of a tenth of the lines


def test_long_line_in_bounded_memory():
    n = 6000
    heard, letters = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    tracemalloc.start()
    met = A.letters_met(letters, np.array([n]), heard, np.array([n]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert met.tolist() == list(range(n)) and peak < 120e6  # the whole table has 36 million cells
