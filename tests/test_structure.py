"""Beats, measures, sections and shapes against plain versions, one bar, recording, song after the other."""

import itertools
import random
import statistics

import numpy as np
import pytest

from tonalframe.operators import grids as G
from tonalframe.operators import quantising as Q
from tonalframe.operators import sections as X
from tonalframe.operators import sequences as S


def plain_bar(chords, beats, onsets, delta):
    """Beats of a bar's chords (share or None, beat)."""
    half = lambda v: float(round(v)) if abs(v - round(v)) <= 0.3 else round(v * 2) / 2
    out = []
    for share, read in chords:
        beat = read
        if share is not None:
            free = share * beats - delta
            at = free + 1
            if beats in (6, 9, 12):
                dotted = min((1.0 + 3 * k for k in range(int(beats // 3))), key=lambda d: (abs(at - d), d))
                beat = dotted if abs(at - dotted) <= 1 else 1 + half(free)
            elif not (abs(read - round(read)) < 0.01 and abs(at - read) < 0.7):
                beat = 1 + half(free)
                if abs(beat - round(beat)) > 0.01 and onsets and not any(abs(beat - o) <= 0.15 for o in onsets):
                    near = min(onsets, key=lambda o: (abs(at - o), o))
                    beat = near if abs(at - near) <= 1 else beat
        out.append(max(1.0, min(beats, beat)))
    n = len(out)
    for i in range(1, n):
        if out[i] <= out[i - 1]:
            out[i] = min(beats, out[i - 1] + 0.5)
    for i in range(n - 2, -1, -1):
        if out[i] >= out[i + 1]:
            out[i] = max(1.0, out[i + 1] - 0.5)
    for i in range(1, n):
        if out[i] <= out[i - 1]:
            out[i] = round(out[i - 1] + max(0.1, (beats - out[i - 1]) / (n - i + 1)), 2)
    return out


def test_quantised_beats(spark):
    rng = random.Random(4)
    bars = []
    for bar in range(400):
        beats = rng.choice([4.0, 3.0, 6.0, 12.0, 2.0])
        chords = [(rng.choice([None, round(rng.random(), 2), round(rng.random(), 2)]), rng.choice([1.0, 2.0, 2.5, 3.0, 4.0, 7.0])) for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))]
        onsets = sorted(rng.choice([1.0, 1.1, 1.75, 2.0, 2.5, 3.3, 4.5]) for _ in range(rng.randint(0, 4)))
        bars.append((bar, bar % 9 if bar % 9 < 8 else 100 + bar, beats, chords, onsets))
    schema = "bar long, page long, beats double, chords array<struct<share:double,beat:double>>, onsets array<double>"
    got = {r.bar: r for r in Q.quantised(spark.createDataFrame(bars, schema).repartition(4), ["page"]).collect()}
    assert len(got) == 400
    samples = {}
    for _, page, beats, chords, onsets in bars:
        if chords and chords[0][0] is not None and (len(chords) == 1 or onsets and abs(onsets[0] - 1) < 0.15) and chords[0][0] * beats < 1:
            samples.setdefault(page, []).append(chords[0][0] * beats)
    delta = lambda page: statistics.median(samples[page]) if len(samples.get(page, [])) >= 3 else 0.5
    assert any(len(x) >= 3 for x in samples.values()) and delta(108) == 0.5
    for bar, page, beats, chords, onsets in bars:
        assert got[bar].delta == pytest.approx(delta(page))
        want = plain_bar(chords, beats, onsets, got[bar].delta)
        assert got[bar].quantised == pytest.approx(want), (bar, chords, beats, onsets)
        assert len(want) < 2 or beats < 3 or all(a < b for a, b in itertools.pairwise(got[bar].quantised))


def plain_grid(duration, tempo, per_bar, beats, downs, notes):
    beats, kept, out = sorted(b for b in beats if b >= 0), [], []
    for d in sorted(d for d in downs if d >= 0):
        if not kept or d - kept[-1] >= 0.2:
            kept.append(d)
    count = lambda times: per_bar if len(times) <= 1 or abs(len(times) - 1 - per_bar) <= 1 else float(len(times) - 1)
    if kept:
        early = [b for b in beats if b < kept[0] - 0.05]
        if early:
            out.append((early[0], kept[0], float(len(early)), [*early, kept[0]]))
        elif kept[0] > 0.5 and notes and min(notes) < kept[0] - 0.1:
            out.append((0.0, kept[0], max(1.0, round(kept[0] * (tempo or 120) / 60)), [0.0, kept[0]]))
        for a, b in itertools.pairwise([*kept, None]):
            end = max(duration, a) if b is None else b
            if b is None and end - a <= 0.5:
                continue
            times = [x for x in beats if x >= a - 0.05 and (b is None or x < b - 0.05)]
            if not times or abs(times[0] - a) > 0.1:
                times = [a] + [x for x in times if x > a + 0.05]
            if b is not None or times[-1] < end - 0.05:
                times.append(end)
            out.append((a, end, count(times), times))
    elif beats:
        for i in range(0, len(beats), int(per_bar)):
            some, rest = beats[i : i + int(per_bar)], beats[i + int(per_bar) :]
            end = rest[0] if rest else max(duration, some[0] + len(some) * 0.5)
            out.append((some[0], end, float(len(some)), [*some, end]))
    else:
        beat = 60 / (tempo if tempo and tempo > 30 else 120)
        total = max(duration, per_bar * beat)
        for k in range(max(1, int(np.ceil(total / (per_bar * beat))))):
            start = k * per_bar * beat
            out.append((start, min(total, start + per_bar * beat), per_bar, [start + i * beat for i in range(int(per_bar) + 1)]))
    return out


def recordings(rng, n):
    out = {}
    for track in range(n):
        tempo, per_bar, duration = rng.choice([0.0, 20.0, 60.0, 100.0]), rng.choice([3.0, 4.0]), rng.choice([0.5, 8.0, 20.0])
        beats = sorted({round(rng.random() * duration, 2) for _ in range(rng.choice([0, 3, 12, 30]))})
        downs = sorted({round(rng.random() * duration, 2) for _ in range(rng.choice([0, 1, 4, 9]))}) if track % 3 else []
        if track % 5 == 0:
            downs = [d + 0.03 for d in beats[:: int(per_bar)]] if track % 3 else downs
        notes = [(round(rng.random() * duration, 2), round(rng.random() * 3 + 0.05, 2)) for _ in range(rng.choice([0, 2, 6]))]
        out[track] = duration, tempo, per_bar, beats, downs, notes
    return out


def frames(spark, found):
    tracks = spark.createDataFrame([(k, *v[:3]) for k, v in found.items()], "track long, duration double, tempo double, per_bar double")
    times = lambda i: spark.createDataFrame([(k, t) for k, v in found.items() for t in v[i]], "track long, t double")
    notes = spark.createDataFrame([(k, i, s, s + d) for k, v in found.items() for i, (s, d) in enumerate(v[5])], "track long, id long, start double, end double")
    return tracks, times(3), times(4), notes


def test_measure_grid_and_notes_cut_by_it(spark):
    found = recordings(random.Random(11), 60)
    tracks, beats, downs, notes = frames(spark, found)
    grid = G.measure_grid(tracks, beats, downs, notes.selectExpr("track", "start AS t"))
    got = {}
    for r in grid.orderBy("track", "measure").collect():
        got.setdefault(r.track, []).append((r.start, r.end, r.beats, r.times))
    for track, v in found.items():
        want = plain_grid(*v[:5], [s for s, _ in v[5]])
        assert len(got.get(track, [])) == len(want)
        for a, b in zip(got.get(track, []), want, strict=True):
            assert a[:3] == pytest.approx(b[:3]) and a[3] == pytest.approx(b[3]), track
    pieces = {}
    for r in G.cut_by_measures(notes, grid).collect():
        pieces.setdefault((r.track, r.id), []).append((r.measure, r.start, r.end, r.tied))
    for track, v in found.items():
        for i, (s, d) in enumerate(v[5]):
            want = [(k, max(s, a), min(s + d, b)) for k, (a, b, _, _) in enumerate(got.get(track, [])) if min(s + d, b) - max(s, a) > 1e-9]
            mine = sorted(pieces.get((track, i), []))
            assert [(k, pytest.approx(a), pytest.approx(b)) for k, a, b in want] == [x[:3] for x in mine]
            assert [x[3] for x in mine] == [True] * (len(mine) - 1) + [False] * bool(mine)


def plain_sections(sections, sung, row):
    out, split = [], False
    for k, (a, z, role, energy) in enumerate(sections):
        runs = []
        if role in X.PLAYED:
            for s, group in itertools.groupby(range(a, z + 1), key=lambda m: m in sung):
                group = list(group)
                runs += [group[0]] if s and len(group) >= 2 else []
        if not runs:
            out.append((a, z, role, energy))
            continue
        split = True
        cut = max(a, row[runs[0]])
        new = next(((r, e) for _, _, r, e in sections[k + 1 :] if r not in X.PLAYED), ("verse", 1))
        out += [(a, cut - 1, role, energy), (cut, z, *new)] if cut > a else [(a, z, *new)]
    if not split:
        return sections
    merged = []
    for s in out:
        if merged and merged[-1][2:] == s[2:] and merged[-1][1] + 1 == s[0]:
            s = (merged.pop()[0], *s[1:])
        merged.append(s)
    return merged


def test_sung_sections(spark):
    rng = random.Random(2)
    songs, sections, measures = {}, [], []
    for song in range(60):
        parts, at = [], 0
        for _ in range(rng.randint(1, 6)):
            end = at + rng.randint(0, 7)
            parts.append((at, end, rng.choice(["intro", "verse", "interlude", "chorus", "outro"]), rng.randint(1, 2)))
            at = end + 1
        sung = {m for m in range(at) if rng.random() < 0.6}
        row = {m: m // 4 * 4 for m in range(at)}
        songs[song] = parts, sung, row
        sections += [(song, *p) for p in parts]
        measures += [(song, m, m in sung, row[m]) for m in range(at)]
    s = spark.createDataFrame(sections, "song long, first long, last long, role string, energy int").repartition(3)
    m = spark.createDataFrame(measures, "song long, measure long, sung boolean, row_start long").repartition(3)
    got = {}
    for r in X.sung_apart(s, m).orderBy("song", "first").collect():
        got.setdefault(r.song, []).append((r["first"], r["last"], r.role, r.energy))
    for song, x in songs.items():
        assert got[song] == plain_sections(*x)


def test_shape_path_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(25):
        options = {k: (rng.integers(0, 5, (int(rng.integers(1, 4)), 4)), None) for k in "abc"}
        options = {k: (f, np.sort(rng.random(len(f)).round(2))) for k, (f, _) in options.items()}
        chords, sections = [str(x) for x in rng.choice(list("aabc"), 5)], [0, 0, 0, 1, 1]
        barre = lambda x: min(x) > 0 and len(set(x)) < 4

        def cost(path):
            total, shapes = 0.0, [options[c][0][i].tolist() for c, i in zip(chords, path, strict=True)]
            total += sum(options[c][1][i] for c, i in zip(chords, path, strict=True))
            for k, (x, y) in enumerate(itertools.pairwise(shapes)):
                total += 0.5 * sum(a != b for a, b in zip(x, y, strict=True)) + 0.7 * abs(max(x) - max(y)) + (barre(x) != barre(y))
                total -= sum(1.5 if a else 0.4 for a, b in zip(x, y, strict=True) if a == b)
                if chords[k] == chords[k + 1] and sections[k] == sections[k + 1]:
                    total += -4.0 if x == y else 3.0
            return total

        best = min(cost(p) for p in itertools.product(*(range(len(options[c][0])) for c in chords)))
        assert cost(S.shape_path(chords, sections, options)) == pytest.approx(best)
    assert S.shape_path(["a"], [0], {"a": (np.zeros((1, 4), int), np.zeros(1))}) == [0]
