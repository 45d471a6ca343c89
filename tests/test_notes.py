"""Notes from pitch tracks: made tracks whose notes are known, and each step against a plain version."""

import random
from itertools import groupby

import numpy as np
import pytest

from tonalframe.operators import folds
from tonalframe.operators import notes as N


def track(parts, hop=0.02):
    """parts: (frames, midi or None for silence, rms). Hz, periodicity, rms."""
    midi = np.concatenate([np.linspace(*m, n) if isinstance(m, tuple) else np.full(n, np.nan if m is None else m) for n, m, _ in parts])
    rms = np.concatenate([np.full(n, r) if np.isscalar(r) else np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(r)), r) for n, _, r in parts])
    hz = np.where(np.isnan(midi), 0.0, 440 * 2 ** ((np.nan_to_num(midi) - 69) / 12))
    return hz, np.where(np.isnan(midi), 0.0, 0.8), rms, hop


def spans(*args):
    return [(n.start, n.end, n.midi) for n in N.notes_of(*args)]


def test_plain_notes():
    assert spans(*track([(20, 60, 0.1), (10, None, 0.0), (30, 64, 0.1), (6, None, 0.0)])) == [(0.0, 0.4, 60.0), (0.6, 1.2, 64.0)]
    assert spans(*track([(5, None, 0.0)])) == [] and spans(*(np.zeros(0),) * 3, 0.02) == []
    assert spans(*track([(3, 60, 0.1), (9, None, 0.0)])) == []  # shorter than 0.08 s


def test_a_step_cuts_and_vibrato_does_not():
    hz, p, rms, hop = track([(40, 60, 0.1), (40, 63, 0.1), (5, None, 0.0)])
    got = spans(hz, p, rms, hop)
    assert [m for _, _, m in got] == [60.0, 63.0] and got[0][1] == got[1][0] == pytest.approx(0.8, abs=0.16)
    sway = hz * 2 ** (0.6 * np.sin(np.arange(len(hz)) * 2 * np.pi / 9) / 12)
    assert [round(m) for _, _, m in spans(sway, p, rms, hop)] == [60, 63]


def test_short_gaps_are_bridged_between_like_pitches_only():
    assert len(spans(*track([(20, 60, 0.1), (3, None, 0.05), (20, 60.4, 0.1), (9, None, 0)]))) == 1
    assert len(spans(*track([(20, 60, 0.1), (3, None, 0.05), (20, 65, 0.1), (9, None, 0)]))) == 2
    assert len(spans(*track([(20, 60, 0.1), (7, None, 0.05), (20, 60, 0.1), (9, None, 0)]))) == 2


def test_a_dip_is_a_new_stroke():
    hz, p, rms, hop = track([(25, 60, 0.2), (5, 60, (0.2, 0.01, 0.2)), (25, 60, 0.2), (9, None, 0)])
    got = N.notes_of(hz, p, rms, hop)
    assert len(got) == 2 and got[0].struck and [n.midi for n in got] == [60.0, 60.0]
    assert len(N.notes_of(hz, p, np.full(len(hz), 0.2), hop)) == 1


def test_glides_and_neighbours():
    a, b, c = N.Note(0, 0.4, 60, 1), N.Note(0.4, 0.5, 62, 1), N.Note(0.5, 1, 64, 1)
    assert N.without_glides([a, b, c]) == [a._replace(end=0.45), c._replace(start=0.45)]
    assert N.without_glides([a, b._replace(end=0.6), c._replace(start=0.6)]) == [a, b._replace(end=0.6), c._replace(start=0.6)]  # too long
    assert N.without_glides([a._replace(struck=True), b, c]) == [a._replace(struck=True), b, c]
    assert N.without_glides([c._replace(start=0, end=0.4), b, a._replace(start=0.5, end=1)])[0].end == 0.45  # downwards
    d = N.Note(1, 1.2, 64.4, 0.5)
    assert N.joined([c, d]) == [N.Note(0.5, 1.2, 64.2, 0.75)] and N.joined([c._replace(struck=True), d]) == [c._replace(struck=True), d]
    assert len(N.joined([c, d._replace(start=1.1)])) == 2 and len(N.joined([c, d._replace(midi=65)])) == 2 and N.joined([]) == []


def test_gate_against_a_frame_by_frame_one():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 120))
        hz, p, rms = rng.choice([0, 50, 62, 80, 400, 1150, 1300], n), rng.choice([0.1, 0.16, 0.2, 0.23, 0.3, 0.4], n), rng.choice([0, 0.001, 0.02, 0.1], n)
        peak = np.percentile(rms[rms > 0], 95) if (rms > 0).any() else 1e-3
        state, want = False, []
        for h, q, r in zip(hz, p, rms, strict=True):
            loud = r >= max(1e-4, 0.1 * peak)
            if state:
                state = q >= (0.15 if loud else 0.22) and 60 <= h <= 1200
            else:
                state = q >= (0.22 if loud else 0.35) and 65 <= h <= 1100
            want.append(state)
        assert N.sounding(hz.astype(float), p, rms).tolist() == want


def test_pieces_tile_their_stretch():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 150))
        steady, dip = 60 + np.cumsum(rng.choice([0, 0, 0, 0, 1, -1, 3], n)).astype(float), rng.random(n) < 0.05
        got = list(N.pieces(steady, dip, 0, n, 4.0, 0.95, 4))
        assert [a for a, _, _ in got] == [0, *(b for _, b, _ in got[:-1])] and got[-1][1] == n
        for a, b, struck in got[:-1]:
            assert b > a and (not struck or dip[b] and b - a >= 4)
            if not struck:  # the four frames from the cut on lie off the median of what came before each
                assert all(abs(steady[i] - np.median(steady[a:i])) > 0.95 for i in range(b, b + 4))


def test_smoothed_labels():
    """What survives: no run of one step unless there is nothing else, no label from elsewhere, and steady labels as they are."""
    rng = random.Random(6)
    assert folds.smoothed(list("AABBB"), [1] * 5) == list("AABBB") and folds.smoothed(["A", "B"], [1, 1]) == ["A", "B"] and folds.smoothed([], []) == []
    assert folds.smoothed(list("AAXBB"), [1, 0.2, 0, 0.9, 1]) == list("AABBB")[:2] + ["B", "B", "B"]
    assert folds.smoothed(list("AAXBB"), [1, 0.9, 0, 0.2, 1]) == list("AAABB") and folds.smoothed(list("XAABB"), [1] * 5) == list("AAABB")
    for _ in range(300):
        labels = [rng.choice("AB") for _ in range(rng.randint(3, 20))]
        out = folds.smoothed(labels, [rng.random() for _ in labels])
        assert set(out) <= set(labels) and len(out) == len(labels)
        assert all(len(list(g)) > 1 for _, g in groupby(out))


def test_whole_keys():
    import pandas as pd

    rng = random.Random(1)
    keys = sorted(rng.choice([1, 2, 2, 2, 5, 9, 9]) for _ in range(200))
    rows = pd.DataFrame({"k": keys, "x": range(200)})
    for size in (1, 3, 50, 300):
        got = list(folds.whole_keys((rows.iloc[i : i + size] for i in range(0, 200, size)), "k"))
        assert pd.concat(got)["x"].tolist() == list(range(200))
        seen = [set(b["k"]) for b in got]
        assert all(not a & b for i, a in enumerate(seen) for b in seen[i + 1 :])
