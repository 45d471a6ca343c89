"""Alignment and decoding of short sequences by dynamic programming, one song at a time, and set-based search for shapes.

Songs have tens to hundreds of steps; groups are songs, so the work spreads over them whatever the corpus.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalframe.operators.alignment import aligned
from tonalframe.operators.folds import by_song

def aligned_songs(a: DataFrame, b: DataFrame, key: str, order: str, **options) -> DataFrame:
    """Two readings (key, order, root, bass, quality) aligned song by song: key, i, j (places, -1 for a gap), pair score, total."""
    return aligned(a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1))), key, "_side", order, **options)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of a longest common subsequence of two short arrays, as an expression."""

    def row(before, x):
        def cell(now, j):
            got = F.when(F.element_at(b, j) == x, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(now, j)))
            return F.concat(now, F.array(got))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    zero = F.array_repeat(F.lit(0), F.size(b) + 1)
    long = F.element_at(F.aggregate(a, zero, row), -1)
    # Where b fits into the bits of a number, a row of the table is one: a bit for each step, 0 where the length grows there. Both run backwards, as bits are pushed in.
    bit = lambda y, x: F.when(y == x, F.lit(1)).otherwise(F.lit(0)).cast("long")
    places = F.transform(a, lambda x: F.aggregate(b, F.lit(0).cast("long"), lambda u, y: F.shiftleft(u, 1).bitwiseOR(bit(y, x))))
    bits = F.aggregate(F.reverse(places), F.lit(-1).cast("long"), lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.size(b) <= 62, F.bit_count(F.bitwise_not(bits))).otherwise(long)


# Registers and weights of bass lines, the open strings of a ukulele.
LOW_BASS, HIGH_BASS, CENTRE_BASS = 36, 52, 43
OPEN_STRINGS = [7, 0, 4, 9]


def bass_line(pcs: list[int]) -> list[int]:
    """Pitches for bass pitch classes that move least, by dynamic programming; the lower of equals first."""
    pitches = [np.array([p for p in range(LOW_BASS, HIGH_BASS + 1) if p % 12 == pc % 12]) for pc in pcs]
    cost, back = 0.5 * np.abs(pitches[0] - CENTRE_BASS), []
    for before, now in zip(pitches, pitches[1:], strict=False):
        d = np.abs(now[None, :] - before[:, None])
        step = 0.8 * d - 2.0 * np.isin(d, (1, 2)) - np.isin(d, (3, 4)) + 3.0 * (d >= 7)
        total = cost[:, None] + step + 0.3 * np.abs(now - CENTRE_BASS)[None, :]
        back.append(total.argmin(0))
        cost = total.min(0)
    at = [int(cost.argmin())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return [int(p[i]) for p, i in zip(pitches, reversed(at), strict=True)]


def voicings(pcs: list[int], low: int = 64, high: int = 81, span: int = 14) -> list[tuple[int, ...]]:
    """Close positions of a chord's tones (four at most) in the right hand's register, lowest first."""
    places = [[m for m in range(low, high + 1) if m % 12 == pc] for pc in pcs[:4]]
    found = {tuple(sorted(x)) for x in itertools.product(*places) if len(set(x)) == len(x) and max(x) - min(x) <= span}
    return sorted(found) or [tuple(sorted({p[0] for p in places}))]


def voicing_cost(v: tuple[int, ...]) -> float:
    """Register, span and a black key under the thumb. Best top notes 71 to 76 around 73."""
    top, width = v[-1], v[-1] - v[0]
    drift = 0.8 * (71 - top) ** 2 if top < 71 else 0.8 * (top - 76) ** 2 if top > 76 else 0.2 * abs(top - 73)
    return drift + 1.2 * max(0, width - 10) + 2.0 * (v[0] % 12 in (1, 3, 6, 8, 10))


def voicing_move(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Voice movement less a reward for common tones."""
    if len(a) == len(b):
        far = sum(abs(x - y) for x, y in zip(a, b, strict=True))
    else:
        far = (sum(min(abs(x - y) for y in a) for x in b) + sum(min(abs(x - y) for y in b) for x in a)) / 2 + 2.0 * abs(len(a) - len(b))
    return far - 3.0 * len(set(a) & set(b))


def voice_leading(chords: list[list[int]], known: dict) -> list[tuple[int, ...]]:
    """The cheapest voicings of a sequence of pitch-class lists, the first of equals; `known` keeps costs between songs."""
    options = [voicings(c) for c in chords]
    cost, back = np.array([voicing_cost(v) for v in options[0]]), []
    for a, b in itertools.pairwise(options):
        key = (tuple(a), tuple(b))
        if key not in known:
            known[key] = np.array([[voicing_move(x, y) for y in b] for x in a]), np.array([voicing_cost(y) for y in b])
        moves, own = known[key]
        total = cost[:, None] + moves
        back.append(total.argmin(0))
        cost = total.min(0) + own
    at = [int(cost.argmin())]
    for step in reversed(back):
        at.append(int(step[at[-1]]))
    return [o[i] for o, i in zip(options, reversed(at), strict=True)]


def shape_moves(a: np.ndarray, b: np.ndarray, barre_a: np.ndarray, barre_b: np.ndarray) -> np.ndarray:
    """Cost of changes between shapes (n, 4) and (m, 4): strings that change, the way of the hand, a barre that comes or goes, less fingers and open strings that stay."""
    same = a[:, None] == b[None]
    held, open_ = (same & (a[:, None] > 0)).sum(2), (same & (a[:, None] == 0)).sum(2)
    jump = np.abs(a.max(1)[:, None] - b.max(1)[None])
    return 0.5 * (~same).sum(2) + 0.7 * jump + 1.0 * (barre_a[:, None] != barre_b[None]) - 1.5 * held - 0.4 * open_


def shape_path(chords: list, sections: list, options: dict, keep: float = 4.0, change: float = 3.0) -> list[int]:
    """Which of its options each chord of a song takes, at the least cost, the first of equals. `options`: of a chord, frets (n, 4) and costs (n,), the cheapest first.

    A chord that follows itself in its section is drawn to its shape: the same one gains `keep`, another loses `change`."""
    frets, own = options[chords[0]]
    cost, back = own.copy(), []
    for before, now, sec_a, sec_b in zip(chords, chords[1:], sections, sections[1:], strict=False):
        a, (b, own) = options[before][0], options[now]
        barre = [np.array([len({f for f in x if f > 0}) < (x > 0).sum() and x.min() > 0 for x in v], bool) for v in (a, b)]
        moves = shape_moves(a, b, *barre)
        if before == now and sec_a == sec_b:
            moves = moves + np.where((a[:, None] == b[None]).all(2), -keep, change)
        total = np.round(cost[:, None] + moves, 9)
        back.append(total.argmin(0))
        cost = total.min(0) + own
    at = [int(cost.argmin())]
    for step in reversed(back):
        at.append(int(step[at[-1]]))
    return at[::-1]


def viterbi(observed: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best path through states for log scores (steps, states) and move scores (states, states); the lowest state of equals."""
    best, back = observed[0].copy(), []
    for o in observed[1:]:
        total = best[:, None] + moves
        back.append(total.argmax(0))
        best = total.max(0) + o
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def decoded(frames: DataFrame, key: str, order: str, vector: str, states: int, change: float) -> DataFrame:
    """Each frame's state by Viterbi over its first `states` values, floored and in logs; a change costs `change`. Also the plain arg-max."""
    def one(c: dict) -> dict:
        x = np.abs(np.stack(c[vector])[:, :states].astype(float))
        moves = np.where(np.eye(states, dtype=bool), 0.0, -change)
        path = viterbi(np.log(np.maximum(1e-7, x / x.sum(1, keepdims=True))), moves)
        return {key: c[key], order: c[order], "state": path, "plain": x.argmax(1)}

    kind = dict(frames.dtypes)
    return by_song(frames, key, [order], one, f"{key} {kind[key]}, {order} {kind[order]}, state int, plain int")


def _frets(pc: int, frets: int) -> Column:
    """Frets of a string with open pitch class pc that sound a tone of `pcs`."""
    return F.filter(F.sequence(F.lit(0), F.lit(frets)), lambda f: F.array_contains("pcs", F.pmod(f + pc, F.lit(12))))


def shapes(chords: DataFrame, frets: int = 12, span: int = 3) -> DataFrame:
    """All fingerings of chords (root, quality, pcs, needed) on four strings: root, quality, f0-f3, cost.

    Each string offers the frets that sound a chord tone, so the strings are exploded one after the other, not crossed whole.
    """
    rows = chords
    for k, pc in enumerate(OPEN_STRINGS):
        rows = rows.withColumn(f"f{k}", F.explode(_frets(pc, frets)))
        pressed = F.filter(F.array(*[F.col(f"f{i}") for i in range(k + 1)]), lambda f: f > 0)
        rows = rows.where((F.size(pressed) == 0) | (F.array_max(pressed) - F.array_min(pressed) <= span))
    f = [F.col(f"f{k}") for k in range(4)]
    sounding = F.array(*[F.pmod(x + pc, F.lit(12)) for x, pc in zip(f, OPEN_STRINGS, strict=True)])
    rows = rows.where(F.size(F.array_except("needed", sounding)) == 0)
    pressed = F.filter(F.array(*f), lambda x: x > 0)
    wide = F.when(F.size(pressed) > 0, F.array_max(pressed) - F.array_min(pressed)).otherwise(0)
    top = F.coalesce(F.array_max(pressed), F.lit(0))
    cost = 2.0 * F.size(pressed) + top + 2.0 * F.greatest(top - 4, F.lit(0)) + 1.5 * wide - 1.5 * (4 - F.size(pressed))
    return rows.select("root", "quality", "f0", "f1", "f2", "f3", cost.alias("cost"))
