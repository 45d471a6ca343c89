"""Notes cut out of pitch tracks: which frames sound, where one note ends and the next begins, and what of it is a glide or one note twice.

A track is one recording's frames of equal length. Gate, gap bridging, medians and dips are array operations over its frames; only the cutting of a
sounding stretch and the two passes over its notes go step by step.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

# Pitch ranges in Hz and periodicities that start and keep a sound (loud frames, soft frames).
STARTS, KEEPS = (65.0, 1100.0), (60.0, 1200.0)
START_AT, KEEP_AT = (0.22, 0.35), (0.15, 0.22)


class Note(NamedTuple):
    start: float
    end: float
    midi: float
    confidence: float
    struck: bool = False  # ended by a dip of the energy, so the next note is a new stroke


def median_of(values: np.ndarray, size: int) -> np.ndarray:
    """Running median, the ends repeated."""
    return np.median(sliding_window_view(np.pad(values, size // 2, mode="edge"), size), axis=1) if len(values) else values


def sounding(hz: np.ndarray, periodicity: np.ndarray, rms: np.ndarray) -> np.ndarray:
    """Frames of a sound: the last frame that decides, decides. Loud frames, a tenth of the track's peak or more, need less periodicity."""
    loud = rms >= max(1e-4, 0.10 * float(np.percentile(rms[rms > 0], 95))) if (rms > 0).any() else rms >= 1e-4
    inside = lambda low_high: (hz >= low_high[0]) & (hz <= low_high[1])
    on = (periodicity >= np.where(loud, *START_AT)) & inside(STARTS)
    off = (periodicity < np.where(loud, *KEEP_AT)) | ~inside(KEEPS)
    last = np.maximum.accumulate(np.where(on | off, np.arange(len(hz)), -1))
    return (last >= 0) & on[np.maximum(last, 0)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def pitches(hz: np.ndarray, on: np.ndarray, gap: int = 4, like: float = 1.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of a sound with short gaps between like pitches filled by a line, their pitch, and a steadier pitch to cut by."""
    pitch = np.zeros(len(hz))
    pitch[on] = median_of(69 + 12 * np.log2(np.maximum(1.0, hz[on]) / 440), 5)
    filled, own = on.copy(), np.flatnonzero(on)
    for a, b in runs(~on):
        if 0 < a < len(on) - 5 and b < len(on) and b - a <= gap and abs(pitch[b] - pitch[a - 1]) <= like and min(pitch[a - 1], pitch[b]) > 0:
            filled[a:b] = True
            pitch[a:b] = np.interp(np.arange(a, b), [a - 1, b], [pitch[a - 1], pitch[b]])
    steady = pitch.copy()
    steady[own] = median_of(pitch[own], 15)
    return filled, pitch, steady


def dips(rms: np.ndarray, on: np.ndarray, window: int = 30, depth: float = 0.35) -> np.ndarray:
    """Frames of a sound where the energy falls to a least value far under the loudest frame around."""
    out = np.zeros(len(rms), bool)
    if len(rms) > 10:
        peak = sliding_window_view(np.pad(rms, window // 2, mode="edge"), window).max(1)[: len(rms)]
        at = slice(2, len(rms) - 2)
        out[at] = (on & (peak > 1e-3) & (rms < depth * peak))[at] & (rms[at] <= rms[1:-3]) & (rms[at] < rms[3:-1])
    return out


def pieces(steady: np.ndarray, dip: np.ndarray, first: int, stop: int, shortest: float, wide: float, patience: int, settled: int = 8) -> Iterator[tuple[int, int, bool]]:
    """Cuts the sounding frames first..stop: at a dip once a note is `shortest` frames long, or where `patience` frames in a row lie farther than `wide`
    from the median of a settled note so far. Yields start, end, and whether a dip ended the piece."""
    start, at = first, first + 1
    while at <= stop:
        held, away, cut = sorted(steady[start:at].tolist()), 0, None
        for i in range(at, stop):
            if dip[i] and i - start >= shortest:
                cut, struck, at = i, True, i + 1
                break
            middle = (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2
            away = away + 1 if abs(steady[i] - middle) > wide else 0
            if away >= patience and i - start >= settled:
                cut, struck, at = i - away + 1, False, i + 1
                break
            insort(held, float(steady[i]))
        if cut is None:
            yield start, stop, False
            return
        yield start, cut, struck
        start = cut


def without_glides(notes: list[Note], shortest: float = 0.16, near: float = 0.05, step: float = 0.5) -> list[Note]:
    """A short note on the way from one pitch to another is shared between the two."""

    def glides(a: Note, b: Note, c: Note) -> bool:
        way = sorted((a.midi, c.midi))
        on_the_way = way[0] + step <= b.midi <= way[1] - step
        return on_the_way and b.end - b.start <= shortest and b.start - a.end <= near and c.start - b.end <= near and not (a.struck or b.struck)

    out, rest = [], deque(notes)
    while rest:
        a = rest.popleft()
        if len(rest) > 1 and glides(a, rest[0], rest[1]):
            b, c = rest.popleft(), rest.popleft()
            middle = round((b.start + b.end) / 2, 2)
            a = a._replace(end=middle)
            rest.appendleft(c._replace(start=middle))
        out.append(a)
    return out


def joined(notes: list[Note], like: float = 0.5, near: float = 0.06) -> list[Note]:
    """Neighbours of like pitch become one note, with the mean of both, unless a new stroke parts them."""

    def add(out: list[Note], n: Note) -> list[Note]:
        if out and not out[-1].struck and abs(n.midi - out[-1].midi) <= like and n.start - out[-1].end <= near:
            p = out.pop()
            n = Note(p.start, n.end, round((p.midi + n.midi) / 2, 1), round((p.confidence + n.confidence) / 2, 3), n.struck)
        out.append(n)
        return out

    return reduce(add, notes, [])


def notes_of(hz: np.ndarray, periodicity: np.ndarray, rms: np.ndarray, hop: float, wide: float = 0.95, patience: int = 4, least: float = 0.08) -> list[Note]:
    """Notes of a track whose frames are `hop` seconds long."""
    on = sounding(hz, periodicity, rms)
    on, pitch, steady = pitches(hz, on)
    dip, found = dips(rms, on), []
    for first, stop in runs(on):
        for a, b, struck in pieces(steady, dip, first, stop, least / hop, wide, patience):
            enough = b - a >= 8 if b == len(hz) else (b - a) * hop >= least  # what the track's end cuts off must be settled
            if enough:
                found.append(Note(round(a * hop, 2), round(b * hop, 2), round(float(np.median(pitch[a:b])), 1), round(float(np.mean(periodicity[a:b])), 3), struck))
    return [n for n in joined(without_glides(found)) if n.end - n.start >= least]
