"""Melody notation and beat grids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_note = re.compile(r"(?:([#b♯♭])(?=[0-7iI])|\.(?=[0-7iI]))?([0-7iI]|[-–—﹣−])([#b♯♭])?(\.)?")
_signs = {"#": 1, "♯": 1, "b": -1, "♭": -1, None: 0}


def token_notes(token: str) -> list[tuple[int, int, bool]]:
    """(degree, accidental, dotted) of the notes in a token; 0 rests, -1 holds."""
    out = []
    for sign, name, after, dot in (m.groups() for m in _note.finditer(re.sub("['`\"]", "", token))):
        degree = 1 if name in "iI" else int(name) if name.isdigit() else -1
        out.append((degree, _signs[after] if after else _signs[sign], bool(dot)))
    return out


def durations(tokens: list[list[tuple[int, int, bool]]], beats: float) -> list[float]:
    """Beats of each token. Only bars of four beats are squeezed or dotted in pairs; in too short bars a dotted note lasts 1.5."""
    n, out = len(tokens), [1.0] * len(tokens)
    single = [len(t) == 1 for t in tokens]
    if beats == 4 and n == 4:
        for i in range(n - 1):
            if single[i] and tokens[i][0][2] and single[i + 1] and not tokens[i + 1][0][2]:
                out[i], out[i + 1] = 1.5, 0.5
    elif beats == 4 and n > 4:
        plain = [i for i in range(n) if single[i] and not tokens[i][0][2] and tokens[i][0][0] != -1]
        for i in plain[: 2 * (n - 4)]:
            out[i] = 0.5
    elif n < beats:
        out = [1.5 if s and t[0][2] else 1.0 for s, t in zip(single, tokens, strict=True)]
    return out


def parse(text: str | None, beats: float = 4.0) -> tuple[list[tuple[float, int, int]], float] | None:
    """Notes (onset from 1, degree, accidental) and the sum of beats; None for text without any note."""
    if not (text or "").strip():
        return [], 0.0
    tokens = [t for t in map(token_notes, text.split()) if t]
    if not tokens:
        return None
    lengths, at, notes = durations(tokens, beats), 1.0, []
    for token, length in zip(tokens, lengths, strict=True):
        if len(token) == 2 and any(x[2] for x in token):
            parts = [0.75, 0.25] if token[0][2] else [0.25, 0.75]
        else:
            parts = [1 / len(token)] * len(token)
        onset = at
        for (degree, sign, _), part in zip(token, parts, strict=True):
            if degree > 0:
                notes.append((round(onset, 3), degree, sign))
            onset += part * length
        at += length
    return notes, round(sum(lengths), 3)


def snap_to_grid(x: Column, whole: float = 0.3) -> Column:
    """The whole beat within reach, else the nearest half."""
    return F.when(F.abs(x - F.rint(x)) <= whole, F.rint(x)).otherwise(F.rint(x * 2) / 2)


def snap_onset(x: Column) -> Column:
    half = F.rint(x * 2) / 2
    return F.greatest(F.lit(0.0), F.when(F.abs(x - half) <= 0.16, half).otherwise(F.rint(x * 4) / 4))


def snap_duration(x: Column) -> Column:
    return F.greatest(F.lit(0.25), F.rint(x * 4) / 4)


def chord_beat(x: Column, beats: int) -> Column:
    """A chord's beat on the grid of its meter."""
    four = F.when(x <= 1.45, 1.0).when(x < 2.55, 2.0).when(x <= 3.45, 3.0).otherwise(4.0)
    return four if beats == 4 else F.greatest(F.lit(1.0), F.least(F.lit(float(beats)), F.rint(x)))


def beats_printed(signature: Column) -> Column:
    """Beats of a bar as charts count them: the upper number."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(signature, "^([0-9]+)/[0-9]+$", 1), F.lit("")), F.lit("99")).cast("double"), F.lit(4.0))


def beats_sounding(signature: Column) -> Column:
    """Beats of a bar in quarters, as recordings count them."""
    lower = F.try_to_number(F.nullif(F.regexp_extract(signature, "^[0-9]+/([0-9]+)$", 1), F.lit("")), F.lit("99")).cast("double")
    return F.coalesce(F.try_divide(beats_printed(signature) * 4, lower), F.lit(4.0))


def midi_of(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440)


def octave_of(midi: Column, tonic: Column) -> Column:
    """Octaves above the one that starts at the tonic over middle C, two either way at most."""
    return F.greatest(F.lit(-2), F.least(F.lit(2), F.floor((midi - 60 - tonic) / 12)))
