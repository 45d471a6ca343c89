"""Fingers for chords and runs of one hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fingers(*values: int) -> Column:
    return F.array(*map(F.lit, values))


def right_hand(pitches: Column) -> Column:
    """Fingers of a chord's pitches, ascending: the thumb below, the little finger above; gaps and close seconds decide between."""
    gap = lambda i: F.get(pitches, F.lit(i + 1)) - F.get(pitches, F.lit(i))
    low, high = gap(0), gap(1)
    two = F.when(low <= 4, _fingers(1, 3)).when(low <= 7, _fingers(1, 4)).otherwise(_fingers(1, 5))
    close = _fingers(1, 2, 4)
    three = (
        F.when(low <= 2, F.when(high >= 4, _fingers(1, 2, 5)).otherwise(close)).when(high <= 2, F.when(low >= 4, _fingers(1, 3, 5)).otherwise(close))
        .when((high > 4) & ((low <= 4) | (high > low)), _fingers(1, 2, 5)).otherwise(_fingers(1, 3, 5))
    )
    four = F.when(low > gap(2), _fingers(1, 2, 4, 5)).otherwise(_fingers(1, 2, 3, 5))
    n = F.size(pitches)
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, _fingers(1)).when(n == 2, two).when(n == 3, three).when(n == 4, four).otherwise(_fingers(1, 2, 3, 4, 5))


def left_hand(pitches: Column) -> Column:
    """Fingers of a chord's pitches, ascending: from the little finger to the thumb, wide spans with a nearer one."""
    n, span = F.size(pitches), F.element_at(pitches, -1) - F.get(pitches, F.lit(0))
    two = F.when(span >= 8, _fingers(5, 1)).when(span >= 5, _fingers(5, 2)).otherwise(_fingers(5, 3))
    three = F.when((span >= 11) & (span < 14), _fingers(5, 2, 1)).otherwise(_fingers(5, 3, 1))
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, _fingers(5)).when(n == 2, two).when(n == 3, three).when(n == 4, _fingers(5, 4, 2, 1)).otherwise(_fingers(5, 4, 3, 2, 1))


def run_finger(i: Column, n: Column, rising: Column, midi: Column, chord_finger: Column) -> Column:
    """The finger of note i (from 0) of a run of n single notes: a falling run of up to five ends on the thumb, a rising one begins there; others take
    the chord's finger on that key, or one by register. `rising`: 1 if every note is above the one before, -1 if below, else 0."""
    falls = F.when(n <= 5, n - i).otherwise(5)
    rises = F.when(i < 5, i + 1)
    by_place = F.when(midi <= 67, 1).when(midi <= 71, 2).when(midi <= 74, 3).when(midi <= 77, 4).otherwise(5)
    led = F.when((n >= 2) & (rising < 0), falls).when((n >= 2) & (rising > 0), rises)
    return F.coalesce(led, F.when((n >= 2) & (rising != 0), by_place), chord_finger, by_place).cast("int")
