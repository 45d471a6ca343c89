"""Chords of printed bars put on beats: page offset, snapping by meter and melody, and beats that rise within a bar. All column expressions; no chord is lost or moved to another bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalframe.functions.theory import let


def page_offsets(bars: DataFrame, page: list[str], least: int = 3) -> DataFrame:
    """page, delta: the median place, in beats, of opening chords that ought to stand on the first beat, 0.5 with fewer than `least`. `bars` has chords (array of
    struct with share: the place in the bar, 0 to 1, null without a box), beats and onsets.

    An opening chord counts if it is the bar's only one or the melody begins with the bar, and if it stands within the first beat."""
    at = F.get("chords", F.lit(0))["share"] * F.col("beats")
    led = (F.size("chords") == 1) | F.coalesce(F.abs(F.get("onsets", F.lit(0)) - 1.0) < 0.15, F.lit(False))
    sample = F.when((F.size("chords") > 0) & led & (at >= 0) & (at < 1), at)
    return bars.groupBy(*page).agg(F.when(F.count(sample) >= least, F.median(sample)).otherwise(0.5).alias("delta"))


def snapped(offset: Column, whole: float = 0.30) -> Column:
    """The nearest half beat, a whole one within reach first."""
    return F.when(F.abs(offset - F.rint(offset)) <= whole, F.rint(offset)).otherwise(F.rint(offset * 2) / 2)


def nearest(values: Column, at: Column) -> Column:
    """Of an array of numbers, the one nearest `at`, the lower of equals; null if there is none."""
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(at - v).alias("far"), v.alias("v"))))["v"]


def placed(chord: Column, delta: Column, beats: Column, onsets: Column) -> Column:
    """The beat of one chord (struct share, beat)."""
    free = chord["share"] * beats - delta  # in beats after the first
    at, read = free + 1.0, chord["beat"]
    grid = F.transform(F.sequence(F.lit(0), F.floor(beats / 3).cast("int") - 1), lambda k: 1.0 + k * 3.0)
    dotted = nearest(grid, at)
    compound = F.when(F.abs(at - dotted) <= 1.0, dotted).otherwise(1.0 + snapped(free))

    def by_melody(beat):
        half = F.abs(beat - F.rint(beat)) > 0.01
        sung = F.exists(onsets, lambda o: F.abs(beat - o) <= 0.15)
        note = nearest(onsets, at)
        return F.when(half & ~sung & (F.abs(at - note) <= 1.0), note).otherwise(beat)

    whole = F.abs(read - F.rint(read)) < 0.01
    simple = F.when(whole & (F.abs(at - read) < 0.70), read).otherwise(let(1.0 + snapped(free), by_melody))
    found = F.when(chord["share"].isNull(), read).when(beats.isin(6.0, 9.0, 12.0), compound).otherwise(simple)
    return F.greatest(F.lit(1.0), F.least(beats, found))


def rising(values: Column, beats: Column) -> Column:
    """Beats of a bar made strictly increasing: forward by half beats up to the last beat, backward by half beats down to the first, and what is still crowded shares the rest of the bar."""
    last = lambda a: F.element_at(a, -1)
    none = F.array().cast("array<double>")
    grown = lambda step: lambda a, v: F.when(F.size(a) == 0, F.array(v)).otherwise(F.concat(a, F.array(step(a, v))))
    forward = lambda x: F.aggregate(x, none, grown(lambda a, v: F.when(v <= last(a), F.least(beats, last(a) + 0.5)).otherwise(v)))
    backward = lambda x: F.reverse(F.aggregate(F.reverse(x), none, grown(lambda a, v: F.when(v >= last(a), F.greatest(F.lit(1.0), last(a) - 0.5)).otherwise(v))))

    def shared(x):
        rest = lambda a: (beats - last(a)) / (F.size(x) - F.size(a) + 1)
        return F.aggregate(x, none, grown(lambda a, v: F.when(v <= last(a), F.bround(last(a) + F.greatest(F.lit(0.1), rest(a)), 2)).otherwise(v)))

    return F.when(F.size(values) < 2, values).otherwise(let(let(forward(values), backward), shared))


def quantised(bars: DataFrame, page: list[str]) -> DataFrame:
    """`bars` with `quantised`, the beats of its chords in their order. `bars` has chords (array of struct share, beat), beats (double) and onsets (array of double, from 1)."""
    rows = bars.join(page_offsets(bars, page), page)
    snapped_ = F.transform("chords", lambda c: placed(c, F.col("delta"), F.col("beats"), F.col("onsets")))
    return rows.withColumn("_at", snapped_).withColumn("quantised", rising(F.col("_at"), F.col("beats"))).drop("_at")
