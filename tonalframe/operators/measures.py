"""Measures of a page or a recording: bar lines, widths, beats and places inside a measure.

What is gathered into an array has a bound in nature: the measures of one row or one page. All else is windows and joins on keys.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.functions.theory import let


def double_bars_merged(lines: DataFrame, key: list[str], x: str, tie: str, gap: int = 16) -> DataFrame:
    """key, x: bar lines in order, two neighbours at most `gap` apart as one line at their middle (towards zero).

    In a run of close lines the first goes with the second, the third with the fourth, and an odd last one stays alone.
    """
    w = Window.partitionBy(*key).orderBy(x, tie)
    far = F.coalesce(F.col(x) - F.lag(x).over(w) > gap, F.lit(True))
    runs = lines.withColumn("_far", far.cast("long")).withColumn("_run", F.sum("_far").over(w))
    at = F.row_number().over(Window.partitionBy(*key, "_run").orderBy(x, tie))
    pairs = runs.withColumn("_pair", F.floor((at - 1) / 2)).groupBy(*key, "_run", "_pair")
    return pairs.agg((F.sum(x) / F.count(x)).cast("long").alias(x)).drop("_run", "_pair")


def measure_of(boxes: DataFrame, measures: DataFrame, key: list[str], x: str, order: str) -> DataFrame:
    """boxes with `measure`: the place, from 0, of the measure (x0, x1) of the same row of a page that holds x.

    Before the first it is the first, behind the last the last; of several the earliest; in a gap the one with the nearest centre.
    A row without measures gives 0.
    """
    rows = measures.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "x0", "x1"))).alias("_m"))
    at, n = F.col(x), F.size("_m")
    choices = F.transform(
        "_m",
        lambda m, i: F.struct(
            (~at.between(m["x0"], m["x1"])).alias("off"),
            F.when(at.between(m["x0"], m["x1"]), 0.0).otherwise(F.abs(at - (m["x0"] + m["x1"]) / 2)).alias("away"),
            i.alias("i"),
        ),
    )
    found = F.when(at <= F.col("_m")[0]["x0"], 0).when(at >= F.element_at("_m", -1)["x1"], n - 1).otherwise(F.array_min(choices)["i"])
    return boxes.join(rows, key, "left").withColumn("measure", F.coalesce(found, F.lit(0)).cast("long")).drop("_m")


def partial_measures(measures: DataFrame, page: list[str], width: str, candidate: Column, beats: str, melody_beats: str, first: Column, pickup: Column) -> DataFrame:
    """measures with `ratio` (of their width to the median of the page's other widths) and `new_beats`.

    A candidate of 0.6 or less is a part of a bar: it gets the beats of its melody where these are fewer than the bar's, else its
    share of the bar in half beats. A full melody keeps its beats, but in a narrow (0.4) or marked pickup at the start of a row.
    Widths within 0.0001 of a measure's own do not count as others unless all are such; a width of 0 or less has no ratio.
    """
    wide = F.when(F.col(width) > 0, F.col(width).cast("double"))
    pages = measures.groupBy(*page).agg(F.array_sort(F.collect_list(wide)).alias("_all"))
    rows = measures.join(pages, page)
    own, full, sung = F.col(width), F.col(beats), F.col(melody_beats)
    others = F.filter("_all", lambda x: F.abs(x - own) > 1e-4)
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    median = let(F.when(F.size(others) > 0, others).otherwise(F.col("_all")), middle)
    rows = rows.withColumn("ratio", F.when(wide.isNotNull(), own / median))
    whole = sung >= full
    kept = F.coalesce(whole & ~(first & ((F.col("ratio") <= 0.4) | pickup)), F.lit(False))
    share = F.greatest(F.lit(0.5), F.least(full - 0.5, F.rint(F.col("ratio") * full * 2) / 2))
    less = F.when((sung > 0) & (sung < full), sung).otherwise(share)
    part = F.coalesce((F.col("ratio") <= 0.6) & candidate, F.lit(False)) & ~kept
    return rows.withColumn("new_beats", F.when(part, less).otherwise(full)).drop("_all")


def chord_beat_read(geometry: Column, read: Column, signature: Column, beats: Column, x: Column, x0: Column, x1: Column) -> Column:
    """A chord's beat: from its place, scaled to the bar in other meters than 4/4, unless a reading inside the bar is a beat or more away."""
    within = F.when(x1 > x0, (x - x0) / (x1 - x0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(within, (geometry - 1) / 4)))
    scaled = F.greatest(F.lit(1.0), F.least(beats, F.rint((1 + share * beats) * 2) / 2))
    four = F.coalesce(F.nullif(F.trim(signature), F.lit("")), F.lit("4/4")).isin("4/4", "C")
    by_place = F.when(four, geometry).otherwise(scaled)
    return let(by_place, lambda p: F.when((F.abs(read - p) >= 1) & read.between(F.lit(1.0), beats), read).otherwise(p))


def beat_in_measure(points: DataFrame, beats: DataFrame, key: list[str], start: Column, end: Column, total: float) -> DataFrame:
    """points (key, t) with `beat`, from 0 to `total`: piecewise linear between the measure's beat times (key, t), which split it evenly.

    Outside the beat times, or with fewer than two, the whole measure is one piece. One sort of both sides, no pairs.
    """
    t = F.col("t")
    ordered = Window.partitionBy(*key).orderBy("t")
    same = Window.partitionBy(*key)
    ticks = beats.select(*key, "t", F.row_number().over(ordered).alias("_i"), F.lead("t").over(ordered).alias("_next"))
    tick = F.struct(F.col("t").alias("at"), "_i", "_next")
    both = points.withColumn("_tick", F.lit(None).cast("struct<at: bigint, _i: int, _next: bigint>")).withColumn("_is", F.lit(0))
    both = both.unionByName(ticks.select(*key, "t", tick.alias("_tick"), F.lit(1).alias("_is")), allowMissingColumns=True)
    # A point stands before the beats of its own time, so that the piece it ends counts.
    before = Window.partitionBy(*key).orderBy("t", "_is", "_tick._i")
    rows = both.withColumn("_last", F.last("_tick", ignorenulls=True).over(before)).withColumn("_n", F.sum("_is").over(same))
    rows = rows.withColumn("_from", F.min("_tick.at").over(same))
    rows = rows.withColumn("_equal", F.sum(((F.col("_is") == 1) & (F.col("_tick.at") == F.col("_from"))).cast("int")).over(same))
    last, pieces = F.col("_last"), F.col("_n") - 1
    inside = last["_i"] - 1 + (t - last["at"]) / F.nullif(last["_next"] - last["at"], F.lit(0))
    at_first = F.when((t == F.col("_from")) & (F.col("_equal") <= pieces), F.col("_equal") - 1)
    by_piece = F.when(pieces > 0, F.coalesce(inside, at_first)) * (F.lit(total) / F.nullif(pieces, F.lit(0)))
    plain = (t - start) / (end - start) * total
    beat = F.when(t <= start, 0.0).when(t >= end, total).otherwise(F.coalesce(by_piece, plain))
    return rows.where("_is = 0").withColumn("beat", beat).drop("_tick", "_is", "_last", "_n", "_from", "_equal")


def nearest_free(chars: list[float], notes: list[float], reach: float = 2.0) -> list[int]:
    """For each character, in order, the nearest note not yet taken within `reach`, the earliest of equals; -1 where there is none.

    Notes ascend. Taken notes are skipped by links to the next free one on either side, so long songs stay near linear.
    """
    left, right = list(range(len(notes) + 1)), list(range(len(notes) + 1))

    def free(link: list[int], k: int) -> int:
        while link[k] != k:
            link[k] = link[link[k]]
            k = link[k]
        return k

    out = []
    for c in chars:
        k = bisect_left(notes, c)
        after, before = free(right, k), free(left, k) - 1  # left holds places plus one, 0 for none
        if before >= 0:
            before = free(right, bisect_left(notes, notes[before]))  # the earliest of one time
        away, best = min(((abs(notes[i] - c), i) for i in (before, after) if 0 <= i < len(notes)), default=(reach + 1, -1))
        if away > reach:
            out.append(-1)
            continue
        out.append(best)
        right[best], left[best + 1] = best + 1, best
    return out
