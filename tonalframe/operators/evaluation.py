"""A reading of a song held against the truth: rows, measures, chords, beats and key changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.operators.sequences import lcs_length

PLACE = ["song", "row", "measure"]


def _share(a: Column, n: Column, none: float | Column = 1.0) -> Column:
    return F.bround(F.when(n > 0, a / F.nullif(n, F.lit(0))).otherwise(none), 3)


def changes_met(truth: Column, read: Column, reach: int = 2) -> Column:
    """How many key changes (arrays of struct measure, semitones) are met: each takes the first one left of the same step within `reach` measures."""

    def take(state, change):
        fits = F.transform(state["rest"], lambda c, i: F.when((c["semitones"] == change["semitones"]) & (F.abs(c["measure"] - change["measure"]) <= reach), i))
        at = F.array_min(fits)
        return F.when(at.isNull(), state).otherwise(F.struct((state["n"] + 1).alias("n"), F.filter(state["rest"], lambda c, i: i != at).alias("rest")))

    return F.aggregate(truth, F.struct(F.lit(0).alias("n"), read.alias("rest")), take, lambda s: s["n"])


def song_scores(measures: DataFrame, read_measures: DataFrame, chords: DataFrame, read_chords: DataFrame, changes: DataFrame, read_changes: DataFrame) -> DataFrame:
    """song and nine shares: row_count, measures_per_row, measures_strict, chords_exact, precision, sequence, beats (half a beat), beats_strict, key_changes.

    Measures are (song, row, measure), chords (song, row, measure, k, raw, beat) in their order k, changes (song, measure: from the song's start, semitones). Chords of the truth read "?" do not
    count. Chords are matched one to one by measure and name, in order; a measure is strict if its lists are equal; sequence is the longest common subsequence of each row."""
    c = F.col
    true, seen = c("_side") == 0, c("_side") == 1
    side = lambda df, n, *columns: df.select(*columns, F.lit(n).alias("_side"))
    # Both sides are dealt by rows of songs together: measures as a list a row, chords one by one. All that follows works on what lies together.
    spots = side(measures, 0, *PLACE).unionByName(side(read_measures, 1, *PLACE)).groupBy("song", "row").agg(*(F.collect_list(F.when(of, c("measure"))).alias(name) for of, name in ((true, "i"), (seen, "j"))))
    columns = [*PLACE, "raw", "k", "beat"]
    listed = side(chords.where("raw <> '?'"), 0, *columns).unionByName(side(read_chords, 1, *columns)).repartition("song", "row")
    nth = F.row_number().over(Window.partitionBy(*PLACE, "raw", "_side").orderBy("k", "beat"))
    both = listed.withColumn("_n", nth).groupBy(*PLACE, "raw", "_n").agg(
        F.count_if(true).alias("a"), F.count_if(seen).alias("b"), F.max(F.when(true, c("k"))).alias("k_a"), F.max(F.when(seen, c("k"))).alias("k_b"),
        F.max(F.when(true, c("beat"))).alias("beat_a"), F.max(F.when(seen, c("beat"))).alias("beat_b"),
    )
    a, b, off = c("a") > 0, c("b") > 0, F.abs(c("beat_a") - c("beat_b"))
    chosen = lambda when, k: F.array_sort(F.collect_list(F.when(when, F.struct("measure", c(k).alias("k"), "raw"))))
    by_row = both.groupBy("song", "row").agg(
        F.count_if(a).alias("truth"), F.count_if(b).alias("read"), F.count_if(a & b).alias("met"), F.count_if(a & b & (off <= 0.5)).alias("near"), F.count_if(a & b & (off < 1e-4)).alias("same"),
        chosen(a, "k_a").alias("x"), chosen(b, "k_b").alias("y"),
    )
    names = lambda x: F.transform(x, lambda e: e["raw"])
    inside = lambda x, spot: names(F.filter(x, lambda e: e["measure"] == spot))
    strict = F.size(F.filter(F.array_intersect("i", "j"), lambda spot: F.coalesce(inside(c("x"), spot) == inside(c("y"), spot), F.lit(True))))
    x, y = names(c("x")), names(c("y"))
    lcs = F.when(F.size("i") > 0, F.when(x == y, F.size(x)).otherwise(lcs_length(x, y)))
    by_row = spots.join(by_row, ["song", "row"], "full").select("song", *(F.coalesce(F.size(n), F.lit(0)).alias(m) for n, m in (("i", "n"), ("j", "m"))), "truth", "read", "met", "near", "same", strict.alias("strict"), lcs.alias("lcs"))
    found = by_row.groupBy("song").agg(
        F.count_if(c("n") > 0).alias("rows"), F.count_if(c("m") > 0).alias("read_rows"), F.count_if((c("n") > 0) & (c("n") == c("m"))).alias("like"), F.sum("n").alias("measures"),
        *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("truth", "read", "met", "near", "same", "strict", "lcs")),
    ).where("rows > 0")

    turns = lambda df, side: df.select("song", F.lit(side).alias("_side"), F.struct("measure", "semitones").alias("_turn"))
    turned = lambda when: F.array_sort(F.collect_list(F.when(when, c("_turn"))))
    found = found.join(turns(changes, 0).unionByName(turns(read_changes, 1)).groupBy("song").agg(turned(true).alias("x"), turned(seen).alias("y")), "song", "left")
    x, y = (F.coalesce(n, F.array().cast("array<struct<measure:bigint,semitones:int>>")) for n in ("x", "y"))
    keys = F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(changes_met(x, y) / F.greatest(F.size(x), F.size(y)))
    return found.select(
        "song", F.bround(F.least("rows", "read_rows") / F.greatest("rows", "read_rows", F.lit(1)), 3).alias("row_count"), _share(c("like"), c("rows")).alias("measures_per_row"),
        _share(c("strict"), c("measures")).alias("measures_strict"), _share(c("met"), c("truth")).alias("chords_exact"), _share(c("met"), c("read"), F.when(c("truth") == 0, 1.0).otherwise(0.0)).alias("precision"),
        _share(c("lcs"), c("truth")).alias("sequence"), _share(c("near"), c("met")).alias("beats"), _share(c("same"), c("met")).alias("beats_strict"), F.bround(keys, 3).alias("key_changes"),
    )
