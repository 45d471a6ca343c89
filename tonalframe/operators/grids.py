"""Measures of recordings: a grid grown from downbeats and beats, and notes cut by its bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.operators import folds

NEAR = 0.05


def measure_grid(tracks: DataFrame, beats: DataFrame, downbeats: DataFrame, notes: DataFrame) -> DataFrame:
    """track, measure (from 0), start, end, beats, times (of the beats, the end included). `tracks` has track, duration, tempo, per_bar; the others track and t (of notes, their start).

    With downbeats: those under 0.2 s after the last one kept go; beats before the first are a pickup, or, if it is late (0.5 s) and notes are earlier, the time before it; each downbeat begins a
    measure up to the next one, the last up to the end if that is more than 0.5 s on. A count of beats within one of the meter is the meter. Without downbeats, every `per_bar`
    beats make a measure; without beats too, measures follow the tempo (120 unless above 30)."""
    tracks = tracks.select("track", "duration", "tempo", F.col("per_bar").cast("double").alias("per_bar"))
    down = folds.fold(downbeats.select("track", "t").where("t >= 0"), "track", ["t"], ["t"], lambda x: folds.apart(x, 0.2), "keep", "boolean").where("keep").drop("keep")
    beats = beats.select("track", "t").where("t >= 0")
    w = Window.partitionBy("track")
    first = down.groupBy("track").agg(F.min("t").alias("d0"))
    spans = down.withColumn("next", F.lead("t").over(w.orderBy("t"))).join(tracks, "track")
    spans = spans.withColumn("end", F.coalesce("next", F.greatest("duration", "t"))).where("next is not null or end - t > 0.5")

    # Beats go to the last downbeat that is at most NEAR after them: one pass over both, in the order of time.
    marks = down.select("track", (F.col("t") - NEAR).alias("at"), F.lit(0).alias("kind"), F.col("t").alias("start"), F.lit(None).cast("double").alias("beat"))
    both = marks.unionByName(beats.select("track", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("start"), F.col("t").alias("beat")))
    owner = F.last("start", ignorenulls=True).over(w.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("start", owner).where("kind = 1 and start is not null").groupBy("track", "start").agg(F.array_sort(F.collect_list("beat")).alias("own"))
    spans = spans.withColumnRenamed("t", "start").join(inside, ["track", "start"], "left")
    own, start = F.coalesce("own", F.array().cast("array<double>")), F.col("start")
    led = (F.size(own) > 0) & (F.abs(F.get(own, F.lit(0)) - start) <= 0.1)
    times = F.when(led, own).otherwise(F.concat(F.array(start), F.filter(own, lambda b: b > start + NEAR)))
    ended = F.when(F.col("next").isNotNull() | (F.element_at("times", -1) < F.col("end") - NEAR), F.concat("times", F.array("end"))).otherwise(F.col("times"))
    spans = spans.withColumn("times", times).withColumn("times", ended)
    n = F.size("times") - 1
    meter = F.when((F.abs(n - F.col("per_bar")) <= 1) | (n <= 0), F.col("per_bar")).otherwise(n.cast("double"))
    columns = ["track", "start", "end", "beats", "times"]
    full = spans.withColumn("beats", meter).select(columns)

    early = beats.join(first, "track").where(F.col("t") < F.col("d0") - NEAR).groupBy("track", "d0").agg(F.array_sort(F.collect_list("t")).alias("own"))
    pickup = early.select("track", F.col("own")[0].alias("start"), F.col("d0").alias("end"), F.size("own").cast("double").alias("beats"), F.concat("own", F.array("d0")).alias("times"))
    sung = notes.groupBy("track").agg(F.min("t").alias("n0")).join(first.where("d0 > 0.5"), "track").where(F.col("n0") < F.col("d0") - 0.1).join(early.select("track"), "track", "left_anti").join(tracks, "track")
    tempo = F.when(F.coalesce(F.col("tempo"), F.lit(0.0)) != 0, F.col("tempo")).otherwise(120.0)
    sung = sung.select("track", F.lit(0.0).alias("start"), F.col("d0").alias("end"), F.greatest(F.lit(1.0), F.rint(F.col("d0") * tempo / 60)).alias("beats"), F.array(F.lit(0.0), F.col("d0")).alias("times"))

    plain = beats.join(first, "track", "left_anti").join(tracks, "track")
    plain = plain.withColumn("k", F.floor((F.row_number().over(w.orderBy("t")) - 1) / F.rint("per_bar")))
    plain = plain.groupBy("track", "k", "duration").agg(F.array_sort(F.collect_list("t")).alias("own"))
    plain = plain.withColumn("start", F.col("own")[0]).withColumn("end", F.coalesce(F.lead("start").over(w.orderBy("k")), F.greatest(F.col("duration"), F.col("start") + F.size("own") * 0.5)))
    plain = plain.select("track", "start", "end", F.size("own").cast("double").alias("beats"), F.concat("own", F.array("end")).alias("times"))

    bare = tracks.join(first, "track", "left_anti").join(beats.select("track").distinct(), "track", "left_anti")
    bare = bare.withColumn("beat", 60.0 / F.when(F.col("tempo") > 30, F.col("tempo")).otherwise(120.0)).withColumn("bar", F.col("per_bar") * F.col("beat"))
    bare = bare.withColumn("end_all", F.greatest("duration", "bar")).withColumn("count", F.greatest(F.lit(1), F.ceil(F.col("end_all") / F.col("bar")).cast("int")))
    bare = bare.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).withColumn("start", F.col("k") * F.col("bar"))
    steps = F.transform(F.sequence(F.lit(0), F.col("per_bar").cast("int")), lambda i: F.col("start") + i * F.col("beat"))
    bare = bare.select("track", "start", F.least("end_all", (F.col("k") + 1) * F.col("bar")).alias("end"), F.col("per_bar").alias("beats"), steps.alias("times"))

    found = full.unionByName(pickup).unionByName(sung).unionByName(plain).unionByName(bare)
    return found.withColumn("measure", (F.row_number().over(w.orderBy("start", "end")) - 1).cast("long"))


def cut_by_measures(notes: DataFrame, grid: DataFrame, least: float = 1e-9) -> DataFrame:
    """track, id, measure, start, end, tied (to the next piece): notes (track, id, start, end) cut at the bar lines of a grid of any widths. What lies outside the grid goes.

    A note's first and last measure are found by one pass over bar lines and ends in the order of time; then it meets just the measures between."""
    w = Window.partitionBy("track").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    lines = grid.select("track", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("measure").alias("m"), F.lit(None).cast("long").alias("id"))
    ends = [notes.select("track", F.col(c).alias("at"), F.lit(k).alias("kind"), F.lit(None).cast("long").alias("m"), "id") for c, k in (("start", 1), ("end", -1))]  # a note that ends on a line is not behind it
    met = lines.unionByName(ends[0]).unionByName(ends[1]).withColumn("m", F.last("m", ignorenulls=True).over(w)).where("kind <> 0")
    reach = met.groupBy("track", "id").agg(F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("m"))), F.lit(0)).alias("a"), F.max(F.when(F.col("kind") == -1, F.col("m"))).alias("z")).where("z is not null")
    each = notes.join(reach, ["track", "id"]).withColumn("measure", F.explode(F.sequence("a", F.greatest("a", "z"))))
    bars = grid.select("track", "measure", F.col("start").alias("_s"), F.col("end").alias("_e"))
    pieces = each.join(bars, ["track", "measure"]).select("track", "id", "measure", F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end")).where(F.col("end") - F.col("start") > least)
    return pieces.withColumn("tied", F.lead("measure").over(Window.partitionBy("track", "id").orderBy("measure")).isNotNull())
