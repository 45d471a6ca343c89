"""Queries of page layout, stacked chords, note names and fingers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.functions import fingering as H
from tonalframe.functions import spelling as N
from tonalframe.functions import theory as T
from tonalframe.operators import folds
from tonalframe.operators import layout as L
from tonalframe.operators import orientation as O
from tonalframe.plans import shims
from tonalframe.plans.consensus import long_bars
from tonalframe.plans.registry import query


@query()
def stacked_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of a chart's stacked chords is the bass (F25): long charts whose chords are two degrees, one in six charts with qualities on one of them."""
    p, s, source = F.col("bp"), F.col("bs"), F.col("source")
    a, b, q = (p % 7 + 1).cast("string"), (6 - F.col("bar") % 7 + 1).cast("string"), F.when(s % 3 == 0, "m").otherwise("7")
    raw = F.when(p % 4 == 0, a).when(p % 4 == 1, F.concat(b, F.lit("/9"))).otherwise(F.concat(F.when(source % 12 == 1, F.concat(a, q)).otherwise(a), F.lit("/"), F.when(source % 12 == 7, F.concat(b, q)).otherwise(b)))
    melody = F.when(s % 5 > 0, F.concat(F.lit("0 "), ((p + s) % 7 + 1).cast("string"), F.lit(" 3")))
    return O.stacked_orientation(long_bars(spark, sf_dir).select("source", "bar", raw.alias("raw"), melody.alias("melody")), "source", ["bar"])


NAMES = T.sql_rows((k * 12 + p, N.spelled(key, p)) for k, key in enumerate(T.DEFAULT_KEYS) for p in range(12))


@query(shims.with_shims("SELECT series, id, name FROM notes JOIN names ON names.i = series % 12 * 12 + midi % 12", notes=shims.NOTES, names=f"SELECT * FROM (VALUES {NAMES}) v(i, name)"))
def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes named in the key of their song (F9); tests hold the names against the scales of all keys."""
    return shims.notes(spark, sf_dir).select("series", "id", N.note_name(F.col("midi"), F.col("series")).alias("name"))


@query()
def pruned_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar lines of printed rows without those that make narrow measures, and how regular the row is (C11)."""
    p, s = F.col("p"), F.col("s")
    lines = F.explode(F.filter(F.array((F.col("bar") * 160 + s % 23).cast("double"), F.when(p % 4 == 0, (F.col("bar") * 160 + 18 + s % 90).cast("double"))), lambda x: x.isNotNull())).alias("x")
    rows = shims.chords(spark, sf_dir).select("chart", lines)

    def use(c: dict) -> dict:
        bars = c["x"].tolist()
        valid, score, _ = L.regularity(bars, len(bars))
        kept = L.pruned(bars, 0.12 * (bars[-1] - bars[0]))
        return {"chart": [c["chart"][0]] * len(kept), "x": kept, "valid": [valid] * len(kept), "score": [score] * len(kept)}

    return folds.by_song(rows, "chart", ["x"], use, "chart long, x double, valid int, score double")


@query()
def row_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of long charts broken into rows of a page by what they need."""
    rows = long_bars(spark, sf_dir).select("source", "bar", (70.0 * F.col("n") + 60 + F.col("bp") % 120).alias("need"), (F.col("bar") % 9 == 0).alias("new"))
    return folds.fold(rows, "source", ["bar"], ["need", "new"], lambda need, new: L.rows_of(need, new, 900.0), "row", "int")


PITCHES = "SELECT chart, bar, list_sort(list_distinct(list_transform(range(0, 1 + p % 6), lambda k: 60 + (s + k * (2 + p % 4)) % 19))) AS m FROM chords"


@query(shims.with_shims("""
SELECT chart, bar, m AS pitches, CAST(CASE len(m) WHEN 1 THEN [1] WHEN 2 THEN CASE WHEN m[2] - m[1] <= 4 THEN [1, 3] WHEN m[2] - m[1] <= 7 THEN [1, 4] ELSE [1, 5] END
    WHEN 3 THEN CASE WHEN a <= 2 THEN CASE WHEN b >= 4 THEN [1, 2, 5] ELSE [1, 2, 4] END WHEN b <= 2 THEN CASE WHEN a >= 4 THEN [1, 3, 5] ELSE [1, 2, 4] END WHEN b <= 4 THEN [1, 3, 5] WHEN a <= 4 OR b > a THEN [1, 2, 5] ELSE [1, 3, 5] END
    WHEN 4 THEN CASE WHEN a > m[4] - m[3] THEN [1, 2, 4, 5] ELSE [1, 2, 3, 5] END ELSE [1, 2, 3, 4, 5] END AS INTEGER[]) AS right_hand,
  CAST(CASE len(m) WHEN 1 THEN [5] WHEN 2 THEN CASE WHEN z >= 8 THEN [5, 1] WHEN z >= 5 THEN [5, 2] ELSE [5, 3] END WHEN 3 THEN CASE WHEN z BETWEEN 11 AND 13 THEN [5, 2, 1] ELSE [5, 3, 1] END WHEN 4 THEN [5, 4, 2, 1] ELSE [5, 4, 3, 2, 1] END AS INTEGER[]) AS left_hand
FROM (SELECT *, m[2] - m[1] AS a, m[3] - m[2] AS b, m[-1] - m[1] AS z FROM pitches)""", chords=shims.CHORDS, pitches=PITCHES))
def chord_fingers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingers of block chords in either hand (N5); a hand has five."""
    p, s = F.col("p"), F.col("s")
    pitches = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), p % 6), lambda k: 60 + (s + k * (2 + p % 4)) % 19)))
    rows = shims.chords(spark, sf_dir).select("chart", "bar", pitches.alias("pitches"))
    return rows.withColumn("right_hand", H.right_hand(F.col("pitches"))).withColumn("left_hand", H.left_hand(F.col("pitches")))


@query()
def played_fingers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingers of single notes in runs (a player's notes within an hour of each other, up to the next turn), and what is wrong with them (N5, Q1h)."""
    w = Window.partitionBy("series", "day").orderBy("start", "id")
    rows = shims.notes(spark, sf_dir).select("series", F.floor(F.col("start") / 86_400_000_000).alias("day"), "id", "start", (60 + F.col("midi") % 20).alias("midi"))
    up = F.signum(F.col("midi") - F.lag("midi").over(w)).cast("int")
    rows = rows.withColumn("up", up).withColumn("near", F.coalesce(F.col("start") - F.lag("start").over(w) < 3_600_000_000, F.lit(False)))
    turn = ~F.col("near") | (F.lag("near").over(w) & (F.col("up") != F.lag("up").over(w)))
    rows = rows.withColumn("run", F.sum(F.coalesce(turn, ~F.col("near")).cast("int")).over(w))
    own = Window.partitionBy("series", "day", "run")
    i = F.row_number().over(own.orderBy("start", "id")) - 1
    rows = rows.withColumn("i", i).withColumn("n", F.count(F.lit(1)).over(own))
    inner = F.when(F.col("i") > 0, F.col("up"))
    rows = rows.withColumn("rising", F.when(F.min(inner).over(own) == 1, 1).when(F.max(inner).over(own) == -1, -1).otherwise(0))
    rows = rows.withColumn("finger", H.run_finger(F.col("i"), F.col("n"), F.col("rising"), F.col("midi"), F.lit(None).cast("int")))
    same = (F.col("finger") == F.lag("finger").over(w)) & F.col("near") & (F.col("midi") != F.lag("midi").over(w))
    return rows.select("series", "id", "midi", "finger", F.when(same, "consecutive_same_finger").when(~F.col("finger").between(1, 5), "invalid_finger").alias("code"))
