"""Queries of bar lines, measures and places inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.operators import folds as O
from tonalframe.operators import measures as M
from tonalframe.plans import shims
from tonalframe.plans.registry import query

TEN_DAYS = 10 * 24 * 3_600_000_000
#: Charts as pages of measures: x0, x1 in pixels; beats read from melodies, null for most.
PAGES = """SELECT chart, bar, beat, p, s, 100 * bar + p % 20 AS x0, 100 * bar + p % 20 + CASE WHEN s % 4 = 0 THEN 30 + p % 15 ELSE 75 + s % 9 END AS x1,
  4.0::DOUBLE AS beats, CASE WHEN p % 3 = 0 THEN 1.0 + s % 4 END::DOUBLE AS sung FROM chords"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shims.chords(spark, sf_dir)
    x0 = 100 * F.col("bar") + F.col("p") % 20
    rows = rows.withColumn("x0", x0).withColumn("x1", x0 + F.when(F.col("s") % 4 == 0, 30 + F.col("p") % 15).otherwise(75 + F.col("s") % 9))
    return rows.withColumn("beats", F.lit(4.0)).withColumn("sung", F.when(F.col("p") % 3 == 0, 1.0 + F.col("s") % 4))


@query(shims.with_shims("""
SELECT chart, CAST(CASE WHEN pos % 2 = 1 AND next_x IS NOT NULL THEN (x + next_x) // 2 ELSE x END AS BIGINT) AS x FROM (
  SELECT chart, x, pos, lead(x) OVER (PARTITION BY chart, run ORDER BY pos) AS next_x FROM (
    SELECT chart, x, run, row_number() OVER (PARTITION BY chart, run ORDER BY x, bar) AS pos FROM (
      SELECT *, sum(far) OVER (PARTITION BY chart ORDER BY x, bar) AS run FROM (
        SELECT chart, bar, x, CASE WHEN x - lag(x) OVER (PARTITION BY chart ORDER BY x, bar) <= 16 THEN 0 ELSE 1 END AS far FROM (SELECT chart, bar, p % 120 AS x FROM chords))))) WHERE pos % 2 = 1""", chords=shims.CHORDS))
def double_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double bar lines as one."""
    lines = shims.chords(spark, sf_dir).select("chart", "bar", (F.col("p") % 120).alias("x"))
    return M.double_bars_merged(lines, ["chart"], "x", "bar")


@query(shims.with_shims("""
SELECT chart, bar, x, CAST(coalesce(arg_min(place, CASE WHEN x <= first_x THEN place WHEN x >= last_x THEN -place WHEN x BETWEEN x0 AND x1 THEN place - 1000000.0 ELSE abs(x - (x0 + x1) / 2.0) + place / 1000.0 END), 0) AS BIGINT) AS measure FROM (
  SELECT b.chart, b.bar, b.x, m.x0, m.x1, m.place, m.first_x, m.last_x FROM (SELECT chart, bar, (p * 7 + s * 3) % 800 - 20 AS x FROM chords) b
  LEFT JOIN (SELECT *, row_number() OVER w - 1 AS place, first(x0) OVER w2 AS first_x, last(x1) OVER w2 AS last_x FROM pages WHERE p % 6 <> 0
    WINDOW w AS (PARTITION BY chart ORDER BY bar), w2 AS (PARTITION BY chart ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) m ON b.chart = m.chart)
GROUP BY chart, bar, x""", chords=shims.CHORDS, pages=PAGES))
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure of each chord box by the x of its centre; the pages lack some measures."""
    rows = pages(spark, sf_dir)
    boxes = rows.select("chart", "bar", ((F.col("p") * 7 + F.col("s") * 3) % 800 - 20).alias("x"))
    return M.measure_of(boxes, rows.where("p % 6 <> 0").select("chart", F.col("bar").alias("m"), "x0", "x1"), ["chart"], "x", "m")


@query(shims.with_shims("""
SELECT chart, bar, round_even(ratio, 9) AS ratio, CASE
    WHEN NOT (ratio <= 0.6 AND (bar = 0 OR bar = last_bar)) OR (sung >= beats AND NOT (bar = 0 AND (ratio <= 0.4 OR chart % 7 = 0))) THEN beats
    WHEN sung > 0 AND sung < beats THEN sung ELSE greatest(0.5, least(beats - 0.5, round_even(ratio * beats * 2, 0) / 2)) END::DOUBLE AS new_beats
FROM (SELECT a.chart, a.bar, a.beats, a.sung, max(b.bar) AS last_bar, (a.x1 - a.x0) / coalesce(median(b.x1 - b.x0) FILTER (b.x1 - b.x0 <> a.x1 - a.x0), median(b.x1 - b.x0)) AS ratio
  FROM pages a JOIN pages b ON a.chart = b.chart GROUP BY a.chart, a.bar, a.beats, a.sung, a.x0, a.x1)""", chords=shims.CHORDS, pages=PAGES))
def partial_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow measures at the ends of rows as parts of a bar (M6)."""
    rows = pages(spark, sf_dir)
    ends = rows.groupBy("chart").agg(F.max("bar").alias("last_bar"))
    rows = rows.join(ends, "chart").withColumn("width", F.col("x1") - F.col("x0"))
    first = F.col("bar") == 0
    found = M.partial_measures(rows, ["chart"], "width", first | (F.col("bar") == F.col("last_bar")), "beats", "sung", first, F.col("chart") % 7 == 0)
    return found.select("chart", "bar", F.bround("ratio", 9).alias("ratio"), "new_beats")


@query(shims.with_shims("""
SELECT chart, bar, CASE WHEN abs(read - place) >= 1 AND read BETWEEN 1 AND total THEN read ELSE place END AS beat FROM (
  SELECT chart, bar, read, total, CASE WHEN sig = '4/4' THEN beat ELSE greatest(1.0, least(total, round_even((1 + share * total) * 2, 0) / 2)) END::DOUBLE AS place FROM (
    SELECT chart, bar, beat, CASE WHEN s % 5 > 0 THEN 0.5 + p % 9 * 0.5 END::DOUBLE AS read, CASE chart % 3 WHEN 0 THEN '4/4' WHEN 1 THEN '3/4' ELSE '6/8' END AS sig,
      CASE chart % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 3.0 ELSE 6.0 END::DOUBLE AS total, greatest(0.0, least(1.0, CASE WHEN p % 4 > 0 THEN (x0 + s % 100 - 10 - x0) / (x1 - x0)::DOUBLE ELSE (beat - 1) / 4 END)) AS share FROM pages))""",
    chords=shims.CHORDS, pages=PAGES))
def chord_beats_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of chords from their place and from a reading (M8)."""
    rows = pages(spark, sf_dir)
    meter = F.col("chart") % 3
    read = F.when(F.col("s") % 5 > 0, 0.5 + F.col("p") % 9 * 0.5)
    signature = F.when(meter == 0, "4/4").when(meter == 1, "3/4").otherwise("6/8")
    total = F.when(meter == 0, 4.0).when(meter == 1, 3.0).otherwise(6.0)
    x = F.when(F.col("p") % 4 > 0, F.col("x0") + F.col("s") % 100 - 10)
    return rows.select("chart", "bar", M.chord_beat_read(F.col("beat"), read, signature, total, x, F.col("x0"), F.col("x1")).alias("beat"))


@query(shims.with_shims(f"""
SELECT e.id, round_even(CASE WHEN n > 1 AND e.start > b.t0 AND b.t1 IS NOT NULL THEN (b.i - 1 + (e.start - b.t0) / (b.t1 - b.t0)::DOUBLE) * (4.0 / (n - 1))
  WHEN n > 1 AND e.start = f THEN (equal - 1) * (4.0 / (n - 1))::DOUBLE ELSE (e.start - e.measure * {TEN_DAYS}) / {TEN_DAYS}::DOUBLE * 4 END, 6) AS beat
FROM (SELECT *, start // {TEN_DAYS} AS measure FROM notes WHERE kind <> 'click') e
LEFT JOIN (SELECT series, start // {TEN_DAYS} AS measure, count(*) AS n, min(start) AS f, count(*) FILTER (start = lo) AS equal FROM (SELECT *, min(start) OVER (PARTITION BY series, start // {TEN_DAYS}) AS lo FROM notes WHERE kind = 'click') GROUP BY ALL) c USING (series, measure)
ASOF LEFT JOIN (SELECT series, measure, t0, max(i) AS i, max(t1) AS t1 FROM (SELECT series, start // {TEN_DAYS} AS measure, start AS t0, row_number() OVER w AS i, lead(start) OVER w AS t1 FROM notes WHERE kind = 'click' WINDOW w AS (PARTITION BY series, start // {TEN_DAYS} ORDER BY start)) GROUP BY series, measure, t0) b
  ON e.series = b.series AND e.measure = b.measure AND e.start > b.t0""", notes=shims.NOTES))
def beats_in_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as beats of their measure by the pieces between its beat times."""
    measure = F.floor(F.col("start") / TEN_DAYS)
    rows = shims.notes(spark, sf_dir).select("series", "id", "kind", measure.alias("measure"), F.col("start").alias("t"))
    points, ticks = rows.where("kind <> 'click'").drop("kind"), rows.where("kind = 'click'").drop("kind", "id")
    start = F.col("measure") * TEN_DAYS
    found = M.beat_in_measure(points, ticks, ["series", "measure"], start, start + TEN_DAYS, 4.0)
    return found.select("id", F.bround("beat", 6).alias("beat"))


@query()
def lyrics_on_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters on the nearest free note within two hours, in order of characters (J14); tests hold the fold against all pairs."""
    rows = shims.notes(spark, sf_dir).select("series", "id", "kind", (F.col("start") / 3_600_000_000).alias("t"))

    def use(c):
        sung = c["kind"] == "view"
        chars, notes = c["id"][sung], c["id"][~sung]
        at = M.nearest_free(c["t"][sung].tolist(), c["t"][~sung].tolist())
        return {"id": chars.tolist(), "note": [None if k < 0 else int(notes[k]) for k in at]}

    return O.by_song(rows, "series", ["t", "id"], use, "id long, note long")
