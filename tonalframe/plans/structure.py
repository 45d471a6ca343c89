"""Queries of printed and recorded structure: beats of printed chords, measures of recordings, sections, and shapes of a whole song."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import catalog as C
from tonalframe.operators import folds
from tonalframe.operators import grids as G
from tonalframe.operators import quantising as Q
from tonalframe.operators import sections as X
from tonalframe.operators import sequences as S
from tonalframe.plans import shims
from tonalframe.plans.registry import query
from tonalframe.plans.sequences import shapes
from tonalframe.sources.scratch import written


def printed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with one to three chords in boxes across them, some without boxes, in simple and compound meters, over melodies."""
    p, s = F.col("p"), F.col("s")
    n = 1 + (p % 3 == 0).cast("int") + (p % 7 == 0).cast("int")
    beats = F.element_at(F.array(*map(F.lit, [4.0, 3.0, 6.0, 12.0, 4.0])), (p % 5 + 1).cast("int"))
    share = lambda k: (k + 0.05 + ((s + 13 * k) % 80) / 100.0) / n
    read = lambda k: 1.0 + F.rint(share(k) * beats * 2) / 2
    chords = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.when((s + k) % 17 > 0, share(k)).alias("share"), read(k).alias("beat")))
    onsets = F.transform(F.sequence(F.lit(0), (s % 6).cast("int")), lambda k: 1.0 + k * (0.5 + (p % 3) * 0.5) + F.when(s % 4 == 0, 0.25).otherwise(0.0))
    rows = shims.chords(spark, sf_dir).select("chart", "bar", F.floor(F.col("chart") / 64).alias("page"), beats.alias("beats"), chords.alias("chords"), F.when(s % 5 > 0, onsets).otherwise(F.array().cast("array<double>")).alias("onsets"))
    return rows.withColumn("onsets", F.filter("onsets", lambda o: o < F.col("beats") + 1))


@query()
def quantised_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of printed bars on beats: the page's offset, dotted quarters, melody onsets, rising beats."""
    rows = Q.quantised(printed_bars(spark, sf_dir), ["page"])
    return rows.select("chart", "bar", "page", "delta", F.posexplode("quantised").alias("k", "beat"))


def recordings(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three weeks of a player as a recording of three minutes: clicks are beats, purchases downbeats (in two recordings of three), views notes."""
    span = 21 * 86_400_000_000
    rows = shims.notes(spark, sf_dir).withColumn("part", F.floor(F.col("start") / span))
    rows = rows.select((F.col("series") * 1000 + F.col("part")).alias("track"), "id", "kind", F.bround((F.col("start") % span) / (span / 180), 3).alias("t"), F.bround(0.4 + (F.col("id") % 40) / 20, 3).alias("len"))
    rows = written(rows, "recordings")
    tracks = rows.select("track").distinct().select("track", F.lit(180.0).alias("duration"), (60.0 + F.col("track") % 90).alias("tempo"), (3 + F.col("track") % 2).cast("double").alias("per_bar"))
    beats = rows.where("kind = 'click' and track % 7 <> 0")
    down = rows.where("kind = 'purchase' and track % 3 <> 0 and track % 7 <> 0")
    notes = rows.where("kind not in ('click', 'purchase')").select("track", "id", F.col("t").alias("start"), (F.col("t") + F.col("len")).alias("end"))
    return {"tracks": tracks, "beats": beats.select("track", "t"), "downbeats": down.select("track", "t"), "notes": notes}


def grid(found: dict[str, DataFrame]) -> DataFrame:
    return G.measure_grid(found["tracks"], found["beats"], found["downbeats"], found["notes"].select("track", F.col("start").alias("t")))


@query()
def measure_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of recordings from downbeats, beats or the tempo alone."""
    return grid(recordings(spark, sf_dir)).select("track", "measure", F.bround("start", 6).alias("start"), F.bround("end", 6).alias("end"), "beats", F.size("times").alias("n_times"))


@query()
def notes_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of recordings cut at bar lines that are not evenly apart, with ties."""
    found = recordings(spark, sf_dir)
    pieces = G.cut_by_measures(found["notes"], written(grid(found), "measures"))
    return pieces.select("track", "id", "measure", F.bround("start", 6).alias("start"), F.bround("end", 6).alias("end"), "tied")


LINES = "SELECT conv_id AS song, turn AS measure, length(text) % 3 > 0 AS sung, turn // 4 * 4 AS row_start FROM conversations"
PARTS = "SELECT song, measure // 3 AS k, min(measure) AS first, max(measure) AS last, list_value('intro', 'verse', 'interlude', 'chorus', 'outro')[1 + (song + measure // 3 * 2) % 5] AS role, CAST(1 + (song + measure // 3) % 2 AS INTEGER) AS energy FROM lines GROUP BY ALL"


@query((shims.with_shims("", lines=LINES, parts=PARTS) + """
, later AS (SELECT *, first_value(CASE WHEN role NOT IN ('intro', 'interlude', 'outro') THEN {'role': role, 'energy': energy} END IGNORE NULLS) OVER (PARTITION BY song ORDER BY first ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM parts),
islands AS (SELECT p.song, p.first, l.measure, l.row_start, l.measure - row_number() OVER (PARTITION BY p.song, p.first ORDER BY l.measure) AS island FROM parts p JOIN lines l ON l.song = p.song AND l.measure BETWEEN p.first AND p.last AND l.sung WHERE role IN ('intro', 'interlude', 'outro')),
cuts AS (SELECT song, first, greatest(first, arg_min(row_start, measure)) AS cut FROM (SELECT song, first, island, min(measure) AS measure, arg_min(row_start, measure) AS row_start FROM islands GROUP BY ALL HAVING count(*) >= 2) GROUP BY song, first),
cast_ AS (SELECT l.*, cut, bool_or(cut IS NOT NULL) OVER (PARTITION BY l.song) AS split FROM later l LEFT JOIN cuts USING (song, first)),
pieces AS (SELECT song, split, first, CASE WHEN cut > first THEN cut - 1 ELSE last END AS last, CASE WHEN cut = first THEN coalesce(nxt.role, 'verse') ELSE role END AS role, CASE WHEN cut = first THEN coalesce(nxt.energy, 1) ELSE energy END AS energy FROM cast_
  UNION ALL SELECT song, split, cut, last, coalesce(nxt.role, 'verse'), coalesce(nxt.energy, 1) FROM cast_ WHERE cut > first),
numbered AS (SELECT *, sum(step) OVER (PARTITION BY song ORDER BY first) AS n
  FROM (SELECT *, CASE WHEN split AND role = lag(role) OVER w AND energy = lag(energy) OVER w AND first = lag(last) OVER w + 1 THEN 0 ELSE 1 END AS step FROM pieces WINDOW w AS (PARTITION BY song ORDER BY first)))
SELECT song, role, energy, min(first) AS first, max(last) AS last FROM numbered GROUP BY song, n, role, energy"""))
def sung_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played sections cut where words begin."""
    lines = shims.sections(spark, sf_dir).select("song", F.col("bar").alias("measure"), (F.char_length("text") % 3 > 0).alias("sung"), (F.floor(F.col("bar") / 4) * 4).alias("row_start"))
    k = F.floor(F.col("measure") / 3)
    role = F.element_at(F.array(*map(F.lit, ["intro", "verse", "interlude", "chorus", "outro"])), ((F.col("song") + F.col("k") * 2) % 5 + 1).cast("int"))
    parts = lines.withColumn("k", k).groupBy("song", "k").agg(F.min("measure").alias("first"), F.max("measure").alias("last"))
    parts = parts.select("song", "first", "last", role.alias("role"), (1 + (F.col("song") + F.col("k")) % 2).cast("int").alias("energy"))
    return X.sung_apart(parts, lines)


@query()
def song_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of a whole chart, of each chord's six cheapest, that are least work together, with a memory of the section."""
    best = C.top(shapes(spark, sf_dir), ["root", "quality"], ["cost", "f0", "f1", "f2", "f3"], 6)
    held: dict = {}
    for r in best.orderBy("root", "quality", "rank").collect():  # 12 roots, some qualities, 6 shapes each
        held.setdefault((r["root"], r["quality"]), []).append(([r[f"f{k}"] for k in range(4)], r["cost"]))
    options = {k: (np.array([f for f, _ in v]), np.array([c for _, c in v])) for k, v in held.items()}
    none = (np.zeros((1, 4), int), np.zeros(1))
    rows = shims.chords(spark, sf_dir).select("chart", "bar", T.chord_degree(F.col("raw")).alias("c"), F.floor(F.col("bar") / 4).alias("section"))
    rows = rows.select("chart", "bar", "section", "c.root", "c.quality")

    def use(c: dict) -> dict:
        chords = [(int(r), q) for r, q in zip(c["root"], c["quality"], strict=True)]
        mine = {k: options.get(k, none) for k in set(chords)}
        at = S.shape_path(chords, c["section"].tolist(), mine)
        return {"chart": c["chart"], "bar": c["bar"], "rank": [i + 1 for i in at], "frets": [mine[k][0][i].tolist() for k, i in zip(chords, at, strict=True)]}

    return folds.by_song(rows, "chart", ["bar"], use, "chart long, bar long, rank int, frets array<int>")
