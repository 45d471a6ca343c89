"""Queries of validators and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import checks as C
from tonalframe.plans import shims
from tonalframe.plans.registry import query

EVENTS = "SELECT series, start // 86400000000 AS bar, (start % 86400000000) // 5400000000 / 4.0::DOUBLE AS onset, (1 + id % 3) * 0.5::DOUBLE AS duration, midi FROM notes"
ISSUES = """
  SELECT series, bar, unnest(list_filter([CASE WHEN total <> 4.0 THEN 'tiling_mismatch' END, CASE WHEN off_grid > 0 THEN 'grid_alignment' END, CASE WHEN low < 50 OR high > 80 THEN 'pitch_out_of_range' END, CASE WHEN high - low > 24 THEN 'span_too_large' END, CASE WHEN n > 16 THEN 'attacks_too_dense' END], lambda x: x IS NOT NULL)) AS code
  FROM (SELECT series, bar, round_even(sum(duration), 4) AS total, min(midi) AS low, max(midi) AS high, count(*) FILTER (abs(onset * 4 - round_even(onset * 4, 0)) > 1e-6) AS off_grid, count(*) AS n FROM bars GROUP BY ALL)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400_000_000
    onset = F.floor(F.pmod("start", F.lit(day)) / 5_400_000_000) / 4.0
    return shims.notes(spark, sf_dir).select("series", F.floor(F.col("start") / day).alias("bar"), onset.alias("onset"), ((1 + F.col("id") % 3) * 0.5).alias("duration"), "midi")


@query(shims.with_shims("SELECT series, bar, code FROM issues", notes=shims.NOTES, bars=EVENTS, issues=ISSUES))
def arrangement_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiling, grid, range, span and density of bars (Q1b, Q1g, G20)."""
    return C.issues(events(spark, sf_dir), ["series", "bar"], 4.0, 50, 80, 24)


@query(shims.with_shims("SELECT code, count(*) AS n, count(DISTINCT series) AS songs FROM issues GROUP BY code", notes=shims.NOTES, bars=EVENTS, issues=ISSUES))
def validator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule is broken."""
    rows = arrangement_issues(spark, sf_dir).groupBy("code", "series").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("songs"))


@query(shims.with_shims("""
SELECT series, bar, onset, duration, midi FROM bars WHERE (series, bar) NOT IN (SELECT (series, bar) FROM issues)
UNION ALL SELECT DISTINCT series, bar, 0.0::DOUBLE, 4.0::DOUBLE, 60 FROM issues""", notes=shims.NOTES, bars=EVENTS, issues=ISSUES))
def fallback_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that fail take a safe version (Q2)."""
    rows = events(spark, sf_dir)
    safe = rows.select("series", "bar").distinct().select("series", "bar", F.lit(0.0).alias("onset"), F.lit(4.0).alias("duration"), F.lit(60).cast("long").alias("midi"))
    return C.repaired(rows, C.issues(rows, ["series", "bar"], 4.0, 50, 80, 24), safe, ["series", "bar"])


@query(shims.with_shims("""
SELECT chart, structural, review, conf < 0.6 AND (structural > 0 OR NOT confirmed) OR review / bars > 0.25 AND structural > 0 AS blocked
FROM (SELECT chart, (chart % 10) / 10.0::DOUBLE AS conf, chart % 3 = 0 AS confirmed, count(*) AS bars, count(*) FILTER (p % 9 IN (0, 1)) AS structural, count(*) FILTER (s % 3 = 0) AS review FROM chords GROUP BY chart)""", chords=shims.CHORDS))
def issue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts that are not let through."""
    code = F.when(F.col("p") % 9 == 0, "barline_count_mismatch").when(F.col("p") % 9 == 1, "measure_count_repaired").otherwise("chord_ambiguous")
    rows = shims.chords(spark, sf_dir)
    bars = rows.groupBy("chart").agg(F.count(F.lit(1)).alias("bars"))
    rows = rows.select("chart", code.alias("code"), F.when(F.col("s") % 3 == 0, "needs_review").otherwise("info").alias("severity"), ((F.col("chart") % 10) / 10.0).alias("conf"), (F.col("chart") % 3 == 0).alias("confirmed"))
    return C.gate(rows.join(bars, "chart"), "chart", "conf", "confirmed", "bars")


@query(shims.with_shims("""
SELECT chart, bad, n, bad / n >= 0.2 OR unread >= 3 AS blocked FROM (SELECT chart, count(*) AS n, count(*) FILTER ((p * 5) % 12 <> s % 12 AND s % 2 = 0) AS bad, count(*) FILTER (p % 6 = 0) AS unread FROM chords GROUP BY chart)""", chords=shims.CHORDS))
def output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with too many wrong roots or unreadable chords."""
    wrong = (F.col("p") * 5 % 12 != F.col("s") % 12) & (F.col("s") % 2 == 0)
    rows = shims.chords(spark, sf_dir).groupBy("chart").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("bad"), F.count_if(F.col("p") % 6 == 0).alias("unread"))
    return rows.select("chart", "bad", "n", ((F.col("bad") / F.col("n") >= 0.2) | (F.col("unread") >= 3)).alias("blocked"))


@query(shims.with_shims("""
SELECT series, id, CASE WHEN f = pf AND start - ps < 3600000000 AND midi <> pm THEN 'consecutive_same_finger' WHEN f NOT BETWEEN 1 AND 5 THEN 'invalid_finger' END AS code
FROM (SELECT series, id, start, midi, midi % 6 AS f, lag(midi % 6) OVER w AS pf, lag(start) OVER w AS ps, lag(midi) OVER w AS pm FROM notes WINDOW w AS (PARTITION BY series ORDER BY start, id))""", notes=shims.NOTES))
def fingering_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingers out of range, or one finger on two keys in quick succession (Q1h)."""
    w = Window.partitionBy("series").orderBy("start", "id")
    finger = F.col("midi") % 6
    rows = shims.notes(spark, sf_dir).select("series", "id", "start", "midi", finger.alias("f"))
    same = (F.col("f") == F.lag("f").over(w)) & (F.col("start") - F.lag("start").over(w) < 3_600_000_000) & (F.col("midi") != F.lag("midi").over(w))
    return rows.select("series", "id", F.when(same, "consecutive_same_finger").when(~F.col("f").between(1, 5), "invalid_finger").alias("code"))


STEPS = "list_value(0,2,4,5,7,9,11)"


@query(shims.with_shims(f"""
SELECT chart, bar, len(list_filter(tones, lambda x: NOT list_contains(played, x))) AS missing, len(list_filter(played, lambda x: NOT list_contains(tones, x))) AS foreign_tones
FROM (SELECT chart, bar, list_transform(list_value([0,4,7],[0,3,7],[0,4,7,10],[0,3,7,10],[0,4,7,11],[0,5,7])[1 + s % 6], lambda x: (x + ({STEPS}[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END)) % 12) AS tones, list_distinct([p % 12, s % 12, (p + s) % 12, (p + 2 * s) % 12]) AS played FROM chords)""", chords=shims.CHORDS))
def chord_tone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defining tones that are missing and tones outside the chord (Q1c-Q1f, E3)."""
    p, s = F.col("p"), F.col("s")
    played = F.array_distinct(F.transform(F.array(p, s, p + s, p + 2 * s), lambda x: (x % 12).cast("int")))
    rows = shims.chords(spark, sf_dir).select("chart", "bar", T.chord_degree(F.col("raw")).alias("c"), played.alias("played"))
    tones = T.chord_pcs(F.col("c.root"), F.col("c.quality"))
    return rows.select("chart", "bar", F.size(F.array_except(tones, F.col("played"))).cast("long").alias("missing"), F.size(F.array_except(F.col("played"), tones)).cast("long").alias("foreign_tones"))


@query(shims.with_shims("""
SELECT c.chart, c.bar, c.raw, CASE WHEN boxed >= 5 AND boxed / n >= 0.5 AND p % 4 = 0 THEN 'unboxed_chord_dropped' ELSE 'kept' END AS action
FROM chords c JOIN (SELECT chart, count(*) AS n, count(*) FILTER (p % 4 <> 0) AS boxed FROM chords GROUP BY chart) USING (chart)""", chords=shims.CHORDS))
def unboxed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without a box on charts that box their chords."""
    rows = shims.chords(spark, sf_dir)
    share = rows.groupBy("chart").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") % 4 != 0).alias("boxed"))
    drop = (F.col("boxed") >= 5) & (F.col("boxed") / F.col("n") >= 0.5) & (F.col("p") % 4 == 0)
    return rows.join(share, "chart").select("chart", "bar", "raw", F.when(drop, "unboxed_chord_dropped").otherwise("kept").alias("action"))
