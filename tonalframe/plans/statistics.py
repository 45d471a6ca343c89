"""Queries of statistics over songs and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.operators import decoding as D
from tonalframe.operators import statistics as S
from tonalframe.plans import shims
from tonalframe.plans.registry import query

HISTOGRAM = "SELECT series, CAST(pc AS INTEGER) AS pc, sum(w) AS weight FROM (SELECT series, (midi + d[1]) % 12 AS pc, len / 1000000 * d[2] AS w FROM (SELECT series, midi, len, unnest([[0, 1.5], [4, 1.0], [7, 1.0], [10, 0.5]]::DOUBLE[][]) AS d FROM notes)) GROUP BY ALL"


@query(shims.with_shims("SELECT series, pc, round_even(weight, 4) AS weight FROM histogram", notes=shims.NOTES, histogram=HISTOGRAM))
def pitch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of each pitch class, chord tones weighted."""
    return S.pitch_histogram(shims.notes(spark, sf_dir)).select("series", "pc", F.bround("weight", 4).alias("weight"))


@query(shims.with_shims(f"""
SELECT series, tonic, minor, round_even(r, 6) AS r FROM (SELECT series, tonic, minor, r, row_number() OVER (PARTITION BY series ORDER BY round_even(r, 9) DESC, tonic, minor) AS k FROM (
  SELECT series, tonic, minor, corr(w, v) AS r FROM (
    SELECT s.series, t.tonic, m.minor, m.v, coalesce(h.weight, 0) AS w FROM (SELECT DISTINCT series FROM histogram) s, (SELECT unnest(range(12))::INTEGER AS tonic) t, (SELECT 0 AS minor, unnest(range(12))::INTEGER AS i, unnest({S.MAJOR}) AS v UNION ALL SELECT 1, unnest(range(12))::INTEGER, unnest({S.MINOR})) m
    LEFT JOIN histogram h ON h.series = s.series AND h.pc = (m.i + t.tonic) % 12) GROUP BY series, tonic, minor)) WHERE k = 1""", notes=shims.NOTES, histogram=HISTOGRAM))
def key_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key whose profile fits the histogram best."""
    found = S.best_key(S.pitch_histogram(shims.notes(spark, sf_dir)))
    return found.select("series", "tonic", "minor", F.bround("r", 6).alias("r"))


SEGMENTS = """
  SELECT chart AS series, bar, 2.0::DOUBLE * bar AS start, 0.5::DOUBLE + 0.25::DOUBLE * (p % 5) AS seconds, (list_value(0, 2, 4, 5, 7, 9, 11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END + chart) % 12 AS root,
    s % 6 IN (1, 3) AS minor, s % 6 AS q, 48 + s % 36 AS midi, 0.5::DOUBLE * (1 + p % 3) AS sung FROM chords"""
CHORD_TONES = """
  SELECT series, pc, sum(w) AS w FROM (
    SELECT series, (root + t[1]) % 12 AS pc, seconds * t[2] / 2 AS w FROM (SELECT series, root, seconds, unnest(list_filter([[0, 3], [CASE WHEN minor THEN 3 ELSE 4 END, 2], [7, 2], [CASE WHEN q = 4 THEN 11 ELSE 10 END, CASE WHEN q IN (2, 3, 4) THEN 1 ELSE 0 END]], lambda t: t[2] > 0)) AS t FROM segments)
    UNION ALL SELECT series, midi % 12, sung * 2 FROM segments) GROUP BY ALL"""
KEY_PARTS = """
  SELECT series, tonic, sum(CASE WHEN degree = 0 AND NOT minor THEN seconds ELSE 0 END) AS at_home,
    sum(seconds * CASE WHEN degree NOT IN (0, 2, 4, 5, 7, 9, 11) THEN 1.5 WHEN degree <> 11 AND minor <> (degree IN (2, 4, 9)) THEN 0.5 ELSE 0 END::DOUBLE) AS away, sum(seconds) AS total,
    first(CASE WHEN degree = 0 AND NOT minor THEN 0.15 ELSE 0 END ORDER BY start) FILTER (seconds >= 0.8) AS head, first(CASE WHEN degree = 0 AND NOT minor THEN 0.20 ELSE 0 END ORDER BY start DESC) FILTER (seconds >= 0.8) AS tail
  FROM (SELECT *, (root - tonic + 12) % 12 AS degree FROM segments, (SELECT unnest(range(12)) AS tonic)) GROUP BY series, tonic"""


@query(shims.with_shims(f"""
SELECT series, CAST(tonic AS INTEGER) AS tonic, round_even(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round_even(score, 9) DESC, tonic) AS k FROM (
  SELECT f.series, f.tonic, coalesce(CASE WHEN NOT isnan(r) THEN r END, 0) + 0.40::DOUBLE * at_home / total + coalesce(head, 0) + coalesce(tail, 0) - 1.25::DOUBLE * away / total AS score
  FROM (SELECT s.series, t.tonic, corr(coalesce(h.w, 0), m.v) AS r FROM (SELECT DISTINCT series FROM segments) s, (SELECT unnest(range(12)) AS tonic) t, (SELECT unnest(range(12)) AS i, unnest({S.MAJOR}) AS v) m
    LEFT JOIN tones h ON h.series = s.series AND h.pc = (m.i + t.tonic) % 12 GROUP BY s.series, t.tonic) f JOIN parts USING (series, tonic))) WHERE k = 1""",
    chords=shims.CHORDS, segments=SEGMENTS, tones=CHORD_TONES, parts=KEY_PARTS))
def full_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key that pitch, home chord, ends and foreign chords of a song speak for."""
    p, s = F.col("p"), F.col("s")
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    root = (at([0, 2, 4, 5, 7, 9, 11], p % 7) + F.when(p % 11 == 0, 11).otherwise(0) + F.col("chart")) % 12
    rows = shims.chords(spark, sf_dir).select(
        F.col("chart").alias("series"), (2.0 * F.col("bar")).alias("start"), (0.5 + 0.25 * (p % 5)).alias("seconds"), root.cast("int").alias("root"), at(["", "m", "7", "m7", "maj7", "sus4"], s % 6).alias("quality"),
        (48 + s % 36).alias("midi"), (0.5 * (1 + p % 3)).alias("sung"),
    )
    found = D.full_key(rows.select("series", "start", "seconds", "root", "quality"), rows.select("series", F.col("sung").alias("seconds"), "midi"))
    return found.select("series", "tonic", F.bround("score", 6).alias("score"))


@query(shims.with_shims("""
SELECT series, CASE WHEN med > 0.05 THEN round_even(60 / med, 1) END AS tempo FROM (SELECT series, median(gap) AS med FROM (SELECT series, (start - lag(start) OVER (PARTITION BY series ORDER BY start, id)) / 100000000.0::DOUBLE AS gap FROM notes) GROUP BY series)""", notes=shims.NOTES))
def tempo_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo from the median time between beats."""
    gap = (F.col("start") - F.lag("start").over(Window.partitionBy("series").orderBy("start", "id"))) / 100_000_000.0
    rows = shims.notes(spark, sf_dir).select("series", gap.alias("gap")).groupBy("series").agg(F.median("gap").alias("med"))
    return rows.select("series", F.when(F.col("med") > 0.05, F.bround(60 / F.nullif(F.col("med"), F.lit(0.0)), 1)).alias("tempo"))


@query(shims.with_shims("""
SELECT series, round_even(p, 6) AS p95, round_even(greatest(0.0001, 0.06::DOUBLE * p), 6) AS active, round_even(greatest(0.0001, 0.1::DOUBLE * p), 6) AS loud FROM (SELECT series, quantile_cont(value::DOUBLE, 0.95) AS p FROM notes GROUP BY series)""", notes=shims.NOTES))
def loudness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from the 95th percentile."""
    rows = shims.notes(spark, sf_dir).groupBy("series").agg(F.percentile("value", F.lit(0.95)).alias("p"))
    level = lambda x: F.bround(F.greatest(F.lit(0.0001), F.lit(x) * F.col("p")), 6)
    return rows.select("series", F.bround("p", 6).alias("p95"), level(0.06).alias("active"), level(0.1).alias("loud"))


@query(shims.with_shims("SELECT series, list_sort(list(midi))[len(list(midi)) // 2 + 1] AS middle, CAST(round_even((60 - list_sort(list(midi))[len(list(midi)) // 2 + 1]) / 12.0, 0) AS BIGINT) AS octaves FROM notes GROUP BY series", notes=shims.NOTES))
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median pitch, and the octaves that centre it."""
    # Counting pitches first keeps at most 128 entries a series.
    counts = shims.notes(spark, sf_dir).groupBy("series", "midi").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series")
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("midi"))).withColumn("half", F.floor(F.sum("n").over(w) / 2) + 1)
    found = upto.where("upto >= half").groupBy("series").agg(F.min("midi").alias("middle"))
    return found.withColumn("octaves", F.rint((60 - F.col("middle")) / 12.0).cast("long"))


@query(shims.with_shims("SELECT chart // 200 AS page, CASE WHEN count(*) >= 3 THEN median((s % 40) / 40.0::DOUBLE) ELSE 0.5 END AS delta FROM chords WHERE bar = 0 GROUP BY ALL", chords=shims.CHORDS))
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typeset offset of a page by the median of its opening chords."""
    rows = shims.chords(spark, sf_dir).where("bar = 0").groupBy(F.floor(F.col("chart") / 200).alias("page"))
    return rows.agg(F.when(F.count(F.lit(1)) >= 3, F.median((F.col("s") % 40) / 40.0)).otherwise(0.5).alias("delta"))


@query(shims.with_shims("""
SELECT chart // 200 AS page, min(CASE WHEN bars < 2 THEN least(0.35, c) ELSE c END) AS confidence FROM (
  SELECT chart, max(p % 7) AS bars, round_even(greatest(0.15, least(1.0, 1 - 3.5::DOUBLE * stddev_pop((s % 10) / 10.0::DOUBLE))), 6) AS c FROM chords GROUP BY chart) GROUP BY ALL""", chords=shims.CHORDS))
def layout_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a page: the least of its rows, each from the regularity of its bars."""
    rows = shims.chords(spark, sf_dir).groupBy("chart").agg(F.stddev_pop((F.col("s") % 10) / 10.0).alias("sd"), F.max(F.col("p") % 7).alias("bars"))
    c = F.bround(F.greatest(F.lit(0.15), F.least(F.lit(1.0), 1 - 3.5 * F.col("sd"))), 6)
    return rows.withColumn("c", F.when(F.col("bars") < 2, F.least(F.lit(0.35), c)).otherwise(c)).groupBy(F.floor(F.col("chart") / 200).alias("page")).agg(F.min("c").alias("confidence"))


@query(shims.with_shims("""
SELECT chart, CAST(total AS BIGINT) AS total, CAST(chart % 5 - 2 AS BIGINT) AS expected, ((total % 12) + 12) % 12 = (((chart % 5 - 2) % 12) + 12) % 12 AS ok FROM (SELECT chart, sum(CASE WHEN p % 3 = 0 THEN s % 5 - 2 ELSE 0 END) AS total FROM chords GROUP BY chart)""", chords=shims.CHORDS))
def modulation_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of key changes against what the header says."""
    rows = shims.chords(spark, sf_dir).groupBy("chart").agg(F.sum(F.when(F.col("p") % 3 == 0, F.col("s") % 5 - 2).otherwise(0)).alias("total"))
    expected = F.col("chart") % 5 - 2
    return rows.select("chart", "total", expected.alias("expected"), (F.pmod("total", F.lit(12)) == F.pmod(expected, F.lit(12))).alias("ok"))


@query(shims.with_shims("""
SELECT song, bar, raw, n, round_even(least(1.0::DOUBLE, avg_score * least(1.5::DOUBLE, 1 + 0.1::DOUBLE * (n - 1))), 6) AS support FROM (SELECT chart % 500 AS song, bar, raw, count(*) AS n, avg((s % 100) / 100.0::DOUBLE) AS avg_score FROM chords GROUP BY ALL)""", chords=shims.CHORDS))
def candidate_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of a candidate, raised by the number of sources."""
    rows = shims.chords(spark, sf_dir).groupBy((F.col("chart") % 500).alias("song"), "bar", "raw").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("s") % 100) / 100.0).alias("m"))
    raised = F.least(F.lit(1.0), F.col("m") * F.least(F.lit(1.5), 1 + 0.1 * (F.col("n") - 1)))
    return rows.select("song", "bar", "raw", "n", F.bround(raised, 6).alias("support"))


@query(shims.with_shims("""
SELECT chart, agree, disagree, CASE WHEN agree + disagree = 0 THEN 1.0::DOUBLE ELSE round_even(agree / (agree + disagree), 2) END AS ratio FROM (SELECT chart, count(*) FILTER (p % 4 = 1) AS agree, count(*) FILTER (p % 4 = 2) AS disagree FROM chords GROUP BY chart)""", chords=shims.CHORDS))
def agreement_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of agreeing bars; all if none was compared."""
    rows = shims.chords(spark, sf_dir).groupBy("chart").agg(F.count_if(F.col("p") % 4 == 1).alias("agree"), F.count_if(F.col("p") % 4 == 2).alias("disagree"))
    n = F.col("agree") + F.col("disagree")
    return rows.withColumn("ratio", F.when(n == 0, 1.0).otherwise(F.bround(F.col("agree") / F.nullif(n, F.lit(0)), 2)))


@query(shims.with_shims("""
SELECT chart, role, count(DISTINCT pattern) AS patterns, count(DISTINCT pattern) <= 2 AS ok FROM (SELECT chart, bar // 4 AS role, s % 4 AS pattern, bar = max(bar) OVER (PARTITION BY chart, bar // 4) AS last FROM chords) WHERE NOT last GROUP BY ALL""", chords=shims.CHORDS))
def distinct_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a section, its last bar aside."""
    role = F.floor(F.col("bar") / 4)
    rows = shims.chords(spark, sf_dir).select("chart", role.alias("role"), (F.col("s") % 4).alias("pattern"), (F.col("bar") == F.max("bar").over(Window.partitionBy("chart", role))).alias("last"))
    found = rows.where(~F.col("last")).groupBy("chart", "role").agg(F.countDistinct("pattern").alias("patterns"))
    return found.withColumn("ok", F.col("patterns") <= 2)
