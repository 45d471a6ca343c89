"""Queries of evaluation: scores against truth, injected errors, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.plans import shims
from tonalframe.plans.joins import TRUTH, truth
from tonalframe.plans.registry import query


@query(shims.with_shims("""
SELECT song, sum(n)::BIGINT AS bars, sum(e)::BIGINT AS exact, round_even(sum(e) / sum(n), 6) AS micro, round_even(avg(e / n), 6) AS macro
FROM (SELECT chart % 100 AS song, chart, count(*) AS n, count(*) FILTER (raw = read) AS e FROM truth GROUP BY ALL) GROUP BY song""", chords=shims.CHORDS, truth=TRUTH))
def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact readings: the share of all bars (micro), and the mean of the charts' shares, each chart counting once (macro)."""
    same = F.col("raw") == F.col("read")
    charts = truth(spark, sf_dir).groupBy("chart").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("e"))
    share = F.col("e") / F.col("n")
    found = charts.groupBy((F.col("chart") % 100).alias("song")).agg(F.sum("n").alias("bars"), F.sum("e").alias("exact"), F.avg(share).alias("m"))
    return found.select("song", "bars", "exact", F.bround(F.col("exact") / F.col("bars"), 6).alias("micro"), F.bround("m", 6).alias("macro"))


@query(shims.with_shims("""
SELECT chart, bar, error_type, raw AS expected, CASE error_type WHEN 'quality' THEN raw || 'm' WHEN 'accidental' THEN '#' || raw ELSE NULL END AS corrupted FROM (
  SELECT chart, bar, raw, list_value('quality', 'accidental', 'structural')[1 + h % 3] AS error_type, row_number() OVER (PARTITION BY chart ORDER BY h, bar) AS k FROM (SELECT *, (p * 2654435761 + s * 40503) % 1000003 AS h FROM chords)) WHERE k <= 2""", chords=shims.CHORDS))
def corruption_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two errors a chart, picked by a fixed hash and not by a random generator."""
    from tonalframe.operators.catalog import top

    h = (F.col("p") * 2654435761 + F.col("s") * 40503) % 1000003
    kind = F.element_at(F.array(*map(F.lit, ["quality", "accidental", "structural"])), (F.col("h") % 3 + 1).cast("int"))
    rows = top(shims.chords(spark, sf_dir).withColumn("h", h), ["chart"], ["h", "bar"], 2).withColumn("error_type", kind)
    bad = F.when(F.col("error_type") == "quality", F.concat("raw", F.lit("m"))).when(F.col("error_type") == "accidental", F.concat(F.lit("#"), F.col("raw")))
    return rows.select("chart", "bar", "error_type", F.col("raw").alias("expected"), bad.alias("corrupted"))


@query(shims.with_shims("""
SELECT kind, count(*) AS n, count(*) FILTER (o = 0) AS fixed_correct, count(*) FILTER (o = 1) AS fixed_wrong, count(*) FILTER (o = 2) AS flagged, count(*) FILTER (o = 3) AS missed, round_even(100.0::DOUBLE * count(*) FILTER (o IN (0, 2)) / count(*), 2) AS coverage
FROM (SELECT list_value('quality', 'accidental', 'structural')[1 + p % 3] AS kind, s % 4 AS o FROM chords WHERE p % 7 = 0) GROUP BY kind""", chords=shims.CHORDS))
def corruption_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of injected errors."""
    kind = F.element_at(F.array(*map(F.lit, ["quality", "accidental", "structural"])), (F.col("p") % 3 + 1).cast("int"))
    o = F.col("s") % 4
    rows = shims.chords(spark, sf_dir).where("p % 7 = 0").groupBy(kind.alias("kind"))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(o == 0).alias("fixed_correct"), F.count_if(o == 1).alias("fixed_wrong"), F.count_if(o == 2).alias("flagged"), F.count_if(o == 3).alias("missed")
    )
    return found.withColumn("coverage", F.bround(100.0 * (F.col("fixed_correct") + F.col("flagged")) / F.col("n"), 2))


@query(shims.with_shims("""
SELECT coalesce(a.chart, b.chart) AS chart, coalesce(a.row, b.row) AS row, coalesce(a.n, 0) AS truth_boxes, coalesce(b.n, 0) AS found_boxes, coalesce(a.n, 0) = coalesce(b.n, 0) AS ok
FROM (SELECT chart, bar // 2 AS row, count(*) AS n FROM chords WHERE p % 4 <> 0 GROUP BY ALL) a FULL JOIN (SELECT chart, bar // 2 AS row, count(*) AS n FROM chords WHERE s % 5 <> 0 GROUP BY ALL) b ON a.chart = b.chart AND a.row = b.row""", chords=shims.CHORDS))
def box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the truth against boxes found, by row."""
    rows = shims.chords(spark, sf_dir).withColumn("row", F.floor(F.col("bar") / 2))
    count = lambda test, name: rows.where(test).groupBy("chart", "row").agg(F.count(F.lit(1)).alias(name))
    both = count("p % 4 <> 0", "truth_boxes").join(count("s % 5 <> 0", "found_boxes"), ["chart", "row"], "full").fillna(0)
    return both.withColumn("ok", F.col("truth_boxes") == F.col("found_boxes"))


@query(shims.with_shims("""
SELECT chart, bars, CASE WHEN bars = expected THEN 'barline_count_consistent' ELSE 'barline_count_mismatch' END AS code FROM (SELECT chart, count(*) AS bars, max(bar) + 1 AS expected FROM chords GROUP BY chart)""", chords=shims.CHORDS))
def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars counted against bars expected."""
    rows = shims.chords(spark, sf_dir).groupBy("chart").agg(F.count(F.lit(1)).alias("bars"), (F.max("bar") + 1).alias("expected"))
    return rows.select("chart", "bars", F.when(F.col("bars") == F.col("expected"), "barline_count_consistent").otherwise("barline_count_mismatch").alias("code"))


@query(shims.with_shims("SELECT chart, bar, raw, read FROM truth WHERE raw IS DISTINCT FROM read", chords=shims.CHORDS, truth=TRUTH))
def reader_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that two readers read differently."""
    return truth(spark, sf_dir).where(~F.col("raw").eqNullSafe(F.col("read"))).select("chart", "bar", "raw", "read")


@query(shims.with_shims("""
SELECT chart, bar, CASE WHEN p % 13 = 0 THEN 'confirmed' ELSE 'open' END AS state, CASE WHEN p % 13 = 0 THEN 1.0 ELSE (s % 100) / 100.0 END::DOUBLE AS confidence FROM chords WHERE p % 13 = 0 OR s % 3 = 0""", chords=shims.CHORDS))
def issue_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits upserted over open issues: edited bars are certain, their issues go."""
    rows = shims.chords(spark, sf_dir)
    edits = rows.where("p % 13 = 0").select("chart", "bar", F.lit("confirmed").alias("state"), F.lit(1.0).alias("confidence"))
    open_ones = rows.where("s % 3 = 0").select("chart", "bar", F.lit("open").alias("state"), ((F.col("s") % 100) / 100.0).alias("confidence"))
    return open_ones.join(edits, ["chart", "bar"], "left_anti").unionByName(edits)
