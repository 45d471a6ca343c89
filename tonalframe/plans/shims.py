"""Music tables made from the driver's tables by fixed integer rules, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.sources.tables import table

QUALITIES = ["", "m", "7", "m7", "M7", "sus"]

#: A chord for each bar of a chart: chart, bar, raw, beat, p, s.
CHORDS = """
  SELECT chart, bar, p, s,
    (CASE WHEN p % 11 = 0 THEN 'b' ELSE '' END) || CAST(1 + p % 7 AS VARCHAR) ||
    (CASE s % 6 WHEN 0 THEN '' WHEN 1 THEN 'm' WHEN 2 THEN '7' WHEN 3 THEN 'm7' WHEN 4 THEN 'M7' ELSE 'sus' END) ||
    (CASE WHEN p % 5 = 0 THEN '/' || CAST(1 + s % 7 AS VARCHAR) ELSE '' END) AS raw,
    1.0::DOUBLE + s % 4 AS beat
  FROM (SELECT l_orderkey AS chart, CAST(l_linenumber - 1 AS BIGINT) AS bar, min(l_partkey) AS p, min(l_suppkey) AS s
        FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
#: A note for each event: series, id, start (microseconds), len (microseconds), midi, value.
NOTES = """
  SELECT user_id AS series, event_id AS id, epoch_us(ts) AS start, CAST(1000000 * (1 + event_id % 40) AS BIGINT) * 60 AS len,
    48 + CAST(floor(value) AS BIGINT) % 36 AS midi, value, event_type AS kind
  FROM events"""
#: Turns of conversations as bars with a label.
SECTIONS = "SELECT conv_id AS song, turn AS bar, role AS label, text FROM conversations"


def with_shims(body: str, **names: str) -> str:
    """SQL with the named tables before it."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in names.items()) + "\n" + body


def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chart"), (F.col("l_linenumber") - 1).cast("long").alias("bar"))
    rows = rows.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    quality = F.element_at(F.array(*map(F.lit, QUALITIES)), (F.col("s") % 6 + 1).cast("int"))
    flat = F.when(F.col("p") % 11 == 0, "b").otherwise("")
    bass = F.when(F.col("p") % 5 == 0, F.concat(F.lit("/"), (1 + F.col("s") % 7).cast("string"))).otherwise("")
    raw = F.concat(flat, (1 + F.col("p") % 7).cast("string"), quality, bass)
    return rows.select("chart", "bar", "p", "s", raw.alias("raw"), (F.lit(1.0) + F.col("s") % 4).alias("beat"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    midi = 48 + F.floor("value").cast("long") % 36
    length = (F.lit(60_000_000).cast("long") * (1 + F.col("event_id") % 40)).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), F.col("event_id").alias("id"), start.alias("start"), length.alias("len"), midi.alias("midi"), "value", F.col("event_type").alias("kind")
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song"), F.col("turn").alias("bar"), F.col("role").alias("label"), "text")
