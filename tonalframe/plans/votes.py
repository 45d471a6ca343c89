"""Queries of votes between source charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import consensus as C
from tonalframe.operators import votes as V
from tonalframe.plans import shims
from tonalframe.plans.registry import query

BARS = """
  SELECT chart // 32 AS song, chart AS source, bar, raw, CAST(1 + p % 7 AS VARCHAR) || CASE WHEN p % 11 = 0 THEN 'b' ELSE '' END || ':' ||
    list_value('maj', 'm', 'maj', 'm', 'maj', 'sus')[1 + s % 6] || CASE WHEN p % 5 = 0 AND (p % 11 = 0 OR 1 + s % 7 <> 1 + p % 7) THEN ':' || CAST(1 + s % 7 AS VARCHAR) ELSE '' END AS k
  FROM chords"""


def source_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shims.chords(spark, sf_dir).select(F.floor(F.col("chart") / 32).alias("song"), F.col("chart").alias("source"), "bar", "raw", "p", "s")


def vote_key(raw):
    """Degree, triad and bass of a number chord as text."""

    def key(c):
        sign = F.when(c["accidental"] == -1, "b").when(c["accidental"] == 1, "#").otherwise("")
        bass_sign = F.when(c["bass_accidental"] == -1, "b").when(c["bass_accidental"] == 1, "#").otherwise("")
        other = (c["bass_degree"] != c["degree"]) | (c["bass_accidental"] != c["accidental"])
        bass = F.when(c["bass_degree"].isNotNull() & other, F.concat(F.lit(":"), c["bass_degree"].cast("string"), bass_sign)).otherwise("")
        return F.concat(c["degree"].cast("string"), sign, F.lit(":"), T.triad(c["quality"]), bass)

    return T.let(T.parse_number_chord(raw), key)


VOTES = """
SELECT song, bar, r[1].spelling AS winner, r[1].votes AS support, len(r) AS n_keys, total, list_distinct(list_filter(list_transform(r[2:], lambda x: x.spelling), lambda x: x <> r[1].spelling)) AS alts
FROM (SELECT song, bar, list({'votes': votes, 'spelling': spelling} ORDER BY votes DESC, first) AS r FROM (
    SELECT song, bar, k, sum(n)::BIGINT AS votes, min(first) AS first, first(raw ORDER BY n DESC, first) AS spelling
    FROM (SELECT song, bar, k, raw, count(*) AS n, min(source) AS first FROM bars GROUP BY ALL) GROUP BY song, bar, k) GROUP BY song, bar)
JOIN (SELECT song, count(DISTINCT source) AS total FROM bars GROUP BY song) USING (song)"""


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_bars(spark, sf_dir).withColumn("k", vote_key(F.col("raw")))
    total = rows.groupBy("song").agg(F.countDistinct("source").alias("total"))
    return V.agreement(V.majority(rows, ["song", "bar"], "source", "raw", "k").join(total, "song"))


@query(shims.with_shims("""
SELECT song, bar, winner, support, n_keys, total, CASE WHEN support >= 2 AND support / total >= 0.5 THEN 'agree' ELSE 'search_only' END AS agreement, len(alts) AS n_alternatives
FROM votes""", chords=shims.CHORDS, bars=BARS, votes=VOTES))  # fmt: skip
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chord that most sources read in each bar of a song, with support and agreement."""
    return consensus(spark, sf_dir).withColumn("n_alternatives", F.size("alternatives")).drop("alternatives")


@query(shims.with_shims("""
SELECT song, source, score FROM (SELECT song, source, score, row_number() OVER (PARTITION BY song ORDER BY score DESC, source) AS k FROM (
  SELECT song, source, round_even(-abs(bars - median(bars) OVER (PARTITION BY song)) * 100.0::DOUBLE + bars + 0.05::DOUBLE * chords, 4) AS score
  FROM (SELECT song, source, count(*) AS bars, count(DISTINCT raw) AS chords FROM bars GROUP BY ALL))) WHERE k = 1""", chords=shims.CHORDS, bars=BARS))
def reference_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source chart that the others are aligned to."""
    charts = source_bars(spark, sf_dir).groupBy("song", "source").agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("raw").alias("chords"))
    return V.reference_source(charts, "song", "source", "bars", "chords")


@query(shims.with_shims("""
SELECT song, bar, CASE WHEN bar = min(bar) OVER (PARTITION BY song) THEN 'verse' END AS section, 1.0::DOUBLE AS beat, winner AS raw, CASE WHEN support >= 2 AND support / total >= 0.5 THEN 'agree' ELSE 'search_only' END AS agreement, CAST(len(alts) AS INTEGER) AS n_alternatives
FROM votes""", chords=shims.CHORDS, bars=BARS, votes=VOTES))
def consensus_lead_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead sheet of bars that are aligned already and have one chord each (V5); aligned_lead_sheet does the whole of it."""
    rows = consensus(spark, sf_dir).withColumn("chords", F.array("winner"))
    return C.lead_sheet(rows, "song", "bar", F.lit("verse"))


@query(shims.with_shims("""
SELECT song, bar, letters, numbers, CASE WHEN letters > numbers THEN 'letter' ELSE 'number' END AS notation
FROM (SELECT chart // 32 AS song, bar, count(*) FILTER (s % 3 = 0) AS letters, count(*) FILTER (s % 3 <> 0) AS numbers FROM chords GROUP BY ALL)""", chords=shims.CHORDS))
def notation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters against numbers, strictly more needed for letters."""
    letter = F.when(F.col("s") % 3 == 0, "C").otherwise(F.col("raw"))
    rows = source_bars(spark, sf_dir).withColumn("raw", letter)
    counts = rows.groupBy("song", "bar").agg(F.count_if(F.col("raw").rlike("^[A-G]")).alias("letters"), F.count_if(F.col("raw").rlike("^[b#]?[1-7]")).alias("numbers"))
    return counts.withColumn("notation", F.when(F.col("letters") > F.col("numbers"), "letter").otherwise("number"))
