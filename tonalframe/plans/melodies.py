"""Queries of melodies and beat grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.functions import melodies as M
from tonalframe.plans import shims
from tonalframe.plans.registry import query
from tonalframe.sources.tables import table


@query(shims.with_shims("""
SELECT series, id, x, CASE WHEN abs(x - round_even(x, 0)) <= 0.3 THEN round_even(x, 0) ELSE round_even(x * 2, 0) / 2 END AS grid, greatest(0.0, CASE WHEN abs(x - round_even(x * 2, 0) / 2) <= 0.16 THEN round_even(x * 2, 0) / 2 ELSE round_even(x * 4, 0) / 4 END) AS onset,
  greatest(0.25, round_even(x * 4, 0) / 4) AS duration, CASE WHEN x <= 1.45 THEN 1.0 WHEN x < 2.55 THEN 2.0 WHEN x <= 3.45 THEN 3.0 ELSE 4.0 END::DOUBLE AS beat
FROM (SELECT series, id, (start // 1000000 % 997) / 200.0::DOUBLE AS x FROM notes)""", notes=shims.NOTES))
def beat_snapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets, durations and chord beats on their grids."""
    x = F.floor(F.col("start") / 1_000_000) % 997 / 200.0
    rows = shims.notes(spark, sf_dir).select("series", "id", x.alias("x"))
    x = F.col("x")
    return rows.select("series", "id", "x", M.snap_to_grid(x).alias("grid"), M.snap_onset(x).alias("onset"), M.snap_duration(x).alias("duration"), M.chord_beat(x, 4).alias("beat"))


SIGNATURES = "SELECT p_partkey AS id, list_value('4/4', '6/8', '3/4', '12/8', 'C')[1 + p_size % 5] AS sig FROM part"


@query(f"SELECT id, sig, list_value(4.0, 6.0, 3.0, 12.0, 4.0)[1 + p_size % 5]::DOUBLE AS printed, list_value(4.0, 3.0, 3.0, 6.0, 4.0)[1 + p_size % 5]::DOUBLE AS sounding FROM ({SIGNATURES}) JOIN part ON p_partkey = id")
def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of a bar, counted in two ways (M5)."""
    sig = F.element_at(F.array(*map(F.lit, ["4/4", "6/8", "3/4", "12/8", "C"])), (F.col("p_size") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sig.alias("sig"))
    return rows.select("id", "sig", M.beats_printed(F.col("sig")).alias("printed"), M.beats_sounding(F.col("sig")).alias("sounding"))


@query(shims.with_shims("""
SELECT series, id, round_even(midi, 6) AS midi, CAST(greatest(-2, least(2, floor((midi - 60 - tonic) / 12))) AS BIGINT) AS octave
FROM (SELECT series, id, 69 + 12 * log2((100 + value) / 440.0::DOUBLE) AS midi, series % 12 AS tonic FROM notes)""", notes=shims.NOTES))
def pitch_to_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch numbers of frequencies, and octaves above the tonic."""
    rows = shims.notes(spark, sf_dir).select("series", "id", M.midi_of(100 + F.col("value")).alias("midi"), (F.col("series") % 12).alias("tonic"))
    return rows.select("series", "id", F.bround("midi", 6).alias("midi"), M.octave_of(F.col("midi"), F.col("tonic")).cast("long").alias("octave"))


def melodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chart's bars as tokens: degrees, groups, dots, rests and holds by the numbers of the chord."""
    p, s = F.col("p"), F.col("s")
    note = lambda k: ((p + k * s) % 8).cast("string")
    tokens = F.concat_ws(" ", F.concat(note(1), F.when(s % 3 == 0, ".").otherwise("")), F.concat(note(2), note(3)), F.when(p % 4 == 0, "-").otherwise(note(4)), F.when(s % 2 == 0, note(5)), F.when(s % 5 == 0, note(6)))
    return shims.chords(spark, sf_dir).select("chart", "bar", tokens.alias("melody"))


def parsed(melody: pd.Series) -> pd.DataFrame:
    got = [M.parse(x) or ([], None) for x in melody]
    return pd.DataFrame({"onsets": [[n[0] for n in notes] for notes, _ in got], "degrees": [[n[1] for n in notes] for notes, _ in got], "beat_sum": [b for _, b in got]})


@query()
def melody_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets and beat sums of melody bars (M1, M2); equal bars are parsed once."""
    rows = melodies(spark, sf_dir)
    read = F.pandas_udf(parsed, "struct<onsets:array<double>,degrees:array<int>,beat_sum:double>")
    known = rows.select("melody").distinct().withColumn("m", read("melody"))
    return rows.join(known, "melody").select("chart", "bar", "melody", "m.*")


@query()
def melody_beat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose melody misses a beat or more."""
    return melody_parse(spark, sf_dir).where("abs(beat_sum - 4) >= 1.0").select("chart", "bar", "beat_sum")


@query(shims.with_shims("""
SELECT series, bar, string_agg(CASE WHEN midi % 7 = 0 THEN '0' ELSE CAST(midi % 7 AS VARCHAR) END || CASE WHEN midi % 3 = 0 THEN '.' ELSE '' END, ' ' ORDER BY start, id) AS melody FROM (SELECT *, start // 86400000000 AS bar FROM notes) GROUP BY ALL""", notes=shims.NOTES))
def melody_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of notes written out again."""
    token = F.concat((F.col("midi") % 7).cast("string"), F.when(F.col("midi") % 3 == 0, ".").otherwise(""))
    rows = shims.notes(spark, sf_dir).select("series", F.floor(F.col("start") / 86_400_000_000).alias("bar"), F.struct("start", "id", token.alias("t")).alias("n"))
    return rows.groupBy("series", "bar").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["t"]), " ").alias("melody"))
