"""Queries of scores and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import scores as S
from tonalframe.plans import shims
from tonalframe.plans.registry import query
from tonalframe.plans.windows import MOVES, PROGRESSION, progression_score

STEPS = "list_value(0,2,4,5,7,9,11)"
SOUND = f"""
  SELECT *, ({STEPS}[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 AS root, CASE WHEN p % 5 = 0 THEN {STEPS}[1 + s % 7] ELSE ({STEPS}[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 END AS bass,
    list_value('maj', 'm', '7', 'm7', 'maj7', 'sus4')[1 + s % 6] AS quality FROM chords"""
FIT = f"""
  SELECT chart, bar, raw, bass, root, CASE WHEN sum(w) > 0 THEN sum(CASE WHEN list_contains(list_transform(list_value([0,4,7],[0,3,7],[0,4,7,10],[0,3,7,10],[0,4,7,11],[0,5,7])[1 + s % 6], lambda x: (x + root) % 12), pc) THEN w ELSE 0 END) / sum(w) ELSE 0.5 END AS fit FROM (
    SELECT *, CASE WHEN abs(onset - round_even(onset, 0)) < 0.05 OR abs(onset - 1) < 0.05 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM (
      SELECT *, unnest([1.0, 1.5, 2.0, 3.5]::DOUBLE[]) AS onset, unnest([(p * 3) % 12, (p + s) % 12, s % 12, (p * 7 + s) % 12]) AS pc FROM sound) WHERE onset >= 0.99 AND onset < 2.99) GROUP BY ALL"""


def sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords with their tones and four melody notes a bar."""
    p, s = F.col("p"), F.col("s")
    note = lambda onset, pc: F.struct(F.lit(onset).alias("onset"), (pc % 12).cast("int").alias("pc"))
    notes = F.array(note(1.0, p * 3), note(1.5, p + s), note(2.0, s), note(3.5, p * 7 + s))
    rows = shims.chords(spark, sf_dir).withColumn("c", T.chord_degree(F.col("raw")))
    return rows.select("chart", "bar", "raw", "p", "s", "c.root", "c.bass", "c.quality", T.chord_pcs(F.col("c.root"), F.col("c.quality")).alias("pcs"), notes.alias("notes"))


@query(shims.with_shims("SELECT chart, bar, raw, round_even(fit, 6) AS fit FROM fit", chords=shims.CHORDS, sound=SOUND, fit=FIT))
def melody_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the melody's notes belong to the chord."""
    fit = S.melody_fit(F.col("pcs"), F.col("notes"), F.lit(1.0), F.lit(2.0))
    return sound(spark, sf_dir).select("chart", "bar", "raw", F.bround(fit, 6).alias("fit"))


HINT = "CASE s % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(1 + p % 7 AS VARCHAR) || '1 11' WHEN 2 THEN 'b' || (1 + s % 7) ELSE '.7.7' END"
HINT_PC = f"CASE s % 4 WHEN 1 THEN {STEPS}[1 + p % 7] WHEN 2 THEN ({STEPS}[1 + s % 7] + 11) % 12 WHEN 3 THEN 10 END"


@query(shims.with_shims(f"""
SELECT chart, bar, hint, b AS bass_fit, round_even(CASE WHEN b IS NOT NULL THEN 0.4::DOUBLE * fit + 0.35::DOUBLE * plausibility + 0.25::DOUBLE * b ELSE 0.55::DOUBLE * fit + 0.45::DOUBLE * plausibility END, 6) AS score
FROM (SELECT chart, bar, fit, plausibility, {HINT} AS hint, CASE WHEN {HINT_PC} = f.bass THEN 1.0 WHEN {HINT_PC} IS NOT NULL THEN 0.0 END::DOUBLE AS b FROM fit f JOIN sound USING (chart, bar) JOIN steps USING (chart, bar))""", chords=shims.CHORDS, sound=SOUND, fit=FIT, moves=MOVES, steps=PROGRESSION))
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior of a reading from melody, progression and bass hint."""
    s, p = F.col("s"), F.col("p")
    hint = F.when(s % 4 == 1, F.concat((1 + p % 7).cast("string"), F.lit("1 11"))).when(s % 4 == 2, F.concat(F.lit("b"), (1 + s % 7).cast("string"))).when(s % 4 == 3, ".7.7")
    rows = sound(spark, sf_dir).withColumn("hint", hint).withColumn("bass_fit", S.bass_hint_fit(F.col("bass"), F.col("hint")))
    rows = rows.join(progression_score(spark, sf_dir).select("chart", "bar", "plausibility"), ["chart", "bar"])
    fit = S.melody_fit(F.col("pcs"), F.col("notes"), F.lit(1.0), F.lit(2.0))
    return rows.select("chart", "bar", "hint", "bass_fit", F.bround(S.combined(fit, F.col("plausibility"), F.col("bass_fit")), 6).alias("score"))


@query(shims.with_shims("""
SELECT chart, bar, CASE WHEN g = 0 AND bass = nb THEN 1.0 WHEN g = 0 THEN 0.7 WHEN g IN (3, 4, 8, 9) OR g = 6 AND (quality LIKE '%7%' OR nq LIKE '%7%') THEN 0.3 ELSE -0.6 END::DOUBLE + CASE WHEN quality = nq AND (g IN (0, 3, 4, 8, 9) OR g = 6 AND quality LIKE '%7%') THEN 0.1 ELSE 0 END::DOUBLE AS score
FROM (SELECT chart, bar, bass, quality, lead(bass) OVER w AS nb, lead(quality) OVER w AS nq, (root - lead(root) OVER w + 12) % 12 AS g FROM sound WINDOW w AS (PARTITION BY chart ORDER BY bar)) WHERE nq IS NOT NULL""", chords=shims.CHORDS, sound=SOUND))
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of neighbouring bars' chords, more for equal qualities."""
    here = F.struct("root", "bass", "quality")
    rows = sound(spark, sf_dir).select("chart", "bar", here.alias("a"), F.lead(here).over(Window.partitionBy("chart").orderBy("bar")).alias("b")).where("b is not null")
    score = T.pair_score(F.col("a"), F.col("b"))
    return rows.select("chart", "bar", (score + F.when((F.col("a.quality") == F.col("b.quality")) & (score > 0), 0.1).otherwise(0.0)).alias("score"))


CASES = "SELECT chart, bar, p % 10 <> 0 AS valid, (p % 100) / 100.0::DOUBLE AS prior, (s % 100) / 100.0::DOUBLE AS top, p % 3 = 0 AS a, s % 5 = 0 AS b, p % 2 = 0 AS wr, s % 3 = 0 AS wb, s % 5 <> 1 AS other, p % 6 = 1 AS reread FROM chords"


@query(shims.with_shims("""
SELECT chart, bar, CASE WHEN other AND (NOT valid OR prior < 0.4 AND top >= 0.75) THEN 'replace' WHEN reread THEN 'ambiguous' WHEN NOT valid THEN 'invalid' ELSE 'accept' END AS final,
  CASE WHEN top >= 0.8 AND a AND NOT b THEN 'accept_reader' WHEN top >= 0.7 AND wr AND wb THEN 'accept_web' WHEN top >= 0.7 AND wr THEN 'accept_web_root' ELSE 'review' END AS rung FROM cases""", chords=shims.CHORDS, cases=CASES))
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on undecided readings."""
    p, s = F.col("p"), F.col("s")
    prior, top = (p % 100) / 100.0, (s % 100) / 100.0
    final = S.final_decision(p % 10 != 0, prior, top, s % 5 != 1, p % 6 == 1)
    return shims.chords(spark, sf_dir).select("chart", "bar", final.alias("final"), S.evidence_decision(top, p % 3 == 0, s % 5 == 0, p % 2 == 0, s % 3 == 0).alias("rung"))


@query(shims.with_shims("""
SELECT chart, bar, CASE WHEN beat >= 2.5 THEN 1.0 WHEN beat <= 2 AND s % 3 = 0 THEN 3.0 END::DOUBLE AS missing_at, CASE WHEN nb <= beat OR nb > 4 THEN 3.0 ELSE nb END::DOUBLE AS second_beat
FROM (SELECT *, lead(beat) OVER (PARTITION BY chart ORDER BY bar) AS nb FROM chords)""", chords=shims.CHORDS))
def missing_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a bar seems to lack a chord (D6), and second chords put right."""
    w = Window.partitionBy("chart").orderBy("bar")
    rows = shims.chords(spark, sf_dir).withColumn("nb", F.lead("beat").over(w))
    missing = F.when(F.col("beat") >= 2.5, 1.0).when((F.col("beat") <= 2) & (F.col("s") % 3 == 0), 3.0)
    second = F.when((F.col("nb") <= F.col("beat")) | (F.col("nb") > 4), 3.0).otherwise(F.col("nb"))
    return rows.select("chart", "bar", missing.alias("missing_at"), second.alias("second_beat"))


@query(shims.with_shims("""
SELECT a.chart, a.bar, CASE WHEN ar = sr THEN 'agree' ELSE 'differ' END AS state, CASE WHEN ar <> sr AND support >= 2 AND NOT list_contains(notes, ar) THEN 'search' ELSE 'audio' END AS winner
FROM (SELECT chart, bar, root AS ar, (root + CASE WHEN s % 4 = 0 THEN 5 ELSE 0 END) % 12 AS sr, s % 4 AS support, [(p * 3) % 12, (p + s) % 12, s % 12, (p * 7 + s) % 12] AS notes FROM sound) a""", chords=shims.CHORDS, sound=SOUND))
def crosscheck_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording against search: agreement by the bar's first chord, and who wins (V6, V7)."""
    other = F.pmod(F.col("root") + F.when(F.col("s") % 4 == 0, 5).otherwise(0), F.lit(12))
    rows = sound(spark, sf_dir).withColumn("other", other)
    pcs = F.transform("notes", lambda n: n["pc"])
    search = (F.col("root") != F.col("other")) & (F.col("s") % 4 >= 2) & ~F.array_contains(pcs, F.col("root"))
    return rows.select("chart", "bar", F.when(F.col("root") == F.col("other"), "agree").otherwise("differ").alias("state"), F.when(search, "search").otherwise("audio").alias("winner"))
