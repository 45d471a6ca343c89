"""Queries of alignment, decoding and shape search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import alignment as A
from tonalframe.operators import catalog as C
from tonalframe.operators import decoding as D
from tonalframe.operators import folds
from tonalframe.operators import sequences as S
from tonalframe.plans import shims
from tonalframe.plans.registry import query
from tonalframe.sources.tables import table


def two_readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Charts, and the same with a bar in eleven missing and one in seven changed."""
    rows = shims.chords(spark, sf_dir)
    rows = rows.select("chart", "bar", "p", "s", T.chord_degree(F.col("raw")).alias("c")).select("chart", "bar", "p", "s", "c.root", "c.bass", "c.quality")
    other = rows.where("p % 11 <> 3").withColumn("root", F.when(F.col("s") % 7 == 2, (F.col("root") + 2) % 12).otherwise(F.col("root")))
    return rows.drop("p", "s"), other.drop("p", "s")


@query()
def chord_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a chart aligned (A1)."""
    return S.aligned_songs(*two_readings(spark, sf_dir), "chart", "bar")


@query()
def crosscheck_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording's bars against a search's, either with bars that have no chord; a missing side counts as gaps (A4)."""
    heard, found = two_readings(spark, sf_dir)
    silent = lambda rows, n: rows.withColumn("root", F.when((F.col("chart") + F.col("bar")) % n != 0, F.col("root")))
    return S.aligned_songs(silent(heard, 6), silent(found, 5), "chart", "bar", score=A.heard_scores, empty=True)


@query()
def alignment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each chart's alignment, and steps left without a partner."""
    rows = S.aligned_songs(*two_readings(spark, sf_dir), "chart", "bar")
    return rows.groupBy("chart").agg(F.bround(F.sum("score") / F.count(F.lit(1)), 6).alias("quality"), F.count_if(F.col("j") < 0).alias("alone"), F.first("total").alias("total"))


@query()
def decoded_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of beats by the best path through 49 states, decoded again in favour of the key found, with sevenths (B1, G3, G4): beats are vectors, 200 to a
    recording, each value standing for some of the 170 classes."""
    x = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    weight = lambda i: F.element_at("x", (i % 64 + 1).cast("int")) * (i * 7 % 5 + 1)
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("series"), (F.col("vec_id") % 200).alias("beat"), x.alias("x"))
    rows = rows.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(169)), weight))
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    return D.chords_of(rows.select("series", "beat", F.transform("p", lambda v: v / total).alias("posterior")), chunk=64)


LCS = """
  SELECT chart, list(raw ORDER BY bar) AS a, list(read ORDER BY bar) AS b FROM (SELECT chart, bar, raw, CASE WHEN p % 3 = 0 THEN raw || 'x' ELSE raw END AS read FROM chords) GROUP BY chart"""


@query(shims.with_shims("SELECT chart, len(a) AS n, CAST(len(list_filter(list_zip(a, b), lambda x: x[1] = x[2])) AS INTEGER) AS lcs FROM lcs", chords=shims.CHORDS, lcs=LCS))
def lcs_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence of two readings (A6); here changed tokens occur nowhere else, so it is the number of equal ones."""
    read = F.when(F.col("p") % 3 == 0, F.concat("raw", F.lit("x"))).otherwise(F.col("raw"))
    rows = shims.chords(spark, sf_dir).select("chart", F.struct("bar", "raw", read.alias("read")).alias("x"))
    rows = rows.groupBy("chart").agg(F.array_sort(F.collect_list("x")).alias("x"))
    a, b = F.transform("x", lambda x: x["raw"]), F.transform("x", lambda x: x["read"])
    rows = rows.select("chart", F.size("x").cast("long").alias("n"), a.alias("a"), b.alias("b"))
    return rows.select("chart", "n", S.lcs_length(F.col("a"), F.col("b")).alias("lcs"))


@query()
def bass_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bass pitches with the least movement."""
    rows = shims.chords(spark, sf_dir).select("chart", "bar", T.chord_degree(F.col("raw"))["bass"].alias("pc"))
    return folds.fold(rows, "chart", ["bar"], ["pc"], S.bass_line, "pitch", "int")


@query()
def viterbi_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of frames by Viterbi, and by arg-max (B1, B2)."""
    frames = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("series"), "vec_id", "embedding")
    return S.decoded(frames, "series", "vec_id", "embedding", 49, 0.8)


NEEDED = "CASE WHEN len(pcs) > 3 THEN list_filter(pcs, lambda x: x <> (root + 7) % 12) ELSE pcs END"
CHORDS = """
  SELECT DISTINCT root, q AS quality, list_transform(list_value([0,4,7],[0,3,7],[0,4,7,10],[0,3,7,10],[0,4,7,11],[0,5,7])[1 + q6], lambda x: (x + root) % 12) AS pcs FROM (
    SELECT CAST((list_value(0,2,4,5,7,9,11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 AS INTEGER) AS root, s % 6 AS q6, list_value('maj', 'm', '7', 'm7', 'maj7', 'sus4')[1 + s % 6] AS q FROM chords)"""
SHAPES = """
  SELECT root, quality, a.f AS f0, b.f AS f1, c.f AS f2, d.f AS f3, (2.0 * n + top + 2.0 * greatest(top - 4, 0) + 1.5 * wide - 1.5 * (4 - n))::DOUBLE AS cost FROM (
    SELECT *, len(pos) AS n, coalesce(list_max(pos), 0) AS top, coalesce(list_max(pos) - list_min(pos), 0) AS wide FROM (
      SELECT u.*, a, b, c, d, list_filter([a.f, b.f, c.f, d.f], lambda x: x > 0) AS pos FROM used u JOIN frets a ON list_contains(pcs, (a.f + 7) % 12) JOIN frets b ON list_contains(pcs, b.f % 12) JOIN frets c ON list_contains(pcs, (c.f + 4) % 12) JOIN frets d ON list_contains(pcs, (d.f + 9) % 12)
      WHERE list_has_all([(a.f + 7) % 12, b.f % 12, (c.f + 4) % 12, (d.f + 9) % 12], needed))) WHERE wide <= 3"""
SHIMS = {"chords": shims.CHORDS, "kinds": CHORDS, "used": f"SELECT *, {NEEDED} AS needed FROM kinds", "frets": "SELECT unnest(range(13))::INTEGER AS f", "shapes": SHAPES}


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = shims.chords(spark, sf_dir).select(T.chord_degree(F.col("raw")).alias("c")).select("c.root", "c.quality").distinct()
    kinds = kinds.withColumn("pcs", T.chord_pcs(F.col("root"), F.col("quality")))
    fifth = F.pmod(F.col("root") + 7, F.lit(12))
    return S.shapes(kinds.withColumn("needed", F.when(F.size("pcs") > 3, F.filter("pcs", lambda x: x != fifth)).otherwise(F.col("pcs"))))


@query(shims.with_shims("SELECT root, quality, count(*) AS n, min(cost) AS least FROM shapes GROUP BY ALL", **SHIMS))
def fretboard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerings of the chords in use."""
    return shapes(spark, sf_dir).groupBy("root", "quality").agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("least"))


@query(shims.with_shims("SELECT root, quality, f0, f1, f2, f3, cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY root, quality ORDER BY cost, f0, f1, f2, f3) AS rank FROM shapes) WHERE rank <= 6", **SHIMS))
def best_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six cheapest fingerings of each chord."""
    return C.top(shapes(spark, sf_dir), ["root", "quality"], ["cost", "f0", "f1", "f2", "f3"], 6)


@query(shims.with_shims("""
SELECT chart, capo, total FROM (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY total, capo) AS k FROM (
  SELECT x.chart, k.capo, sum(b.cost) + 0.4::DOUBLE * k.capo AS total FROM (SELECT chart, CAST((list_value(0,2,4,5,7,9,11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 AS INTEGER) AS root, list_value('maj', 'm', '7', 'm7', 'maj7', 'sus4')[1 + s % 6] AS quality FROM chords) x,
    (SELECT unnest(range(6))::INTEGER AS capo) k JOIN (SELECT root, quality, min(cost) AS cost FROM shapes GROUP BY ALL) b ON b.root = (x.root - k.capo + 12) % 12 AND b.quality = x.quality GROUP BY x.chart, k.capo HAVING count(*) = any_value((SELECT count(*) FROM chords c WHERE c.chart = x.chart)))) WHERE k = 1""", **SHIMS))
def capo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capo that makes a chart's shapes cheapest, the lower of equals; all its chords must be known there."""
    best = shapes(spark, sf_dir).groupBy("root", "quality").agg(F.min("cost").alias("cost"))
    rows = shims.chords(spark, sf_dir).select("chart", T.chord_degree(F.col("raw")).alias("c"), F.count(F.lit(1)).over(Window.partitionBy("chart")).alias("bars"))
    rows = rows.select("chart", "bars", "c.quality", F.col("c.root").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("capo"))
    rows = rows.withColumn("root", F.pmod(F.col("r") - F.col("capo"), F.lit(12))).join(F.broadcast(best), ["root", "quality"])
    totals = rows.groupBy("chart", "capo").agg((F.sum("cost") + 0.4 * F.col("capo")).alias("total"), F.count(F.lit(1)).alias("n"), F.first("bars").alias("bars")).where("n = bars")
    found = totals.groupBy("chart").agg(F.min(F.struct("total", "capo")).alias("b"))
    return found.select("chart", "b.capo", "b.total")


@query()
def voice_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-hand voicings with the least movement."""
    rows = shims.chords(spark, sf_dir).select("chart", "bar", T.chord_degree(F.col("raw")).alias("c"))
    rows = rows.select("chart", "bar", T.chord_pcs(F.col("c.root"), F.col("c.quality")).alias("pcs"))
    known: dict = {}

    def use(c: dict) -> dict:
        got = S.voice_leading([[int(x) for x in p] for p in c["pcs"]], known)
        return {"chart": c["chart"], "bar": c["bar"], "voicing": [list(v) for v in got]}

    return folds.by_song(rows, "chart", ["bar"], use, "chart long, bar long, voicing array<int>")


CHROMA = "SELECT vec_id // 200 AS series, vec_id, unnest(range(12)) AS pc, abs(unnest(embedding[1:12])::DOUBLE) AS e FROM embeddings"


@query(shims.with_shims("""
SELECT series, CASE WHEN e > 1.2 * mean AND e >= root_e AND wins >= 0.25 THEN pc END AS bass FROM (
  SELECT m.series, m.pc, m.e, avg(m.e) OVER (PARTITION BY m.series) AS mean, max(CASE WHEN m.pc = m.series % 12 THEN m.e END) OVER (PARTITION BY m.series) AS root_e, w.wins,
    row_number() OVER (PARTITION BY m.series ORDER BY CASE WHEN (m.pc - m.series % 12 + 12) % 12 IN (4, 7, 2) THEN 0 ELSE 1 END, m.e DESC, m.pc) AS k
  FROM (SELECT series, pc, avg(e) AS e FROM chroma GROUP BY ALL) m JOIN (SELECT a.series, a.pc, avg(CASE WHEN a.e > b.e THEN 1.0 ELSE 0.0 END) AS wins FROM chroma a JOIN chroma b ON a.vec_id = b.vec_id AND b.pc = b.series % 12 GROUP BY ALL) w USING (series, pc)) WHERE k = 1""", chroma=CHROMA))
def inverted_bass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chord tone that outweighs the root in the bass of a segment."""
    frames = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("series"), F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("e"))
    frames = frames.withColumn("root", F.get("e", (F.col("series") % 12).cast("int")))
    sums = [F.avg(F.col("e")[i]) for i in range(12)]
    wins = [F.avg((F.col("e")[i] > F.col("root")).cast("double")) for i in range(12)]
    rows = frames.groupBy("series").agg(F.array(*sums).alias("e"), F.array(*wins).alias("w"))
    tonic = (F.col("series") % 12).cast("int")
    tones = [F.pmod(tonic + d, F.lit(12)) for d in (4, 7, 2)]
    best = F.array_max(F.array(*[F.struct(F.get("e", t).alias("e"), (-t).alias("o"), F.get("w", t).alias("w")) for t in tones]))
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / 12
    rows = rows.select("series", best.alias("b"), mean.alias("mean"), F.get("e", tonic).alias("root_e"))
    ok = (F.col("b.e") > 1.2 * F.col("mean")) & (F.col("b.e") >= F.col("root_e")) & (F.col("b.w") >= 0.25)
    return rows.select("series", F.when(ok, -F.col("b.o")).cast("long").alias("bass"))


@query(shims.with_shims("""
SELECT root, quality, CASE WHEN NOT list_has_all(pcs, snd) OR NOT list_has_all(snd, needed) THEN 'uke_shape_incorrect' WHEN list_max(pos) - list_min(pos) > 3 THEN 'uke_playability_invalid' END AS code
FROM (SELECT b.root, b.quality, u.pcs, u.needed, [(f0 + 7) % 12, f1 % 12, (f2 + 4) % 12, (f3 + 9) % 12] AS snd, list_filter([f0, f1, f2, f3], lambda x: x > 0) AS pos
  FROM (SELECT root, quality, f0 + root % 2 AS f0, f1, f2, f3, row_number() OVER (PARTITION BY root, quality ORDER BY cost, f0, f1, f2, f3) AS k FROM shapes) b JOIN used u ON u.root = b.root AND u.quality = b.quality WHERE k = 1)""", **SHIMS))
def shape_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that miss the chord's tones or stretch too far (Q4: U1, U2); a fret is moved on odd roots."""
    best = C.top(shapes(spark, sf_dir), ["root", "quality"], ["cost", "f0", "f1", "f2", "f3"], 1).withColumn("f0", F.col("f0") + F.col("root") % 2)
    pcs = T.chord_pcs(F.col("root"), F.col("quality"))
    fifth = F.pmod(F.col("root") + 7, F.lit(12))
    rows = best.withColumn("pcs", pcs).withColumn("needed", F.when(F.size("pcs") > 3, F.filter("pcs", lambda x: x != fifth)).otherwise(F.col("pcs")))
    f = [F.col(f"f{k}") for k in range(4)]
    sounding = F.array(*[F.pmod(x + pc, F.lit(12)) for x, pc in zip(f, S.OPEN_STRINGS, strict=True)])
    pressed = F.filter(F.array(*f), lambda x: x > 0)
    wrong = (F.size(F.array_except(sounding, "pcs")) > 0) | (F.size(F.array_except("needed", sounding)) > 0)
    code = F.when(wrong, "uke_shape_incorrect").when(F.array_max(pressed) - F.array_min(pressed) > 3, "uke_playability_invalid")
    return rows.select("root", "quality", code.alias("code"))
