"""Queries of joins over intervals, points and nearest values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.operators import intervals as I
from tonalframe.plans import shims
from tonalframe.plans.registry import query
from tonalframe.sources.tables import table

HOUR = 3_600_000_000
DAY = 24 * HOUR


def spans(spark: SparkSession, sf_dir: str, scale: int = 60) -> DataFrame:
    return shims.notes(spark, sf_dir).select("series", "id", "start", (F.col("start") + F.col("len") * scale).alias("end"), "midi")


@query(shims.with_shims(f"""
SELECT series, bar, count(*) AS n, CAST(sum(least(stop, (bar + 1) * {DAY}) - greatest(start, bar * {DAY})) AS BIGINT) AS overlap,
  round_even(CAST(sum(midi * (least(stop, (bar + 1) * {DAY}) - greatest(start, bar * {DAY}))) AS DOUBLE) / sum(least(stop, (bar + 1) * {DAY}) - greatest(start, bar * {DAY})), 6) AS pitch
FROM (SELECT series, start, start + len * 60 AS stop, midi, unnest(range(start // {DAY}, (start + len * 60 - 1) // {DAY} + 1)) AS bar FROM notes) GROUP BY series, bar""", notes=shims.NOTES))
def overlap_by_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounding time and its mean pitch in each bar."""
    notes = spans(spark, sf_dir)
    ends = notes.groupBy("series").agg(F.min(F.floor(F.col("start") / DAY)).alias("a"), F.max(F.floor((F.col("end") - 1) / DAY)).alias("b"))
    bars = ends.select("series", F.explode(F.sequence("a", "b")).alias("bar"))
    bars = bars.select("series", "bar", (F.col("bar") * DAY).alias("r_start"), ((F.col("bar") + 1) * DAY).alias("r_end"))
    met = I.overlaps(notes, bars, ["series"], DAY)
    length = F.least("end", "r_end") - F.greatest("start", "r_start")
    found = met.groupBy("series", "bar").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("overlap"), F.sum(F.col("midi") * length).alias("weighted"))
    return found.select("series", "bar", "n", "overlap", F.bround(F.col("weighted").cast("double") / F.col("overlap"), 6).alias("pitch"))


@query(shims.with_shims(f"""
SELECT series, id, bar, greatest(start, bar * {DAY}) AS part_start, least(stop, (bar + 1) * {DAY}) AS part_end, least(stop, (bar + 1) * {DAY}) < stop AS tie
FROM (SELECT series, id, start, start + len * 60 AS stop, unnest(range(start // {DAY}, (start + len * 60 - 1) // {DAY} + 1)) AS bar FROM notes)""", notes=shims.NOTES))
def split_at_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes cut at bar lines, with ties."""
    return I.split_at(spans(spark, sf_dir), DAY).select("series", "id", "bar", "part_start", "part_end", "tie")


@query(shims.with_shims("""
SELECT a.series, a.id, b.midi AS chord FROM (SELECT * FROM notes WHERE kind <> 'click') a
ASOF LEFT JOIN (SELECT series, start, max_by(midi, id) AS midi FROM notes WHERE kind = 'click' GROUP BY ALL) b ON a.series = b.series AND a.start >= b.start""", notes=shims.NOTES))
def asof_chord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the last chord at or before it."""
    rows = shims.notes(spark, sf_dir)
    points = rows.where("kind <> 'click'").select("series", "id", "start")
    states = rows.where("kind = 'click'").select("series", "id", "start", F.col("midi").alias("chord"))
    return I.as_of(points, states, ["series"], "start", "chord", "id", 30 * DAY).select("series", "id", "chord")


@query(shims.with_shims("""
SELECT a.series, a.id FROM notes a WHERE kind = 'view' AND EXISTS (SELECT 1 FROM notes b WHERE b.kind <> 'view' AND a.series = b.series AND a.start - 250000000 < b.start + b.len AND b.start < a.start + a.len + 250000000)""", notes=shims.NOTES))
def lyric_on_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that some note overlaps, with a pad to either side."""
    rows = spans(spark, sf_dir, 1).join(shims.notes(spark, sf_dir).select("id", "kind"), "id")
    chars = rows.where("kind = 'view'").select("series", "id", "start", "end")
    sung = rows.where("kind <> 'view'").select("series", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.overlaps(chars, sung, ["series"], HOUR, 250_000_000).select("series", "id").distinct()


TRUTH = "SELECT chart, bar, raw, CASE WHEN chart % 9 = 0 AND bar % 2 = 0 THEN raw || '7' ELSE raw END AS read, CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END AS edge, CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS guess FROM chords"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = (F.col("chart") % 9 == 0) & (F.col("bar") % 2 == 0)
    return shims.chords(spark, sf_dir).select("chart", "bar", "raw", F.when(wrong, F.concat("raw", F.lit("7"))).otherwise(F.col("raw")).alias("read"), (F.col("p") % 3 == 0).alias("edge"), (F.col("s") % 3 == 0).alias("guess"))


@query(shims.with_shims("""
SELECT chart, n_truth, n_guess, CASE WHEN n_guess = 0 THEN 1.0 ELSE g / n_guess END::DOUBLE AS precision, CASE WHEN n_truth = 0 THEN 1.0 ELSE t / n_truth END::DOUBLE AS recall
FROM (SELECT chart, count(*) FILTER (edge = 1) AS n_truth, count(*) FILTER (guess = 1) AS n_guess, count(*) FILTER (edge = 1 AND near_guess) AS t, count(*) FILTER (guess = 1 AND near_edge) AS g FROM (
  SELECT a.*, EXISTS (SELECT 1 FROM truth b WHERE b.chart = a.chart AND b.guess = 1 AND abs(a.bar - b.bar) <= 1) AS near_guess, EXISTS (SELECT 1 FROM truth b WHERE b.chart = a.chart AND b.edge = 1 AND abs(a.bar - b.bar) <= 1) AS near_edge FROM truth a) GROUP BY chart)""",
    chords=shims.CHORDS, truth=TRUTH))
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of boundaries within one bar."""
    rows = truth(spark, sf_dir)
    edges, guesses = rows.where("edge").select("chart", "bar"), rows.where("guess").select("chart", "bar")
    t = I.near(edges, guesses, ["chart"], "bar", 1).groupBy("chart").agg(F.count(F.lit(1)).alias("n_truth"), F.count_if("hit").alias("t"))
    g = I.near(guesses, edges, ["chart"], "bar", 1).groupBy("chart").agg(F.count(F.lit(1)).alias("n_guess"), F.count_if("hit").alias("g"))
    found = rows.select("chart").distinct().join(t, "chart", "left").join(g, "chart", "left").fillna(0)
    share = lambda a, n: F.when(F.col(n) == 0, 1.0).otherwise(F.col(a) / F.nullif(F.col(n), F.lit(0)))
    return found.select("chart", "n_truth", "n_guess", share("g", "n_guess").alias("precision"), share("t", "n_truth").alias("recall"))


@query(shims.with_shims("""
SELECT chart, CAST(sum(least(a, b)) AS BIGINT) AS matched, CAST(sum(a) AS BIGINT) AS n_truth, CAST(sum(b) AS BIGINT) AS n_read FROM (
  SELECT chart, tok, sum(a) AS a, sum(b) AS b FROM (SELECT chart, raw AS tok, 1 AS a, 0 AS b FROM truth UNION ALL SELECT chart, read, 0, 1 FROM truth) GROUP BY chart, tok) GROUP BY chart""", chords=shims.CHORDS, truth=TRUTH))
def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of two readings matched one to one."""
    rows = truth(spark, sf_dir)
    a = rows.select("chart", F.col("raw").alias("tok"), F.col("bar").alias("a"))
    b = rows.select("chart", F.col("read").alias("tok"), F.col("bar").alias("b"))
    met = I.one_to_one(a, b, ["chart", "tok"], "a", "b", "full")
    return met.groupBy("chart").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count("a").alias("n_truth"), F.count("b").alias("n_read")
    )


@query(shims.with_shims("""
SELECT chart, tok, bar, side FROM (
  SELECT a.chart, a.tok, a.bar, 'truth' AS side FROM own a LEFT JOIN other b USING (chart, tok, k) WHERE b.bar IS NULL UNION ALL
  SELECT b.chart, b.tok, b.bar, 'read' FROM other b LEFT JOIN own a USING (chart, tok, k) WHERE a.bar IS NULL)""", chords=shims.CHORDS, truth=TRUTH,
    own="SELECT chart, raw AS tok, bar, row_number() OVER (PARTITION BY chart, raw ORDER BY bar) AS k FROM truth", other="SELECT chart, read AS tok, bar, row_number() OVER (PARTITION BY chart, read ORDER BY bar) AS k FROM truth"))
def left_over_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of either reading that the one-to-one match of a song leaves over (J10 on J7's key)."""
    rows = truth(spark, sf_dir)
    a = rows.select("chart", F.col("raw").alias("tok"), F.col("bar").alias("a"))
    b = rows.select("chart", F.col("read").alias("tok"), F.col("bar").alias("b"))
    met = I.one_to_one(a, b, ["chart", "tok"], "a", "b", "full").where("a is null or b is null")
    return met.select("chart", "tok", F.coalesce("a", "b").alias("bar"), F.when(F.col("b").isNull(), "truth").otherwise("read").alias("side"))


@query(shims.with_shims("SELECT chart, bar, raw, read FROM truth WHERE raw <> read", chords=shims.CHORDS, truth=TRUTH))
def unmatched_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords without a partner in the other reading of their bar."""
    rows = truth(spark, sf_dir)
    other = rows.select("chart", "bar", F.col("read").alias("raw"))
    alone = rows.select("chart", "bar", "raw").join(other, ["chart", "bar", "raw"], "left_anti")
    return alone.join(rows.select("chart", "bar", "read"), ["chart", "bar"])


@query(shims.with_shims("""
SELECT a.chart, a.page, a.row, a.tok, coalesce(b.tok, c.tok) AS found, b.tok IS NOT NULL AS direct
FROM (SELECT chart, bar // 4 AS page, bar % 4 AS row, row_number() OVER (PARTITION BY chart ORDER BY bar) AS k, raw AS tok FROM chords) a
LEFT JOIN (SELECT chart, bar // 4 AS page, bar % 4 AS row, raw AS tok FROM chords WHERE p % 5 <> 0) b USING (chart, page, row)
LEFT JOIN (SELECT chart, row_number() OVER (PARTITION BY chart ORDER BY bar) AS k, raw AS tok FROM chords WHERE p % 5 <> 0) c ON a.chart = c.chart AND a.k = c.k""", chords=shims.CHORDS))
def row_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows paired by page and row, else by their place in the chart."""
    from pyspark.sql import Window

    w = Window.partitionBy("chart").orderBy("bar")
    rows = shims.chords(spark, sf_dir)
    place = [F.floor(F.col("bar") / 4).alias("page"), (F.col("bar") % 4).alias("row"), F.row_number().over(w).alias("k")]
    a = rows.select("chart", *place, F.col("raw").alias("tok"))
    read = rows.where("p % 5 <> 0").select("chart", *place, F.col("raw").alias("t"))
    direct, by_place = read.select("chart", "page", "row", F.col("t").alias("t1")), read.select("chart", "k", F.col("t").alias("t2"))
    met = a.join(direct, ["chart", "page", "row"], "left").join(by_place, ["chart", "k"], "left")
    return met.select("chart", "page", "row", "tok", F.coalesce("t1", "t2").alias("found"), F.col("t1").isNotNull().alias("direct"))


@query(shims.with_shims("""
SELECT chart, first_bar, min(section) AS section FROM (SELECT chart, section, (section * 3 + 1) // 2 AS first_bar FROM (SELECT DISTINCT chart, bar // 2 AS section FROM chords)) GROUP BY chart, first_bar""", chords=shims.CHORDS))
def section_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section moved to its nearest bar, the first section of a bar staying."""
    sections = shims.chords(spark, sf_dir).select("chart", F.floor(F.col("bar") / 2).alias("section")).distinct()
    return sections.withColumn("first_bar", F.floor((F.col("section") * 3 + 1) / 2)).groupBy("chart", "first_bar").agg(F.min("section").alias("section"))


@query(shims.with_shims("""
SELECT chart, bar, x, CASE WHEN abs(x - round_even(x * 4, 0) / 4) > 0.04 THEN CAST(floor(x * 4) AS BIGINT) ELSE least(bar, 3) END AS measure FROM (SELECT chart, bar, (p % 100) / 100.0::DOUBLE AS x FROM chords)""", chords=shims.CHORDS))
def position_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a row sent to a measure by place, or by ordinal where the place is near a boundary."""
    x = (F.col("p") % 100) / 100.0
    clear = F.abs(F.col("x") - F.rint(F.col("x") * 4) / 4) > 0.04
    rows = shims.chords(spark, sf_dir).select("chart", "bar", x.alias("x"))
    return rows.withColumn("measure", F.when(clear, F.floor(F.col("x") * 4)).otherwise(F.least("bar", F.lit(3))))


@query(shims.with_shims("""
SELECT chart, bar, f, CASE WHEN f < 0.15 OR f >= 0.85 THEN 1 WHEN f >= 0.35 AND f < 0.65 THEN 3 ELSE 2 END AS phase FROM (SELECT chart, bar, (s % 100) / 100.0::DOUBLE AS f FROM chords)""", chords=shims.CHORDS))
def bar_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beat's place in the bar from its share of the way between downbeats."""
    f = F.col("f")
    rows = shims.chords(spark, sf_dir).select("chart", "bar", ((F.col("s") % 100) / 100.0).alias("f"))
    return rows.withColumn("phase", F.when((f < 0.15) | (f >= 0.85), 1).when((f >= 0.35) & (f < 0.65), 3).otherwise(2))


@query("""
SELECT o_custkey AS id, count(*) AS n, max(o_orderkey) AS latest FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY o_custkey""")
def live_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose state exists and is not deleted."""
    states = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").join(states, "o_custkey", "left_semi")
    return rows.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("latest"))
