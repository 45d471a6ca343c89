"""Queries of ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import folds
from tonalframe.operators import notes as N
from tonalframe.operators import windows as W
from tonalframe.plans import shims
from tonalframe.plans.registry import query


@query(shims.with_shims("""
SELECT chart, bar, coalesce(last_value(CASE WHEN p % 4 <> 0 THEN raw END IGNORE NULLS) OVER (PARTITION BY chart ORDER BY bar), '1') AS raw, p % 4 = 0 AS filled FROM chords""", chords=shims.CHORDS))
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty bars take the chord before, the tonic at first (K2)."""
    empty = F.col("p") % 4 == 0
    rows = shims.chords(spark, sf_dir).select("chart", "bar", F.when(~empty, F.col("raw")).alias("raw"), empty.alias("filled"))
    return W.carried(rows, "raw", ["chart"], ["bar"], "1")


@query(shims.with_shims("""
SELECT chart, bar, hint, CASE WHEN hint IS NOT NULL THEN hint WHEN held LIKE '%~%' THEN held END AS active
FROM (SELECT chart, bar, hint, last_value(hint IGNORE NULLS) OVER (PARTITION BY chart, bar // 3 ORDER BY bar) AS held
  FROM (SELECT chart, bar, CASE p % 6 WHEN 0 THEN '~5' WHEN 1 THEN '1' WHEN 2 THEN '6~' END AS hint FROM chords))""", chords=shims.CHORDS))
def bass_hint_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bass hint with a tilde holds on to the end of its printed row (K3)."""
    hint = F.when(F.col("p") % 6 == 0, "~5").when(F.col("p") % 6 == 1, "1").when(F.col("p") % 6 == 2, "6~")
    rows = shims.chords(spark, sf_dir).select("chart", "bar", hint.alias("hint"), hint.alias("held"), F.floor(F.col("bar") / 3).alias("system"))
    rows = W.carried(rows, "held", ["chart"], ["bar"], within=F.col("system"))
    return rows.select("chart", "bar", "hint", F.when(F.col("hint").isNotNull(), F.col("hint")).when(F.col("held").contains("~"), F.col("held")).alias("active"))


MOTION = "CASE (({b} - {a}) % 12 + 12) % 12 WHEN 5 THEN 0.85 WHEN 7 THEN 0.85 WHEN 1 THEN 0.8 WHEN 2 THEN 0.8 WHEN 10 THEN 0.8 WHEN 11 THEN 0.8 WHEN 3 THEN 0.7 WHEN 4 THEN 0.7 WHEN 8 THEN 0.7 WHEN 9 THEN 0.7 ELSE 0.4 END::DOUBLE"


PROGRESSION = f"""
SELECT chart, bar, raw, prev, next, CASE WHEN r0 IS NULL AND r1 IS NULL THEN 0.7::DOUBLE ELSE round_even((CASE WHEN r0 IS NULL THEN 0 ELSE coalesce(p.v, {MOTION.format(a="r0", b="r")}) END + CASE WHEN r1 IS NULL THEN 0 ELSE coalesce(q.v, {MOTION.format(a="r", b="r1")}) END)
  / ((r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT), 3) END AS plausibility
FROM (SELECT *, lag(raw) OVER w AS prev, lead(raw) OVER w AS next, lag(r) OVER w AS r0, lead(r) OVER w AS r1, lag(name) OVER w AS n0, lead(name) OVER w AS n1 FROM (
  SELECT chart, bar, raw, (list_value(0,2,4,5,7,9,11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 AS r,
    (1 + p % 7) || (CASE WHEN p % 11 = 0 THEN 'b' ELSE '' END) || list_value('', 'm', '7', 'm7', 'M7', 'sus')[1 + s % 6] || (CASE WHEN p % 5 = 0 THEN '/' || (1 + s % 7) ELSE '' END) AS name FROM chords) WINDOW w AS (PARTITION BY chart ORDER BY bar)) z
LEFT JOIN moves p ON p.x = n0 AND p.y = name LEFT JOIN moves q ON q.x = name AND q.y = n1"""
MOVES = f"SELECT * FROM (VALUES {T.sql_rows((a, b, v) for (a, b), v in T.TRANSITIONS.items())}) t(x, y, v)"


@query(shims.with_shims(PROGRESSION, chords=shims.CHORDS, moves=MOVES))
def progression_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring chords across bars and how plausible the steps between them are, from the table of common steps or the root's motion."""
    rows = shims.chords(spark, sf_dir).select("chart", "bar", "raw")
    w = Window.partitionBy("chart").orderBy("bar")
    rows = rows.withColumns({"prev": F.lag("raw").over(w), "next": F.lead("raw").over(w)})
    # Different tokens and pairs of them are few, so each is read and scored once; the window then takes a pair's score for both of its bars.
    tokens = rows.select("raw").distinct().select("raw", F.struct(T.simple_name(F.col("raw")).alias("name"), T.chord_degree(F.col("raw"))["root"].alias("root")).alias("x"))
    pairs = rows.where("next is not null").select("raw", "next").distinct().join(tokens, "raw").join(tokens.select(F.col("raw").alias("next"), F.col("x").alias("y")), "next")
    pairs = pairs.select("raw", "next", T.transition_score(F.col("x"), F.col("y")).alias("after"))
    rows = rows.join(pairs, ["raw", "next"], "left").withColumn("before", F.lag("after").over(w))
    n = F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")
    mean = F.bround((F.coalesce("before", F.lit(0.0)) + F.coalesce("after", F.lit(0.0))) / n, 3)
    return rows.select("chart", "bar", "raw", "prev", "next", F.when(n > 0, mean).otherwise(0.7).alias("plausibility"))


RUNS = """
  SELECT song, island, any_value(label) AS label, min(bar) AS first, max(bar) AS last, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY song ORDER BY bar) AS island FROM (
      SELECT *, CASE WHEN lag(label) OVER (PARTITION BY song ORDER BY bar) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS new FROM sections)) GROUP BY song, island"""
ROLES = ["verse", "chorus", "intro", "prechorus", "bridge", "interlude", "outro"]
SECTIONS = "SELECT chart AS song, bar, list_value('verse', 'chorus', 'intro')[1 + p % 3] AS label FROM chords"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ["verse", "chorus", "intro"])), (F.col("p") % 3 + 1).cast("int"))
    return shims.chords(spark, sf_dir).select(F.col("chart").alias("song"), "bar", label.alias("label"))


@query(shims.with_shims("SELECT song, CAST(island AS BIGINT) AS island, label, first, last, n FROM runs", chords=shims.CHORDS, sections=SECTIONS, runs=RUNS))
def label_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bars with one label."""
    return W.islands(labelled(spark, sf_dir), "label", ["song"], "bar")


@query(shims.with_shims("""
SELECT song, first, last, label, CASE label WHEN 'verse' THEN 'A' || k WHEN 'chorus' THEN 'B' || k ELSE label || CASE WHEN k = 1 AND label IN ('intro', 'outro') THEN '' ELSE CAST(k AS VARCHAR) END END AS section_id
FROM (SELECT *, row_number() OVER (PARTITION BY song, label ORDER BY first) AS k FROM runs)""", chords=shims.CHORDS, sections=f"SELECT chart AS song, bar, {str(ROLES)}[1 + p % 7] AS label FROM chords", runs=RUNS))
def section_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections named by role and count."""
    label = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("p") % 7 + 1).cast("int"))
    runs = W.islands(shims.chords(spark, sf_dir).select(F.col("chart").alias("song"), "bar", label.alias("label")), "label", ["song"], "bar")
    return W.numbered_sections(runs, ["song"], "label", "first", {"verse": "A", "chorus": "B"}).select("song", "first", "last", "label", "section_id")


def month():
    """Stretches of a player's time."""
    return F.floor(F.col("start") / 2_592_000_000_000)


@query(shims.with_shims("""
SELECT series, CAST(cluster AS BIGINT) AS cluster, min(start) AS first, max(start) AS last, count(*) AS n FROM (
  SELECT series, start, sum(new) OVER (PARTITION BY series ORDER BY start, id) AS cluster FROM (
    SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY series ORDER BY start, id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM notes)) GROUP BY series, cluster""", notes=shims.NOTES))
def note_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of onsets by the gap to the one before."""
    return W.gap_clusters(shims.notes(spark, sf_dir), ["series"], "start", 21_600_000_000, "id", month())


@query(shims.with_shims("""
SELECT series, id, coalesce(last_value(CASE WHEN value > 60 THEN true WHEN value < 20 THEN false END IGNORE NULLS) OVER (PARTITION BY series ORDER BY start, id), false) AS open FROM notes""", notes=shims.NOTES))
def hysteresis_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate with two thresholds."""
    rows = W.hysteresis(shims.notes(spark, sf_dir), ["series"], ["start", "id"], F.col("value") > 60, F.col("value") < 20, month())
    return rows.select("series", "id", "open")


PITCHES = "SELECT series, row_number() OVER (PARTITION BY series ORDER BY start, id) AS i, CASE WHEN id % 5 IN (1, 2) THEN NULL ELSE midi::DOUBLE END AS pitch FROM notes"


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("series").orderBy("start", "id")).cast("long")
    return shims.notes(spark, sf_dir).select("series", i.alias("i"), F.when((F.col("id") % 5).isin(1, 2), None).otherwise(F.col("midi").cast("double")).alias("pitch"))


@query(shims.with_shims("""
SELECT series, i, round_even(coalesce(pitch, CASE WHEN b.i - a.i - 1 <= 3 AND abs(b.v - a.v) <= 4.0 THEN a.v + (b.v - a.v) * (i - a.i) / (b.i - a.i) END), 6) AS pitch FROM (
  SELECT series, i, pitch, last_value(CASE WHEN pitch IS NOT NULL THEN {'i': i, 'v': pitch} END IGNORE NULLS) OVER (PARTITION BY series ORDER BY i) AS a,
    last_value(CASE WHEN pitch IS NOT NULL THEN {'i': i, 'v': pitch} END IGNORE NULLS) OVER (PARTITION BY series ORDER BY i DESC) AS b FROM pitches)""", notes=shims.NOTES, pitches=PITCHES))
def gap_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short gaps between like pitches filled by a line."""
    rows = W.bridged(pitches(spark, sf_dir), ["series"], "i", "pitch", 3, 4.0)
    return rows.select("series", "i", F.bround("pitch", 6).alias("pitch"))


@query(shims.with_shims("""
SELECT series, i, midi, CASE WHEN n < 5 THEN list_median(v) ELSE list_sort(list_transform(range(-2, 3), lambda d: v[CAST((CASE WHEN i - 1 + d < 0 THEN -(i - 1 + d) WHEN i - 1 + d >= n THEN 2 * n - 2 - (i - 1 + d) ELSE i - 1 + d END) + 1 AS BIGINT)]))[3] END::DOUBLE AS med
FROM (SELECT series, i, midi, n, list(midi) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v
  FROM (SELECT series, midi, row_number() OVER (PARTITION BY series ORDER BY start, id) AS i, count(*) OVER (PARTITION BY series) AS n FROM notes))""", notes=shims.NOTES))
def sliding_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of five with mirrored ends."""
    rows = shims.notes(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("start", "id")).cast("long"))
    return W.centred_median(rows.select("series", "i", "midi"), ["series"], ["i"], "midi", 2, "med")


@query(shims.with_shims("""
SELECT series, id, value >= m AND value > coalesce(p, -1) AND value > coalesce(n, -1) AS peak FROM (
  SELECT series, id, value, max(value) OVER (PARTITION BY series ORDER BY start, id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m, lag(value) OVER (PARTITION BY series ORDER BY start, id) AS p,
    lead(value) OVER (PARTITION BY series ORDER BY start, id) AS n FROM notes)""", notes=shims.NOTES))
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that top their surroundings."""
    w = Window.partitionBy("series").orderBy("start", "id")
    top, prev, following = F.max("value").over(w.rowsBetween(-7, 7)), F.coalesce(F.lag("value").over(w), F.lit(-1.0)), F.coalesce(F.lead("value").over(w), F.lit(-1.0))
    v = F.col("value")
    return shims.notes(spark, sf_dir).select("series", "id", ((v >= top) & (v > prev) & (v > following)).alias("peak"))


@query(shims.with_shims("""
SELECT series, id, midi FROM (SELECT *, max(midi) OVER (PARTITION BY series ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM notes) WHERE top IS NULL OR midi >= top""", notes=shims.NOTES))
def monotonic_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that do not fall behind an earlier one."""
    return W.monotonic(shims.notes(spark, sf_dir), ["series"], ["start", "id"], "midi", month()).select("series", "id", "midi")


@query(shims.with_shims("""
SELECT chart, bar, raw FROM (SELECT *, lag(raw) OVER (PARTITION BY chart ORDER BY bar) AS before FROM chords) WHERE before IS DISTINCT FROM raw""", chords=shims.CHORDS))
def repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords without the ones that repeat the chord before."""
    w = Window.partitionBy("chart").orderBy("bar")
    rows = shims.chords(spark, sf_dir).withColumn("prev", F.lag("raw").over(w))
    return rows.where(~F.col("prev").eqNullSafe(F.col("raw"))).select("chart", "bar", "raw")


@query(shims.with_shims("""
SELECT chart, bar, list(raw) OVER (PARTITION BY chart ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM chords QUALIFY p % 17 = 0""", chords=shims.CHORDS))
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged bars with two bars to either side."""
    w = Window.partitionBy("chart").orderBy("bar").rowsBetween(-2, 2)
    return shims.chords(spark, sf_dir).withColumn("around", F.collect_list("raw").over(w)).where("p % 17 = 0").select("chart", "bar", "around")


@query(shims.with_shims("""
SELECT chart, bar FROM (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM (SELECT chart, bar, CASE WHEN p % 4 = 0 THEN 0 ELSE 1 END AS n, s FROM chords) WINDOW w AS (PARTITION BY chart ORDER BY bar))
WHERE n = 0 AND s % 2 = 0 AND (a > 0 OR b > 0)""", chords=shims.CHORDS))
def silent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with melody but no chords beside rows with chords."""
    w = Window.partitionBy("chart").orderBy("bar")
    n = F.when(F.col("p") % 4 == 0, 0).otherwise(1)
    rows = shims.chords(spark, sf_dir).withColumn("n", n)
    rows = rows.withColumn("a", F.lag("n").over(w)).withColumn("b", F.lead("n").over(w))
    return rows.where("n = 0 and s % 2 = 0 and (a > 0 or b > 0)").select("chart", "bar")


@query(shims.with_shims("""
SELECT chart, bar, raw, lead(raw) OVER (PARTITION BY chart ORDER BY bar) AS next_raw, first_value(raw) OVER (PARTITION BY chart, bar // 2 ORDER BY bar) AS primary_raw FROM chords""", chords=shims.CHORDS))
def primary_and_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chord of a pair of bars, and the next bar's chord."""
    w = Window.partitionBy("chart").orderBy("bar")
    pair = Window.partitionBy("chart", F.floor(F.col("bar") / 2)).orderBy("bar")
    return shims.chords(spark, sf_dir).select("chart", "bar", "raw", F.lead("raw").over(w).alias("next_raw"), F.first("raw").over(pair).alias("primary_raw"))


EVENTS = "SELECT series, start // 4000000000 AS bar, (start % 4000000000) / 1000000000 AS o, (1 + id % 3) * 0.5::DOUBLE AS len FROM notes"


@query(shims.with_shims("""
SELECT series, bar, round_even(x.a, 9) AS onset, round_even(x.b - x.a, 9) AS duration, x.r AS is_rest FROM (
  SELECT series, bar, unnest([{'a': prev, 'b': o, 'r': true}, {'a': o, 'b': stop, 'r': false}, {'a': CASE WHEN nxt IS NULL THEN stop ELSE 4.0::DOUBLE END, 'b': 4.0::DOUBLE, 'r': true}]) AS x FROM (
    SELECT *, coalesce(lag(stop) OVER (PARTITION BY series, bar ORDER BY o), 0) AS prev FROM (
      SELECT *, lead(o) OVER w AS nxt, least(o + len, coalesce(lead(o) OVER w, 4), 4)::DOUBLE AS stop FROM (SELECT series, bar, o, max(len) AS len FROM events2 WHERE o < 4 GROUP BY ALL) WINDOW w AS (PARTITION BY series, bar ORDER BY o))))
WHERE x.b - x.a > 1e-9""", notes=shims.NOTES, events2=EVENTS))
def bar_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a bar clipped and its gaps filled with rests."""
    rows = shims.notes(spark, sf_dir)
    bar, at = F.floor(F.col("start") / 4_000_000_000), F.pmod("start", F.lit(4_000_000_000)) / 1_000_000_000
    rows = rows.select("series", bar.alias("bar"), at.alias("at"), ((1 + F.col("id") % 3) * 0.5).alias("len"))
    found = W.tiled(rows, ["series", "bar"], "at", "len", 4.0)
    return found.select("series", "bar", F.bround("onset", 9).alias("onset"), F.bround("duration", 9).alias("duration"), "is_rest")


@query()
def greedy_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets that lie an hour or more after the last one kept."""
    rows = shims.notes(spark, sf_dir).select("series", "id", "start")
    return folds.fold(rows, "series", ["start", "id"], ["start"], lambda x: folds.apart(x, 3_600_000_000), "keep", "boolean")


@query()
def clusters_from_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of onsets by the distance to their first."""
    rows = shims.notes(spark, sf_dir).select("series", "id", "start")
    return folds.fold(rows, "series", ["start", "id"], ["start"], lambda x: folds.from_first(x, 43_200_000_000), "cluster", "long")


@query()
def glitch_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chord labels of beats without one-beat glitches."""
    rows = shims.notes(spark, sf_dir).select("series", "id", "start", "kind", "value")
    return folds.fold(rows, "series", ["start", "id"], ["kind", "value"], folds.smoothed, "smooth", "string").drop("value")


@query()
def run_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short runs of verse and chorus joined to the voiced label before or after them."""
    return folds.fold(labelled(spark, sf_dir), "song", ["bar"], ["label"], lambda x: folds.absorbed(x, 3, ("verse", "chorus")), "steady", "string")


@query()
def beat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of a chart's chords made strictly increasing."""
    rows = shims.chords(spark, sf_dir).select("chart", "bar", "beat")
    return folds.fold(rows, "chart", ["bar"], ["beat"], lambda x: folds.increasing(x, 4.0), "repaired", "double")


@query()
def near_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords without those that repeat one within a quarter of a beat."""
    rows = shims.chords(spark, sf_dir).select("chart", "bar", "raw", "beat")
    return folds.fold(rows, "chart", ["bar"], ["raw", "beat"], folds.not_near, "keep", "boolean").where("keep")


@query()
def section_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed sections with gaps and overlaps mended."""
    p, s = F.col("p"), F.col("s")
    first = (F.col("bar") * 8 + p % 5).cast("long")
    rows = shims.chords(spark, sf_dir).select("chart", "bar", first.alias("first"), (first + s % 12).alias("last"), F.when(p % 2 == 0, "verse").otherwise("chorus").alias("role"))

    def use(c: dict) -> dict:
        got = folds.tiled_sections(list(zip(c["first"].tolist(), c["last"].tolist(), c["role"].tolist(), strict=True)), 64)
        return {"chart": [c["chart"][0]] * len(got), "first": [x[0] for x in got], "last": [x[1] for x in got], "role": [x[2] for x in got]}

    return folds.by_song(rows, "chart", ["bar"], use, "chart long, first long, last long, role string")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of pitch tracks, one track for a player's day: every event sounds for some frames, in its pitch with some vibrato, and fades; some end in silence."""
    day = F.floor(F.col("start") / 86_400_000_000).cast("long")
    rows = shims.notes(spark, sf_dir).select((F.col("series") * 100_000 + day).alias("track"), "start", "id", "midi")
    length = 8 + F.col("id") % 14
    k = F.explode(F.sequence(F.lit(0).cast("long"), length - 1))
    rows = rows.select("track", "start", "id", "midi", length.alias("len"), k.alias("k"))
    silent = (F.col("id") % 5).isin(1, 2) & (F.col("k") >= F.col("len") - F.col("id") % 7)
    midi = 55 + F.col("midi") % 12 + 0.2 * ((F.col("k") % 4) - 1.5)
    hz = 440 * F.pow(F.lit(2.0), (midi - 69) / 12)
    return rows.select(
        "track", "start", "id", "k", hz.alias("hz"), F.when(silent, 0.05).otherwise(0.3 + (F.col("id") % 7) / 20).alias("periodicity"),
        (0.2 * (1 - 0.9 * F.col("k") / F.col("len"))).alias("rms"),
    )


@query()
def note_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes cut out of pitch tracks: gate by energy, dips, deviations from the median, glides, like neighbours."""

    def use(c: dict) -> dict:
        got = N.notes_of(c["hz"], c["periodicity"], c["rms"], 0.02)
        return {"track": [c["track"][0]] * len(got)} | {k: [getattr(n, k) for n in got] for k in ("start", "end", "midi", "confidence", "struck")}

    return folds.by_song(frames(spark, sf_dir), "track", ["start", "id", "k"], use, "track long, start double, end double, midi double, confidence double, struck boolean")


@query(shims.with_shims("""
SELECT a.conv_id, a.turn, min(b.turn) AS like_turn FROM lines a JOIN lines b ON a.conv_id = b.conv_id AND b.turn < a.turn
WHERE length(a.text) >= 4 AND length(b.text) >= 4 AND (contains(a.text, b.text) OR contains(b.text, a.text) OR len(list_intersect(a.cs, b.cs)) / greatest(len(a.cs), len(b.cs)) >= 0.7) GROUP BY ALL""", lines="SELECT conv_id, turn, text, list_distinct(string_split(text, '')) AS cs FROM conversations"))
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first earlier line of a song that holds this one or is held by it, or has mostly the same characters."""
    from tonalframe.sources.tables import table

    rows = table(spark, sf_dir, "conversations").where(F.char_length("text") >= 4).select("conv_id", "turn", "text", F.array_distinct(F.split("text", "")).alias("cs"))
    both = rows.join(rows.select("conv_id", F.col("turn").alias("other"), F.col("text").alias("before"), F.col("cs").alias("ds")), "conv_id").where("other < turn")
    share = F.size(F.array_intersect("cs", "ds")) / F.greatest(F.size("cs"), F.size("ds"))
    return both.where(F.col("text").contains(F.col("before")) | F.col("before").contains(F.col("text")) | (share >= 0.7)).groupBy("conv_id", "turn").agg(F.min("other").alias("like_turn"))
