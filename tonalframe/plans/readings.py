"""Queries of chord tokens, labels, keys and nested charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.plans import shims
from tonalframe.plans.registry import query
from tonalframe.sources.tables import table

ROOTS = ["C", "C#", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
KINDS = ["maj", "min", "7", "maj7", "min7", "hdim7", "dim7", "aug", "sus4", "sus2", "min6", "minmaj7", "odd"]


def picked(values: list[str], at) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


LABELS = f"SELECT p_partkey AS id, p_size, CASE WHEN p_partkey % 17 = 0 THEN 'N' WHEN p_partkey % 19 = 0 THEN '5/7' ELSE {ROOTS}[1 + p_partkey % 13] || ':' || {KINDS}[1 + p_size % 13] END AS label FROM part"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.when(k % 17 == 0, "N").when(k % 19 == 0, "5/7").otherwise(F.concat(picked(ROOTS, k), F.lit(":"), picked(KINDS, F.col("p_size"))))
    return table(spark, sf_dir, "part").select(k.alias("id"), "p_size", label.alias("label"))


@query(shims.with_shims("""
SELECT id, label, CASE WHEN label = 'N' THEN 'N' WHEN contains(label, ':') THEN split_part(label, ':', 1) || ':' || CASE split_part(label, ':', 2) WHEN 'min6' THEN 'min7' WHEN 'maj6' THEN 'maj' WHEN 'minmaj7' THEN 'min' WHEN 'aug' THEN 'maj' WHEN 'dim7' THEN 'dim' WHEN 'sus2' THEN 'sus4' ELSE split_part(label, ':', 2) END ELSE label END AS folded,
  CASE WHEN label = 'N' THEN NULL WHEN label = '5/7' THEN label ELSE
    list_value('1', 'b2', '2', 'b3', '3', '4', '#4', '5', 'b6', '6', 'b7', '7')[1 + (list_value(0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)[1 + id % 13] - p_size % 12 + 12) % 12]
    || list_value('', 'm', '7', 'maj7', 'm7', 'm7-5', 'dim', 'aug', 'sus4', 'sus2', 'm6', '', '')[1 + p_size % 13] END AS degree FROM labels""", labels=LABELS))
def chord_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser's labels with rare qualities folded (F14), and in number notation above a tonic."""
    rows = labels(spark, sf_dir)
    return rows.select("id", "label", T.folded_label(F.col("label")).alias("folded"), T.label_degree(F.col("label"), (F.col("p_size") % 12).cast("int")).alias("degree"))


TOKENS = ["7badd9", "6b/4m", "b4m7", "7add9", "6/4m", "b7add9", "7m7", "2m7/b6", "#4m7", "5m7", "７ m", "①M7", "3♭maj7", "4♯", "m7-5", " 3(2) "]
SIGNED = ["b7add9", "b6/4m", "4m7", "7add9", "6/4m", "b7add9", "7m7", "2m7/b6", "#4m7", "5m7", "７ m", "①M7", "b3maj7", "#4", "m7-5", "3(2)"]
FOLDED = ["7badd9", "6b/4m", "b4m7", "7add9", "6/4m", "b7add9", "7m7", "2m7/b6", "#4m7", "5m7", "７m", "1m7", "3bmaj7", "4#", "m7-5", "3(2)"]


@query(shims.with_shims(f"""
SELECT id, raw, {SIGNED}[1 + id % 16] AS sign_first, id % 16 IN (3, 4, 15) AS needs_sign, id % 16 <> 14 AND (id % 3 = 0 OR id % 16 IN (2, 6, 7, 8)) AS flat_five, {FOLDED}[1 + id % 16] AS folded
FROM tokens""", tokens=f"SELECT p_partkey AS id, {TOKENS}[1 + p_partkey % 16] AS raw FROM part"))
def token_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chord tokens with signs put first (F21), in need of a second look (F22), and folded for comparison."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), picked(TOKENS, k).alias("raw"), F.when(k % 3 == 0, "5m7-5").alias("second"))
    raw = F.col("raw")
    return rows.select("id", "raw", T.sign_first(raw).alias("sign_first"), T.needs_sign(raw).alias("needs_sign"), T.flat_five(raw, F.col("second")).alias("flat_five"), T.folded_token(raw).alias("folded"))


@query(shims.with_shims(f"""
SELECT id, capo, played, CASE WHEN stated = (shapes + capo) % 12 THEN {T.DEFAULT_KEYS}[1 + stated] ELSE {T.DEFAULT_KEYS}[1 + (shapes + capo) % 12] END AS sounding, stated IS NOT NULL AND stated <> (shapes + capo) % 12 AS warned
FROM (SELECT *, {T.DEFAULT_KEYS}[1 + shapes] AS played FROM keys)""", keys="SELECT p_partkey AS id, p_size % 8 AS capo, p_partkey % 12 AS shapes, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN (p_partkey + p_size % 8) % 12 ELSE (p_partkey + 1) % 12 END AS stated FROM part"))
def played_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played and sounding key of a chart with a capo; a stated key that disagrees is noted and not used."""
    k = F.col("p_partkey")
    stated = F.when(k % 3 == 1, picked(T.DEFAULT_KEYS, k + F.col("p_size") % 8)).when(k % 3 == 2, picked(T.DEFAULT_KEYS, k + 1))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") % 8).alias("capo"), picked(T.DEFAULT_KEYS, k).alias("shapes"), stated.alias("stated"))
    sounding = (T.key_pc(F.col("shapes")) + F.col("capo")) % 12
    return rows.select("id", "capo", F.col("shapes").alias("played"), picked(T.DEFAULT_KEYS, sounding).alias("sounding"), F.coalesce(T.key_pc(F.col("stated")) != sounding, F.lit(False)).alias("warned"))


@query(r"""
SELECT id, name, regexp_full_match(name, '[a-zA-Z0-9_-]{1,64}') AND NOT contains(name, '..') AS sheet_ok, regexp_full_match(name, '[a-zA-Z0-9_#+-]{1,64}') AND NOT contains(name, '..') AS render_ok
FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '#') WHEN 2 THEN '../' || p_name WHEN 3 THEN repeat(p_name, 9) ELSE '' END AS name FROM part)""")
def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether identifiers and names of renderings are safe to use in paths (P10)."""
    k, name = F.col("p_partkey"), F.col("p_name")
    made = F.when(k % 5 == 0, F.replace(name, F.lit(" "), F.lit("_"))).when(k % 5 == 1, F.replace(name, F.lit(" "), F.lit("#"))).when(k % 5 == 2, F.concat(F.lit("../"), name)).when(k % 5 == 3, F.repeat(name, 9)).otherwise("")
    ok = lambda more: F.col("name").rlike(f"\\A[a-zA-Z0-9_{more}-]{{1,64}}\\z") & ~F.col("name").contains("..")
    return table(spark, sf_dir, "part").select(k.alias("id"), made.alias("name")).select("id", "name", ok("").alias("sheet_ok"), ok("#+").alias("render_ok"))


NESTED = "SELECT chart, list(struct_pack(bar, raw, p, s) ORDER BY bar) AS bars FROM chords GROUP BY chart"


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested charts: chart, systems, each an array of two bars at most in reading order."""
    rows = shims.chords(spark, sf_dir).groupBy("chart", F.floor(F.col("bar") / 2).alias("row")).agg(F.array_sort(F.collect_list(F.struct("bar", "raw", "p", "s"))).alias("bars"))
    return rows.groupBy("chart").agg(F.array_sort(F.collect_list(F.struct("row", "bars"))).alias("systems"))


@query(shims.with_shims("""
SELECT chart, i - 1 AS place, bars[i].bar AS bar, bars[i].raw AS raw, first_raw FROM (SELECT *, bars[1].raw AS first_raw, unnest(range(1, len(bars) + 1)) AS i FROM nested)""", chords=shims.CHORDS, nested=NESTED))
def flattened_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of nested charts in reading order (P1), and what a chart without a title is called by, its first reading."""
    bars = F.flatten(F.transform("systems", lambda s: s["bars"]))
    rows = charts(spark, sf_dir).select("chart", F.get(F.transform(bars, lambda b: b["raw"]), F.lit(0)).alias("first_raw"), F.posexplode(bars).alias("place", "b"))
    return rows.select("chart", F.col("place").cast("long").alias("place"), "b.bar", "b.raw", "first_raw")


CHANGES = ["(C - D)", "D.S.", "Coda", "(G - G)", "降B - C", "轉 F→Ab", ""]


@query(shims.with_shims(f"""
SELECT chart, bar, raw, semitones, CASE WHEN semitones = 0 THEN 'key_change_filtered' END AS issue FROM (SELECT chart, bar, {CHANGES}[1 + p % 7] AS raw, list_value(2, 0, 0, 0, 2, 3, 0)[1 + p % 7] AS semitones FROM chords)""", chords=shims.CHORDS))
def key_change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key changes read from pairs of keys in text (F19); those of no semitones, marks of the form among them, go and leave an issue."""
    key = "(?:[#b♯♭]?[A-Ga-g][#b♯♭]?|[降升][A-Ga-g])"
    pair = f"({key})\\s*(?:[-–—~→]|->)\\s*({key})"
    rows = shims.chords(spark, sf_dir).select("chart", "bar", picked(CHANGES, F.col("p")).alias("raw"))
    step = F.pmod(T.key_pc(F.regexp_extract("raw", pair, 2)) - T.key_pc(F.regexp_extract("raw", pair, 1)), F.lit(12))
    shift = F.coalesce(F.when(step > 6, step - 12).otherwise(step), F.lit(0)).cast("int")
    return rows.select("chart", "bar", "raw", shift.alias("semitones"), F.when(shift == 0, "key_change_filtered").alias("issue"))


@query(shims.with_shims(f"""
SELECT chart, bar, raw, semitones FROM (SELECT chart, bar, {CHANGES}[1 + p % 7] AS raw, list_value(2, 0, 0, 0, 2, 3, 0)[1 + p % 7] AS semitones FROM chords) WHERE semitones <> 0""", chords=shims.CHORDS))
def key_changes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key changes without those of no semitones."""
    return key_change_filter(spark, sf_dir).where("issue is null").drop("issue")


@query(shims.with_shims("""
SELECT a.chart, a.row, a.x = b.y AS equal, len(a.x) AS n FROM
  (SELECT chart, bar // 2 AS row, list(raw ORDER BY bar) AS x FROM chords GROUP BY ALL) a JOIN
  (SELECT chart, bar // 2 AS row, list(CASE WHEN s % 6 = 4 THEN replace(raw, 'M', 'm') ELSE raw END ORDER BY bar) AS y FROM chords GROUP BY ALL) b ON a.chart = b.chart AND a.row = b.row""", chords=shims.CHORDS))
def ordered_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of bars whose chords were read the same, in order and number (E5)."""
    read = F.when(F.col("s") % 6 == 4, F.replace(F.col("raw"), F.lit("M"), F.lit("m"))).otherwise(F.col("raw"))
    rows = shims.chords(spark, sf_dir).groupBy("chart", F.floor(F.col("bar") / 2).alias("row")).agg(F.array_sort(F.collect_list(F.struct("bar", "raw", read.alias("read")))).alias("b"))
    raws, reads = F.transform("b", lambda x: x["raw"]), F.transform("b", lambda x: x["read"])
    return rows.select("chart", "row", (raws == reads).alias("equal"), F.size("b").cast("long").alias("n"))


@query(shims.with_shims("""
SELECT chart, list(kind ORDER BY first) AS evidence FROM (SELECT chart, list_value('crop', 'inference', 'web')[1 + s % 3] AS kind, min(bar) AS first FROM chords GROUP BY ALL) GROUP BY chart""", chords=shims.CHORDS))
def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of evidence of a chart, each once, in the order in which they came."""
    rows = shims.chords(spark, sf_dir).groupBy("chart").agg(F.array_sort(F.collect_list(F.struct("bar", picked(["crop", "inference", "web"], F.col("s")).alias("kind")))).alias("b"))
    return rows.select("chart", F.array_distinct(F.transform("b", lambda x: x["kind"])).alias("evidence"))


@query(shims.with_shims("""
SELECT song, source, bars, sections FROM (SELECT chart % 500 AS song, chart AS source, count(*) AS bars, count(DISTINCT p % 3) AS sections, count(*) FILTER (s % 23 = 0) AS blank FROM chords GROUP BY ALL) WHERE bars >= 4 AND sections >= 2 AND blank = 0""", chords=shims.CHORDS))
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of a song with enough bars and sections and no empty token."""
    token = F.when(F.col("s") % 23 == 0, "").otherwise(F.col("raw"))
    rows = shims.chords(spark, sf_dir).groupBy((F.col("chart") % 500).alias("song"), F.col("chart").alias("source"))
    found = rows.agg(F.count(F.lit(1)).alias("bars"), F.countDistinct(F.col("p") % 3).alias("sections"), F.count_if(token == "").alias("blank"))
    return found.where("bars >= 4 and sections >= 2 and blank = 0").drop("blank")


@query(shims.with_shims("""
SELECT id, midi FROM notes WHERE id % 11 <> 0 AND id % 7 <> 0 AND value / 100 >= 0.15""", notes=shims.NOTES))
def note_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that last 0.07 seconds or more, sound, and have a confidence of 0.15 or more."""
    rows = shims.notes(spark, sf_dir).select("id", F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("midi")).alias("midi"), F.when(F.col("id") % 7 == 0, 50_000).otherwise(F.col("len")).alias("len"), (F.col("value") / 100).alias("confidence"))
    return rows.where((F.col("len") >= 70_000) & (F.col("midi") > 0) & (F.col("confidence") >= 0.15)).select("id", "midi")


STYLES = ["Slow Rock", "Waltz 3/4", "Soul", "Pop Rock", "Ballad", "", "slow soul pop", "x"]
METERS = ["4/4", "12/8", "3/4"]


@query(shims.with_shims(f"""
SELECT id, style, meter, CASE WHEN meter = '12/8' OR style = 'Slow Rock' THEN 'slow rock' WHEN meter = '3/4' OR style = 'Waltz 3/4' THEN 'waltz' WHEN style IN ('Soul', 'slow soul pop') THEN 'slow soul' WHEN style = 'Pop Rock' THEN 'pop' ELSE 'ballad' END AS canonical FROM styles""", styles=f"SELECT p_partkey AS id, {STYLES}[1 + p_partkey % 8] AS style, {METERS}[1 + p_size % 3] AS meter FROM part"))
def style_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of accompaniment styles by style and metre."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), picked(STYLES, F.col("p_partkey")).alias("style"), picked(METERS, F.col("p_size")).alias("meter"))
    s, m = F.lower(F.trim("style")), F.lower(F.trim("meter"))
    name = F.when(m.isin("12/8", "6/8") | s.contains("slow rock"), "slow rock").when((m == "3/4") | s.rlike("waltz|3/4"), "waltz").when(s.contains("soul"), "slow soul").when(s.contains("pop"), "pop").otherwise("ballad")
    return rows.select("id", "style", "meter", name.alias("canonical"))


@query(r"""
SELECT id, TRY_CAST(nullif(regexp_extract(note, 'measure=(\d+)', 1), '') AS INTEGER) AS measure, regexp_extract(note, 'raw=''([^'']*)''', 1) AS raw, trim(regexp_extract(note, 'reason=(.*)', 1)) AS reason
FROM (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN p_name ELSE 'UNPARSEABLE: measure=' || p_size || ' raw=''' || p_brand || ''' reason= ' || p_name END AS note FROM part) WHERE starts_with(note, 'UNPARSEABLE:')""")
def unparseable_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar, token and reason out of notes on unreadable tokens."""
    note = F.when(F.col("p_partkey") % 3 == 2, F.col("p_name")).otherwise(F.concat(F.lit("UNPARSEABLE: measure="), "p_size", F.lit(" raw='"), "p_brand", F.lit("' reason= "), "p_name"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), note.alias("note")).where(F.startswith("note", F.lit("UNPARSEABLE:")))
    take = lambda pattern: F.regexp_extract("note", pattern, 1)
    return rows.select("id", F.nullif(take("measure=(\\d+)"), F.lit("")).cast("int").alias("measure"), take("raw='([^']*)'").alias("raw"), F.trim(take("reason=(.*)")).alias("reason"))
