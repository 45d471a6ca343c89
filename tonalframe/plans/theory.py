"""Queries of chord and key notation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import windows as W
from tonalframe.plans import shims
from tonalframe.plans.registry import query
from tonalframe.sources.tables import table

NOISY = """
  SELECT chart, bar, raw AS plain, CASE p % 9 WHEN 0 THEN ' "' || raw || '" ' WHEN 1 THEN replace(raw, 'b', '♭') WHEN 2 THEN '[' || translate(raw, '1234567', '①②③④⑤⑥⑦') || ']'
    WHEN 3 THEN translate(raw, '1234567/', '１２３４５６７／') WHEN 4 THEN raw || ' (9)' WHEN 5 THEN replace(raw, 'b', '降') WHEN 6 THEN replace(raw, 'm7', '-7-5') ELSE raw END AS raw
  FROM chords"""
CLEAN = f"""
  SELECT *, regexp_replace(regexp_replace(translate(trim(trim(raw), {T.sql_rows([(T.STRIPPED,)])[1:-1]}), '{T.NOISE_FROM}', '{T.NOISE_TO}'), '\\s+', '', 'g'), '6/9$', '69', 'g') AS c
  FROM noisy"""
PARSED = """
  SELECT *, regexp_extract(top, '^(?:([b#])([1-7])|([1-7])([b#]?))(.*)$', ['a1','d1','d2','a2','q']) AS t,
    regexp_extract(regexp_replace(low, '(.)m$', '\\1'), '^(?:([b#])([1-7])|([1-7])([b#]?))(.*)$', ['a1','d1','d2','a2','q']) AS l
  FROM (SELECT *, CASE WHEN turned THEN y ELSE x END AS top, CASE WHEN turned THEN x ELSE y END AS low FROM (
    SELECT *, split_part(c, '/', 1) AS x, split_part(c, '/', 2) AS y, regexp_matches(split_part(c, '/', 1), '^[b#]?[1-7][b#]?m?$')
      AND c LIKE '%/%' AND NOT regexp_matches(split_part(c, '/', 2), '^[b#]?[1-7][b#]?m?$') AS turned FROM clean))"""


def noisy(chords: DataFrame) -> DataFrame:
    raw, k = F.col("raw"), F.col("p") % 9
    return chords.select(
        "chart", "bar", raw.alias("plain"),
        F.when(k == 0, F.concat(F.lit(' "'), raw, F.lit('" '))).when(k == 1, F.replace(raw, F.lit("b"), F.lit("♭")))
        .when(k == 2, F.concat(F.lit("["), F.translate(raw, "1234567", "①②③④⑤⑥⑦"), F.lit("]"))).when(k == 3, F.translate(raw, "1234567/", "１２３４５６７／"))
        .when(k == 4, F.concat(raw, F.lit(" (9)"))).when(k == 5, F.replace(raw, F.lit("b"), F.lit("降")))
        .when(k == 6, F.replace(raw, F.lit("m7"), F.lit("-7-5"))).otherwise(raw).alias("raw"),
    )


@query(shims.with_shims("""
SELECT chart, bar, raw, c AS cleaned, CASE WHEN ok THEN d END AS degree, CASE WHEN ok THEN a END AS accidental, CASE WHEN ok THEN q END AS quality,
  CASE WHEN ok AND low <> '' THEN bd END AS bass_degree, CASE WHEN ok AND low <> '' THEN ba END AS bass_accidental
FROM (SELECT p.*, s.q, TRY_CAST(t.d1 || t.d2 AS INTEGER) AS d, CASE t.a1 || t.a2 WHEN 'b' THEN -1 WHEN '#' THEN 1 ELSE 0 END AS a,
    TRY_CAST(l.d1 || l.d2 AS INTEGER) AS bd, CASE l.a1 || l.a2 WHEN 'b' THEN -1 WHEN '#' THEN 1 ELSE 0 END AS ba,
    s.q IS NOT NULL AND t.d1 || t.d2 <> '' AND (low = '' AND c NOT LIKE '%/%' OR l.d1 || l.d2 <> '' AND l.q = '') AS ok
  FROM parsed p LEFT JOIN spellings s ON s.x = p.t.q)""",
    chords=shims.CHORDS, noisy=NOISY, clean=CLEAN, parsed=PARSED, spellings=f"SELECT * FROM (VALUES {T.sql_spellings()}) v(x, q)"))
def chord_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy tokens cleaned and parsed."""
    rows = noisy(shims.chords(spark, sf_dir)).withColumn("c", T.parse_number_chord(F.col("raw")))
    return rows.select("chart", "bar", "raw", T.clean_chord(F.col("raw")).alias("cleaned"), "c.*")


@query(shims.with_shims("""
SELECT chart, bar, raw, (n.r + k) % 12 AS root, CASE WHEN (n.r + k) % 12 = (n.b + k) % 12 THEN d1.name || suffix ELSE d1.name || suffix || '/' || d2.name END AS transposed
FROM (SELECT *, CAST(s % 12 AS INTEGER) AS k, (list_value(0,2,4,5,7,9,11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 AS r,
    CASE WHEN p % 5 = 0 THEN list_value(0,2,4,5,7,9,11)[1 + s % 7] ELSE (list_value(0,2,4,5,7,9,11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 END AS b,
    list_value('', 'm', '7', 'm7', 'maj7', 'sus4')[1 + s % 6] AS suffix FROM chords) n
JOIN degrees d1 ON d1.i = (n.r + k) % 12 JOIN degrees d2 ON d2.i = (n.b + k) % 12""",
    chords=shims.CHORDS, degrees=f"SELECT * FROM (VALUES {T.sql_rows(enumerate(T.SEMITONE_DEGREES))}) v(i, name)"))
def chord_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords moved by semitones."""
    k = (F.col("s") % 12).cast("int")
    rows = shims.chords(spark, sf_dir)
    root = F.pmod(T.chord_degree(F.col("raw"))["root"] + k, F.lit(12))
    return rows.select("chart", "bar", "raw", root.alias("root"), T.transpose(F.col("raw"), k).alias("transposed"))


LETTERS = """
  SELECT p_partkey AS id, list_value('C','D','E','F','G','A','B')[1 + p_partkey % 7] AS letter, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 7 NOT IN (2, 3) THEN 'b' WHEN p_partkey % 5 = 1 AND p_partkey % 7 NOT IN (2, 6) THEN '#' ELSE '' END AS sign,
    list_value('', 'm', '7', 'Maj7', 'min7', 'sus', 'm7b5', 'add9')[1 + p_size % 8] AS q, CASE WHEN p_size % 3 = 0 THEN list_value('C','D','E','F','G','A','B')[1 + p_size % 7] END AS bass, p_size % 12 AS tonic FROM part"""


@query(shims.with_shims("""
SELECT id, letter || sign || l.q || coalesce('/' || bass, '') AS raw, letter || sign AS root, k.pc AS root_pc, s.q AS quality, b.pc AS bass_pc, (k.pc - tonic + 12) % 12 AS degree
FROM letters l JOIN keys k ON k.name = upper(letter || sign) LEFT JOIN keys b ON b.name = bass JOIN spellings s ON s.x = l.q""",
    letters=LETTERS, keys=f"SELECT * FROM (VALUES {T.sql_rows(T.KEY_PCS.items())}) v(name, pc)", spellings=f"SELECT * FROM (VALUES {T.sql_spellings()}) v(x, q)"))
def letter_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter notation with its degree relative to a tonic."""
    n, size = F.col("p_partkey"), F.col("p_size")
    letters = F.array(*map(F.lit, "CDEFGAB"))
    letter = F.element_at(letters, (n % 7 + 1).cast("int"))
    sign = F.when((n % 5 == 0) & ~(n % 7).isin(2, 3), "b").when((n % 5 == 1) & ~(n % 7).isin(2, 6), "#").otherwise("")
    quality = F.element_at(F.array(*map(F.lit, ["", "m", "7", "Maj7", "min7", "sus", "m7b5", "add9"])), (size % 8 + 1).cast("int"))
    bass = F.when(size % 3 == 0, F.concat(F.lit("/"), F.element_at(letters, (size % 7 + 1).cast("int")))).otherwise("")
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.concat(letter, sign, quality, bass).alias("raw"), (size % 12).alias("tonic"))
    c = T.parse_letter_chord(F.col("raw"))
    return rows.select("id", "raw", c["root"].alias("root"), c["root_pc"].alias("root_pc"), c["quality"].alias("quality"), c["bass_pc"].alias("bass_pc"), T.chord_degree(F.col("raw"), F.col("tonic"))["root"].alias("degree"))


@query("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN n WHEN 1 THEN '降' || n || '調' WHEN 2 THEN '  ' || n || ' major' ELSE lower(n) || '大調' END AS name,
  CAST(CASE c_custkey % 4 WHEN 1 THEN (v + 11) % 12 ELSE v END AS INTEGER) AS pc
FROM (SELECT c_custkey, list_value('C','D','E','G','A','B','H')[1 + c_nationkey % 7] AS n, list_value(0,2,4,7,9,11,NULL)[1 + c_nationkey % 7] AS v FROM customer)""")
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key names with words and signs around them (F8)."""
    n = F.element_at(F.array(*map(F.lit, "CDEGABH")), (F.col("c_nationkey") % 7 + 1).cast("int"))
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, n).when(k == 1, F.concat(F.lit("降"), n, F.lit("調"))).when(k == 2, F.concat(F.lit("  "), n, F.lit(" major"))).otherwise(F.concat(F.lower(n), F.lit("大調")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"), T.key_pc(name).alias("pc"))


@query(shims.with_shims("""
SELECT chart, bar, semitones, (((chart % 12 + total) % 12) + 12) % 12 AS tonic
FROM (SELECT chart, bar, semitones, CAST(sum(semitones) OVER (PARTITION BY chart ORDER BY bar) AS BIGINT) AS total
  FROM (SELECT chart, bar, CASE WHEN p % 13 = 0 THEN s % 5 - 2 ELSE 0 END AS semitones FROM chords))""", chords=shims.CHORDS))
def key_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tonic at each bar after the key changes so far (K1)."""
    rows = shims.chords(spark, sf_dir)
    changes = rows.where("p % 13 = 0").select("chart", F.col("bar").alias("at_bar"), (F.col("s") % 5 - 2).alias("semitones"))
    return W.key_in_force(rows.select("chart", "bar"), changes, F.col("chart") % 12)


@query(shims.with_shims("""
SELECT chart, bar, raw, k.pc AS tonic, (k.pc + r) % 12 AS root_pc, (k.pc + b) % 12 AS bass_pc,
  list_transform(list_value([0,4,7],[0,3,7],[0,4,7,10],[0,3,7,10],[0,4,7,11],[0,5,7])[1 + s % 6], lambda x: (x + k.pc + r) % 12) AS pcs
FROM (SELECT *, (list_value(0,2,4,5,7,9,11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 AS r,
    CASE WHEN p % 5 = 0 THEN list_value(0,2,4,5,7,9,11)[1 + s % 7] ELSE (list_value(0,2,4,5,7,9,11)[1 + p % 7] + CASE WHEN p % 11 = 0 THEN 11 ELSE 0 END) % 12 END AS b FROM chords) c
JOIN (SELECT chart, CAST(chart % 12 AS INTEGER) AS pc FROM (SELECT DISTINCT chart FROM chords)) k USING (chart)""", chords=shims.CHORDS))
def chord_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounding root, bass and pitch classes under a tonic."""
    tonic = (F.col("chart") % 12).cast("int")
    rows = shims.chords(spark, sf_dir).withColumn("c", T.chord_degree(F.col("raw")))
    root = F.pmod(tonic + F.col("c.root"), F.lit(12))
    return rows.select("chart", "bar", "raw", tonic.alias("tonic"), root.alias("root_pc"), F.pmod(tonic + F.col("c.bass"), F.lit(12)).alias("bass_pc"), T.chord_pcs(root, F.col("c.quality")).alias("pcs"))


@query(shims.with_shims("""
SELECT song, t AS tonic, n AS fit FROM (
  SELECT song, t, n, row_number() OVER (PARTITION BY song ORDER BY n DESC, t) AS k FROM (
    SELECT song, t, count(*) FILTER (((r - t) % 12 + 12) % 12 IN (0,2,4,5,7,9,10,11)) + CASE WHEN (min_by(r, pos) - t) % 12 = 0 THEN 0.5::DOUBLE ELSE 0 END AS n
    FROM (SELECT chart % 500 AS song, chart * 8 + bar AS pos, CAST((p * 5) % 12 AS INTEGER) AS r FROM chords), (SELECT unnest(range(12))::INTEGER AS t) GROUP BY song, t))
WHERE k = 1""", chords=shims.CHORDS))
def tonic_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tonic whose scale holds most roots, the first of equals (F16)."""
    rows = shims.chords(spark, sf_dir).select((F.col("chart") % 500).alias("song"), (F.col("chart") * 8 + F.col("bar")).alias("pos"), (F.col("p") * 5 % 12).cast("int").alias("r"))
    # Counting roots first keeps twelve rows a song, whatever its length.
    roots = rows.groupBy("song", "r").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    first = roots.groupBy("song").agg(F.min_by("r", "pos").alias("first"), F.collect_list(F.struct("r", "n")).alias("roots"))
    each = first.select("song", "first", "roots", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tonic"))
    inside = lambda x: F.pmod(x["r"] - F.col("tonic"), F.lit(12)).isin(0, 2, 4, 5, 7, 9, 10, 11)
    fit = F.aggregate(F.filter("roots", inside), F.lit(0.0), lambda a, x: a + x["n"]) + F.when(F.col("first") == F.col("tonic"), 0.5).otherwise(0.0)
    best = each.withColumn("fit", fit).groupBy("song").agg(F.max_by(F.struct("tonic", "fit"), F.struct("fit", -F.col("tonic"))).alias("b"))
    return best.select("song", "b.tonic", "b.fit")


@query(shims.with_shims("""
SELECT chart, bar, raw, root, CASE WHEN p % 10 = 3 AND root IS NOT NULL THEN 1 + s % 7 ELSE b END AS bass
FROM (SELECT *, last_value(CASE WHEN p % 10 <> 3 THEN 1 + p % 7 END IGNORE NULLS) OVER w AS root,
    CASE WHEN p % 5 = 0 THEN 1 + s % 7 ELSE 1 + p % 7 END AS b,
    CASE WHEN p % 10 = 3 THEN '/' || CAST(1 + s % 7 AS VARCHAR) ELSE raw END AS tok FROM (SELECT chart, bar, p, s, CASE WHEN p % 10 = 3 THEN '/' || CAST(1 + s % 7 AS VARCHAR) ELSE raw END AS raw FROM chords)
  WINDOW w AS (PARTITION BY chart ORDER BY bar))
WHERE root IS NOT NULL""", chords=shims.CHORDS))
def slash_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leading slash means the chord before over a new bass (F7); degrees without accidentals here."""
    rows = shims.chords(spark, sf_dir)
    raw = F.when(F.col("p") % 10 == 3, F.concat(F.lit("/"), (1 + F.col("s") % 7).cast("string"))).otherwise(F.col("raw"))
    rows = rows.select("chart", "bar", raw.alias("raw")).withColumn("c", T.parse_number_chord(F.col("raw")))
    w = Window.partitionBy("chart").orderBy("bar")
    root = F.last("c.degree", ignorenulls=True).over(w)
    new = F.regexp_extract(T.clean_chord(F.col("raw")), "^/[b#]?([1-7])", 1)
    found = rows.select("chart", "bar", "raw", root.alias("root"), F.coalesce(F.try_to_number(F.nullif(new, F.lit("")), F.lit("9")).cast("int"), F.col("c.bass_degree"), F.col("c.degree")).alias("bass"))
    return found.where("root is not null").select("chart", "bar", "raw", F.col("root").cast("long").alias("root"), F.col("bass").cast("long").alias("bass"))


CHANGES = """
  SELECT c_custkey AS id, list_value('C', 'D', 'F#', 'Bb')[1 + c_custkey % 4] AS prev, CASE c_custkey % 5 WHEN 0 THEN '轉' || list_value('2', '3', 'b7', '4#')[1 + c_nationkey % 4] || '調' WHEN 1 THEN '轉 1=' || list_value('B', 'E', 'Ab')[1 + c_nationkey % 3]
    WHEN 2 THEN '(F# - Ab)' WHEN 3 THEN '升半調' ELSE 'D.S. al Coda' END AS text FROM customer"""


@query(f"""
SELECT id, text, CASE id % 5 WHEN 0 THEN list_value(2, 4, -2, 6)[1 + n % 4] WHEN 1 THEN CASE WHEN up > 6 THEN up - 12 ELSE up END WHEN 2 THEN 2 ELSE 0 END::INTEGER AS semitones, CASE WHEN id % 5 = 0 AND n % 4 < 2 THEN list_value(2, 3)[1 + n % 4] WHEN id % 5 = 3 THEN 1 END::INTEGER AS printed
FROM (SELECT c.*, c_nationkey AS n, (list_value(11, 4, 8)[1 + c_nationkey % 3] - list_value(0, 2, 6, 10)[1 + id % 4] + 12) % 12 AS up FROM ({CHANGES}) c JOIN customer ON c_custkey = id)""")
def key_change_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semitones of key-change notes in their two readings."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    text = (
        F.when(i % 5 == 0, F.concat(F.lit("轉"), pick(["2", "3", "b7", "4#"], n % 4), F.lit("調"))).when(i % 5 == 1, F.concat(F.lit("轉 1="), pick(["B", "E", "Ab"], n % 3)))
        .when(i % 5 == 2, "(F# - Ab)").when(i % 5 == 3, "升半調").otherwise("D.S. al Coda")
    )
    rows = table(spark, sf_dir, "customer").select(i.alias("id"), text.alias("text"), pick(["C", "D", "F#", "Bb"], i % 4).alias("prev"))
    return rows.select("id", "text", T.modulation(F.col("text"), F.col("prev")).alias("semitones"), T.printed_shift(F.col("text")).alias("printed"))


@query()
def reading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that a scanner may have confused (C4); tokens are few, so each is worked out once."""
    rows = shims.chords(spark, sf_dir).select("chart", "bar", "raw")
    known = rows.select("raw").distinct().withColumn("candidates", T.reading_candidates(F.col("raw")))
    return rows.join(known, "raw")


@query(shims.with_shims("""
SELECT series, id, list_value('1','b2','2','b3','3','4','#4','5','b6','6','b7','7')[CAST(((a % 12) + 12) % 12 AS BIGINT) + 1] || repeat(CASE WHEN o > 0 THEN chr(39) ELSE ',' END, abs(o)) AS name
FROM (SELECT series, id, midi - 60 - series % 12 AS a, CAST(greatest(-2, least(2, floor((midi - 60 - series % 12) / 12))) AS BIGINT) AS o FROM notes)""", notes=shims.NOTES))
def jianpu_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in numbered notation."""
    return shims.notes(spark, sf_dir).select("series", "id", T.jianpu(F.col("midi"), F.col("series") % 12).alias("name"))
