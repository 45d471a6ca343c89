"""Queries of many sources aligned to one: notation, evidence, votes, lead sheets, and lyrics placed in time."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T
from tonalframe.operators import alignment as A
from tonalframe.operators import consensus as C
from tonalframe.operators import evaluation as E
from tonalframe.operators import votes as V
from tonalframe.plans.registry import query
from tonalframe.plans.votes import vote_key
from tonalframe.sources.scratch import written
from tonalframe.sources.tables import table

# A customer's items are a source chart, six customers' charts are sources of a song. Sources follow the song's pattern; items say where one leaves a bar out or differs.
LONG = """
  SELECT source, source // 6 AS song, bar, p % 6 = 0 AS other, CASE WHEN p % 9 = 0 THEN 3 WHEN p % 4 = 0 THEN 2 ELSE 1 END AS n,
    (source // 6 * 31 + bar * 17 + (bar % 8) * (bar % 8) * 5) % 210 + CASE WHEN p % 6 = 0 THEN 2 ELSE 0 END AS bp, (source // 6 * 7 + bar * 11) % 60 AS bs
  FROM (SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS bar, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE p % 13 <> 1"""

# Letters of lines placed in one go.
LETTERS = 300_000


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source")), "l_orderkey")
    n = F.row_number().over(Window.partitionBy("source").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = items.select("source", F.floor(F.col("source") / 6).alias("song"), (n - 1).cast("long").alias("bar"), F.col("l_partkey").alias("p")).where("p % 13 <> 1")
    i, song = F.col("bar"), F.col("song")
    base = (song * 31 + i * 17 + (i % 8) * (i % 8) * 5) % 210 + F.when(F.col("p") % 6 == 0, 2).otherwise(0)
    count = F.when(F.col("p") % 9 == 0, 3).when(F.col("p") % 4 == 0, 2).otherwise(1)
    return rows.select("source", "song", "bar", count.alias("n"), base.alias("bp"), ((song * 7 + i * 11) % 60).alias("bs"))


def raw_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts as found: one source in three in letters of the key that it is played in."""
    names, degrees = F.array(*map(F.lit, T.DEFAULT_KEYS)), F.array(*map(F.lit, T.DEGREE_SEMITONES))
    suffixes = F.array(*map(F.lit, ["", "m", "7", "m7", "M7", "sus"]))
    played = (F.col("source") % 12).cast("int")

    def token(k):
        p, s = F.col("bp") + 5 * k, F.col("bs") + 3 * k
        root, bass, turned = (p % 7 + 1).cast("int"), (s % 7 + 1).cast("int"), p % 5 == 0
        suffix = F.element_at(suffixes, (s % 6 + 1).cast("int"))
        letter = lambda d: F.element_at(names, (F.pmod(F.element_at(degrees, d) + played, F.lit(12)) + 1).cast("int"))
        number = F.concat(root.cast("string"), suffix, F.when(turned, F.concat(F.lit("/"), bass.cast("string"))).otherwise(""))
        letters = F.concat(letter(root), suffix, F.when(turned, F.concat(F.lit("/"), letter(bass))).otherwise(""))
        return F.when(F.col("source") % 3 == 0, letters).otherwise(number)

    tokens = F.transform(F.sequence(F.lit(0), F.col("n") - 1), token)
    return long_bars(spark, sf_dir).select("song", "source", "bar", tokens.alias("tokens"), played.alias("played"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalised(written(raw_charts(spark, sf_dir), "raw-charts"), "song", "source", "bar", "tokens", "played")


@query(f"""
WITH long AS ({LONG}), each AS (SELECT song, source, bar, n, unnest(range(0, n)) AS k, bp, bs FROM long),
named AS (SELECT song, source, bar, n, k, list_value(0, 2, 4, 5, 7, 9, 11)[1 + (bp + 5 * k) % 7] AS r, list_value('', 'm', '7', 'm7', 'maj7', 'sus4')[1 + (bs + 3 * k) % 6] AS q,
  CASE WHEN (bp + 5 * k) % 5 = 0 THEN list_value(0, 2, 4, 5, 7, 9, 11)[1 + (bs + 3 * k) % 7] END AS b, {T.SEMITONE_DEGREES} AS d FROM each)
SELECT song, source, dense_rank() OVER (PARTITION BY source ORDER BY bar, CASE WHEN n > 2 THEN k ELSE 0 END) - 1 AS bar, CAST(CASE WHEN n > 2 THEN 0 ELSE k END AS INTEGER) AS pos,
  d[1 + r] || q || CASE WHEN b <> r THEN '/' || d[1 + b] ELSE '' END AS number, CAST(CASE WHEN n > 2 THEN 1 ELSE n END AS INTEGER) AS n, source % 3 = 0 AS letters FROM named""")
def source_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source charts in letters or numbers brought to numbers, bars of more than two chords split."""
    return charts(spark, sf_dir)


def chosen(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("song", "source").agg(F.countDistinct("bar").alias("bars"), F.count(F.lit(1)).alias("chords"))
    return V.reference_source(sizes, "song", "source", "bars", "chords")


def read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The charts, their bars' first chords and each song's reference source, written once, as several branches of a plan read them."""
    rows = written(charts(spark, sf_dir), "charts")
    return rows, written(C.first_chords(rows, "song", "source", "bar"), "first-chords"), written(chosen(rows), "references")


def votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The charts, and which bar of each source votes in which bar of the reference."""
    rows, first, best = read(spark, sf_dir)
    return rows, A.star_votes(first, best, "song", "source", "bar")


@query()
def aligned_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all sources that stand for a bar of the song's reference source."""
    return votes(spark, sf_dir)[1]


@query()
def aligned_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What aligned sources agree on, bar by bar."""
    rows, cast = votes(spark, sf_dir)
    return C.voted(rows, cast, "song", "source", "bar", vote_key(F.col("number")))


@query()
def aligned_lead_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead sheet of the aligned consensus (V5, M5); every eight bars of the reference are a section."""
    rows, cast = votes(spark, sf_dir)
    bars = C.voted(rows, cast, "song", "source", "bar", vote_key(F.col("number")))
    label = F.concat(F.element_at(F.array(F.lit("verse"), F.lit("chorus"), F.lit("bridge")), (F.floor(F.col("ref_bar") / 8) % 3 + 1).cast("int")), F.floor(F.col("ref_bar") / 24).cast("string"))
    return C.lead_sheet(bars, "song", "ref_bar", label)


@query()
def reference_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that other sources offer for each bar of a song's sheet: two passes of alignment, quality of the best source at least 0.30."""
    _, first, best = read(spark, sf_dir)
    sheet = first.join(best.select("song", "source"), ["song", "source"], "left_semi").where("root is not null")
    others = first.join(best.select("song", "source"), ["song", "source"], "left_anti").where("root is not null")
    met = written(A.evidence(sheet.drop("source"), others, "song", "source", "bar"), "evidence")
    size = sheet.groupBy("song").agg(F.count(F.lit(1)).alias("steps"))
    quality = met.groupBy("song", "source").agg(F.sum("score").alias("s")).join(size, "song").groupBy("song").agg(F.max(F.col("s") / F.col("steps")).alias("quality"))
    at = Window.partitionBy("song").orderBy("bar")
    places = sheet.select("song", "bar", (F.row_number().over(at) - 1).cast("int").alias("i"))
    theirs = others.withColumn("j", (F.row_number().over(Window.partitionBy("song", "source").orderBy("bar")) - 1).cast("int"))
    theirs = theirs.select("source", "j", T.number_chord(F.col("root"), F.col("quality"), F.col("bass")).alias("chord"))
    offered = met.join(theirs, ["source", "j"]).join(places, ["song", "i"]).groupBy("song", "bar", "chord").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("sources"))
    support = F.when(F.col("sources") > 1, F.least(F.lit(1.0), F.col("mean") * (1.0 + 0.1 * (F.col("sources") - 1)))).otherwise(F.col("mean"))
    good = quality.where("round(quality, 9) >= 0.30").select("song", F.bround("quality", 6).alias("quality"))
    return offered.select("song", "bar", "chord", F.bround(support, 3).alias("support"), "sources").join(good, "song")


@query()
def placed_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of corrected lines placed in time by aligning them with a draft (A5): every line of the conversations, heard with one letter in seven missing and one
    in five misheard, sung five letters a second, with an onset every third of a second."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "(?<=[.!?\n])\\s+")).alias("line", "text"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "line", F.regexp_replace("text", "[^\\p{L}\\p{N}]", "").alias("text")).where("text <> ''")

    def some(conv, turn, line, texts):
        letters, n = A.code_points("".join(texts)), np.array([len(t) for t in texts])
        of, i = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        known, c, t = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy(), turn.to_numpy()
        start = 10.0 * t
        end = start + 0.2 * n
        begin = start[of] + 0.2 * i
        kept = ~known[of] | (((c + t)[of] + i) % 7 != 0)
        heard = np.where(known[of] & ((c[of] + i) % 5 == 2), ord("?"), letters)[kept]
        count = (3 * (end - start)).astype(np.int64) + 1
        onsets = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) / 3
        times = A.placed_lines(letters, n, heard, np.bincount(of[kept], minlength=len(n)), A.rounded(begin)[kept], A.rounded(begin + 0.18)[kept], start, end, A.rounded(onsets), count)
        ends = np.cumsum(1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000), dtype=np.int32)
        letter = pa.StringArray.from_buffers(len(i), pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer("".join(texts).encode()))
        return pa.RecordBatch.from_arrays([conv.take(pa.array(of)), turn.take(pa.array(of)), line.take(pa.array(of)), pa.array(i.astype(np.int32)), *map(pa.array, times), letter], names=["conv_id", "turn", "line", "i", "start", "end", "letter"])

    def place(batches):
        for b in batches:
            b = b.take(pc.sort_indices(pc.utf8_length(b["text"])))  # lines of like lengths together
            texts = b["text"].to_pylist()
            share = np.cumsum([len(t) for t in texts]) // LETTERS
            edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)]
            for x, y in pairwise(edges):
                if y > x:
                    yield some(*(b[name][x:y] for name in ("conv_id", "turn", "line")), texts[x:y])

    # Few bytes but much work a row: as many tasks as the session deals out.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(place, "conv_id long, turn long, line int, i int, start double, end double, letter string")


@query()
def song_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of long charts held against the charts: rows, measures, chords, beats and key changes (R1). A source's chart is read with one bar in thirteen
    missing, one chord in nine wrong, and beats of one bar in five late."""
    rows = written(long_bars(spark, sf_dir).select("source", "bar", "n", "bp", "bs"), "long-bars")
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    name = (1 + (F.col("bp") + 5 * F.col("k")) % 7).cast("string")
    place = [F.col("source").alias("song"), F.floor(F.col("bar") / 4).alias("row"), (F.col("bar") % 4).alias("measure")]
    beat = 1.0 + F.col("k") * 4 / F.col("n")
    truth = each.select(*place, "k", F.when((F.col("bs") + F.col("k")) % 23 == 0, "?").otherwise(name).alias("raw"), beat.alias("beat"))
    heard = "(source + bar) % 13 <> 5"
    seen = each.where(heard)
    read = seen.select(*place, "k", F.when((F.col("bp") + F.col("k")) % 9 == 4, F.concat(name, F.lit("m"))).otherwise(name).alias("raw"), (beat + F.when(F.col("bs") % 5 == 0, 0.75).when(F.col("bs") % 5 == 1, 0.25).otherwise(0.0)).alias("beat"))
    changes = rows.where("bp % 29 = 3").select(F.col("source").alias("song"), F.col("bar").alias("measure"), (1 + F.col("bs") % 3).cast("int").alias("semitones"))
    read_changes = changes.where("measure % 5 <> 1").withColumn("measure", F.col("measure") + F.col("measure") % 4)
    return E.song_scores(rows.select(*place), rows.where(heard).select(*place), truth, read, changes, read_changes)
