"""One chart out of many: source charts brought to one notation, votes over aligned bars, and the lead sheet that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T

NUMBER = "^[b#]?[1-7]"


def normalised(bars: DataFrame, song: str, source: str, bar: str, tokens: str, played: str) -> DataFrame:
    """Source charts in number notation: song, source, bar (from 0), pos, number, n (chords in the bar), letters. `bars` has an array of tokens for each bar and
    the pitch class of the key that a source's letters are played in.

    A source is in numbers if more than half of its tokens are. Unreadable tokens stay, cleaned; bars without tokens go; bars of more than two chords become one bar each.
    Different tokens are few, so each is read once, for each key."""
    each = bars.select(song, source, bar, played, F.posexplode(tokens).alias("_pos", "_raw")).withColumn("_raw", F.trim("_raw")).where("_raw <> ''")
    kind = each.groupBy(source).agg((2 * F.count_if(F.col("_raw").rlike(NUMBER)) <= F.count(F.lit(1))).alias("letters"))
    each = each.join(kind, source).withColumn("_pc", F.when(F.col("letters"), F.col(played)).otherwise(0).cast("int"))
    known = each.select("_raw", "_pc", "letters").distinct()
    number = F.coalesce(T.chord_degree(F.col("_raw"), F.col("_pc"))["number"], T.clean_chord(F.col("_raw")))
    each = each.join(known.withColumn("number", number), ["_raw", "_pc", "letters"])
    in_bar = Window.partitionBy(source, bar)
    each = each.withColumn("_n", F.count(F.lit(1)).over(in_bar)).withColumn("_k", F.row_number().over(in_bar.orderBy("_pos")) - 1)
    split = F.col("_n") > 2
    new = F.dense_rank().over(Window.partitionBy(source).orderBy(bar, F.when(split, F.col("_k")).otherwise(0))) - 1
    pos, n = F.when(split, 0).otherwise(F.col("_k")), F.when(split, 1).otherwise(F.col("_n"))
    return each.select(song, source, new.cast("long").alias(bar), pos.cast("int").alias("pos"), "number", n.cast("int").alias("n"), "letters")


def first_chords(charts: DataFrame, song: str, source: str, bar: str) -> DataFrame:
    """root, bass and quality of each bar's first chord; null where it is no chord."""
    first = charts.where("pos = 0")
    known = first.select("number").distinct().withColumn("_c", T.chord_degree(F.col("number")))
    return first.join(known, "number").select(song, source, bar, "_c.root", "_c.bass", "_c.quality")


def voted(charts: DataFrame, votes: DataFrame, song: str, source: str, bar: str, key: Column) -> DataFrame:
    """What the sources say in each bar of the reference: song, ref_bar, chords, support, total, alternatives.

    `votes` has (song, ref_bar, source, bar). The number of chords is what most sources have, the first source's of equals; at each place the class (by
    `key` of the column number) with most votes wins, in it the most frequent spelling, the first source's of equals. Support is that of the weakest place."""
    place = [song, "ref_bar"]
    cast = votes.join(charts, [song, source, bar])
    sizes = cast.where("pos = 0").groupBy(*place, "n").agg(F.count(F.lit(1)).alias("_m"), F.min(source).alias("_first"))
    size = sizes.groupBy(*place).agg(F.min_by("n", F.struct(-F.col("_m"), F.col("_first"))).alias("_size"))
    cast = cast.join(size, place).where(F.col("pos") < F.col("_size")).withColumn("_key", key)
    spelled = cast.groupBy(*place, "pos", "_key", "number").agg(F.count(F.lit(1)).alias("_m"), F.min(source).alias("_first"))
    classes = spelled.groupBy(*place, "pos", "_key").agg(
        F.sum("_m").alias("_votes"), F.min("_first").alias("_first"), F.min_by("number", F.struct(-F.col("_m"), F.col("_first"))).alias("_name")
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_votes")).alias("k"), F.col("_first").alias("f"), F.col("_name").alias("name"))))
    places = classes.groupBy(*place, "pos").agg(ranked.alias("r"))
    bars = places.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("p"), F.min(-F.col("r")[0]["k"]).alias("support"))
    others = lambda x: F.filter(F.transform(F.slice(x["r"], 2, F.size(x["r"])), lambda c: c["name"]), lambda c: c != x["r"][0]["name"])
    chords, alternatives = F.transform("p", lambda x: x["r"][0]["name"]), F.array_distinct(F.flatten(F.transform("p", others)))
    total = charts.groupBy(song).agg(F.countDistinct(source).alias("total"))
    return bars.select(*place, chords.alias("chords"), "support", alternatives.alias("alternatives")).join(total, song)


def lead_sheet(bars: DataFrame, song: str, bar: str, section: Column, meter: float = 4.0) -> DataFrame:
    """A row for each chord of a lead sheet: one on beat 1, two on the first beat of each half, more evenly spread; the section's label on its first bar only."""
    n, k = F.size("chords"), F.col("_k")
    beat = 1.0 + k * meter / n
    agree = (F.col("support") >= 2) & (F.col("support") / F.greatest(F.lit(1), F.col("total")) >= 0.5)
    rows = bars.withColumn("_section", section)
    before = F.lag("_section").over(Window.partitionBy(song).orderBy(bar))
    rows = rows.withColumn("section", F.when(before.isNull() | (before != F.col("_section")), F.col("_section")))
    rows = rows.select(song, bar, "section", F.when(agree, "agree").otherwise("search_only").alias("agreement"), "alternatives", n.alias("_n"), F.posexplode("chords").alias("_k", "raw"), "chords")
    return rows.select(song, bar, "section", beat.alias("beat"), "raw", "agreement", F.size("alternatives").alias("n_alternatives"))
