"""Which part of stacked chords is the bass, decided once for a whole chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.functions import theory as T

EXTENSION = "/((?:b9|#9|#11|9|11|13)[-+b#0-9]*)"


def _degree(part: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(part, "^[b#]?([1-7])", 1), F.lit("")), F.lit("9")).cast("int")


def _rest(part: Column) -> Column:
    return F.trim(F.regexp_replace(part, "^[b#]?[1-7][b#]?", ""))


def _tones(degree: Column, rest: Column) -> Column:
    """Degrees of the scale that belong to a chord."""
    step = lambda k, when=None: F.when(F.lit(True) if when is None else when, F.pmod(degree - 1 + k, F.lit(7)) + 1)
    return F.array_compact(F.array(step(0), step(2), step(4), step(6, rest.contains("7")), step(1, rest.contains("9")), step(3, rest.contains("11") | rest.contains("sus"))))


def stacked_orientation(chords: DataFrame, chart: str, order: list[str]) -> DataFrame:
    """chart, orientation, margin, top, bottom: whether the upper (top_is_bass) or the lower part (bottom_is_bass) of stacked chords is the bass. `chords` has raw and melody.

    Where one part has a quality and the other is a bare degree, the first is the chord; if all such chords of a chart agree, that decides, with a margin of 10 for each or that of the scores if larger. Else both
    readings of the whole chart are scored, in one pass: the bass line by its steps (down 2, and 1.5 more from the second in a row on; up 1.5; held 0.5; a leap -1) and chords by the melody's first degree (3 if it belongs to the
    chord, -1 if not). Equal scores mean bottom_is_bass."""
    # Different tokens are few, so each is taken apart once.
    tokens = chords.select("raw").distinct()
    clean = T.clean_chord(F.col("raw"))
    extended = clean.rlike(EXTENSION)
    parts = F.split(F.regexp_replace(clean, EXTENSION, "($1)"), "/")
    known = tokens.select("raw", extended.alias("extended"), F.size(parts).alias("n"), parts[0].alias("top"), F.get(parts, F.lit(1)).alias("low"))
    strong = lambda p: _degree(p).isNotNull() & ~_rest(p).isin("", "maj", "Maj")
    top_q, low_q = F.coalesce(strong(F.col("top")), F.lit(False)), F.coalesce(strong(F.col("low")), F.lit(False))
    stacked = F.col("n") == 2
    bare = lambda p: F.when(F.length(p) > 1, F.regexp_replace(p, "m$", "")).otherwise(p)
    bass = lambda top: F.when(stacked, _degree(bare(F.when(low_q & ~top_q, F.col("top")).when(top_q & ~low_q, F.col("low")).otherwise(F.col("top" if top else "low"))))).when(F.col("n") == 1, _degree(F.col("top")))
    open_ = stacked & ~F.col("extended")
    known = known.select(
        "raw", (open_ & low_q & ~top_q).alias("for_top"), (open_ & top_q & ~low_q).alias("for_bottom"), bass(True).alias("bass_top"), bass(False).alias("bass_bottom"),
        F.when(open_ & _degree(F.col("low")).isNotNull(), _tones(_degree(F.col("low")), _rest(F.col("low")))).alias("tones_top"),
        F.when(open_ & _degree(F.col("top")).isNotNull(), _tones(_degree(F.col("top")), _rest(F.col("top")))).alias("tones_bottom"),
    )
    sung = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce("melody", F.lit("")), "([1-7])", 1), F.lit("")), F.lit("9")).cast("int")
    rows = chords.join(known, "raw").withColumn("sung", sung)
    readings = F.explode(F.array(*[F.struct(F.lit(x).alias("reading"), F.col(f"bass_{x}").alias("bass"), F.col(f"tones_{x}").alias("tones")) for x in ("top", "bottom")])).alias("r")
    each = rows.select(chart, *order, "sung", readings).select(chart, *order, "sung", "r.*")
    fit = F.when(F.col("sung").isNotNull() & F.col("tones").isNotNull(), F.when(F.array_contains("tones", F.col("sung")), 3.0).otherwise(-1.0)).otherwise(0.0)
    melody = each.groupBy(chart, "reading").agg(F.sum(fit).alias("melody"))
    line = each.where("bass is not null")
    w = Window.partitionBy(chart, "reading").orderBy(*order)
    step = F.pmod(F.col("bass") - F.lag("bass").over(w), F.lit(7))
    line = line.withColumn("step", step).withColumn("down", F.coalesce(F.col("step") == 6, F.lit(False)))
    again = F.col("down") & F.coalesce(F.lag("down").over(w), F.lit(False))
    value = F.when(F.col("step").isNull(), 0.0).when(F.col("down"), F.when(again, 3.5).otherwise(2.0)).when(F.col("step") == 1, 1.5).when(F.col("step") == 0, 0.5).otherwise(-1.0)
    motion = line.withColumn("value", value).groupBy(chart, "reading").agg(F.sum("value").alias("motion"))
    scored = melody.join(motion, [chart, "reading"], "left").withColumn("score", F.col("melody") + F.coalesce("motion", F.lit(0.0)))
    pick = lambda x: F.coalesce(F.max(F.when(F.col("reading") == x, F.col("score"))), F.lit(0.0))
    scores = scored.groupBy(chart).agg(pick("top").alias("top"), pick("bottom").alias("bottom"))
    proofs = rows.groupBy(chart).agg(F.count_if("for_top").alias("t"), F.count_if("for_bottom").alias("b"))
    margin = F.bround(F.col("top") - F.col("bottom"), 2)
    found = scores.join(proofs, chart).withColumn("gap", margin)
    sure = ((F.col("t") > 0) != (F.col("b") > 0)).alias("sure")
    is_top = F.when(sure, F.col("t") > 0).otherwise(F.col("gap") > 0)
    size = F.when(sure, F.greatest(F.abs("gap"), 10.0 * (F.col("t") + F.col("b")))).otherwise(F.abs("gap"))
    return found.select(chart, F.when(is_top, "top_is_bass").otherwise("bottom_is_bass").alias("orientation"), size.alias("margin"), "top", "bottom")
