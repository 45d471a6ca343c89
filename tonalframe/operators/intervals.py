"""Joins over intervals, points and nearest values.

Intervals are cut into buckets of fixed width; rows meet on (key, bucket) by an equi-join, so a range join shuffles like any
other and no key's rows are paired as a whole. A pair that meets in several buckets is taken in the first one both share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.operators.windows import by_parts


def bucketed(rows: DataFrame, start: Column, end: Column, width: int, name: str) -> DataFrame:
    """A row for each bucket that [start, end] touches."""
    first, last = F.floor(start / width), F.floor(F.greatest(start, end) / width)
    return rows.withColumn(f"{name}_first", first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlaps(left: DataFrame, right: DataFrame, key: list[str], width: int, pad: int = 0) -> DataFrame:
    """Pairs of left (start, end) and right (r_start, r_end) of one key that overlap by more than nothing, `pad` to either side included."""
    a = bucketed(left, F.col("start") - pad, F.col("end") + pad, width, "_a")
    b = bucketed(right, F.col("r_start"), F.col("r_end"), width, "_b")
    met = a.join(b, [*key, "_bucket"]).where(F.col("_bucket") == F.greatest("_a_first", "_b_first"))
    return met.where((F.col("start") - pad < F.col("r_end")) & (F.col("r_start") < F.col("end") + pad)).drop("_bucket", "_a_first", "_b_first")


def as_of(points: DataFrame, states: DataFrame, key: list[str], at: str, value: str, tie: str, width: int) -> DataFrame:
    """points with `value` of the last state at or before them: one sort of both, no pairs. Stretches of `width` are worked on apart (see windows.by_parts)."""
    both = points.withColumn("_s", F.lit(1)).withColumn("_v", F.lit(None).cast(states.schema[value].dataType))
    other = states.select(*key, F.col(at), F.col(tie), F.lit(0).alias("_s"), F.col(value).alias("_v"))
    rows = by_parts(both.unionByName(other, allowMissingColumns=True), key, [at, "_s", tie], F.floor(F.col(at) / width), "last", F.col("_v"), value)
    return rows.where("_s = 1").drop("_s", "_v")


def near(truth: DataFrame, found: DataFrame, key: list[str], at: str, reach: int) -> DataFrame:
    """truth with `hit`: whether a found value lies within `reach`. Integer values; each found value reaches 2 * reach + 1 of them."""
    steps = F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias(at)
    close = found.select(*key, steps).distinct().withColumn("_hit", F.lit(True))
    return truth.join(close, [*key, at], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def one_to_one(left: DataFrame, right: DataFrame, key: list[str], left_order: str, right_order: str, how: str = "inner") -> DataFrame:
    """Rows of both sides matched once each on `key`, in order: the intersection of multisets."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(right_order)))
    return a.join(b, [*key, "_n"], how).drop("_n")


def split_at(notes: DataFrame, width: int) -> DataFrame:
    """Notes (start, end) cut at multiples of `width`: bar, part_start, part_end, tie (goes on in the next bar)."""
    last = F.floor((F.col("end") - 1) / width)
    each = notes.withColumn("bar", F.explode(F.sequence(F.floor(F.col("start") / width), F.greatest(last, F.floor(F.col("start") / width)))))
    each = each.withColumn("part_start", F.greatest(F.col("start"), F.col("bar") * width)).withColumn("part_end", F.least(F.col("end"), (F.col("bar") + 1) * width))
    return each.withColumn("tie", F.col("part_end") < F.col("end"))
