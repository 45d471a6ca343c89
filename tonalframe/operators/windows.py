"""Ordered operators as windows: state in force, carries, islands, gates and gap repair.

Each takes a DataFrame with a partition key and an order; rows of one key are one song, chart or series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_in_force(bars: DataFrame, changes: DataFrame, start: Column, key: str = "chart", order: str = "bar") -> DataFrame:
    """bars (key, order) with semitones and tonic: the start plus all changes (key, at_bar, semitones) up to the bar, modulo 12."""
    by_bar = changes.groupBy(F.col(key), F.col("at_bar").alias(order)).agg(F.sum("semitones").alias("semitones"))
    rows = bars.join(by_bar, [key, order], "left").withColumn("semitones", F.coalesce("semitones", F.lit(0)))
    total = F.sum("semitones").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("tonic", F.pmod(start + total, F.lit(12)))


def carried(rows: DataFrame, value: str, key: list[str], order: list[str], default=None, within: Column | None = None) -> DataFrame:
    """`value` filled with the last one before it; `within` limits the carry to rows of the same value of that column."""
    w = Window.partitionBy(*key, *([within] if within is not None else [])).orderBy(*order)
    return rows.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def by_parts(rows: DataFrame, key: list[str], order: list[str], part: Column, kind: str, value: Column, name: str, own: bool = True) -> DataFrame:
    """`rows` with `name`: the last (of those that are not null), the largest or the sum of `value` over a key's rows up to each row, itself included if `own`.

    `part` cuts the order of a key into stretches and never falls along it. Stretches are worked on apart, each a window of its own; what came before a stretch is carried over from one row for each, so a
    key with a great many rows is spread over tasks."""
    before = (Window.unboundedPreceding, 0 if own else -1)
    within = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(*before)
    across = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_part", part).withColumn("_value", value)
    at = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = rows.groupBy(*key, "_part").agg({"last": F.max_by("_value", at), "max": F.max("_value"), "sum": F.sum("_value")}[kind].alias("_end"))
    carry = {"last": F.last("_end", ignorenulls=True), "max": F.max("_end"), "sum": F.sum("_end")}[kind].over(across)
    ends = ends.withColumn("_carry", carry).drop("_end")
    here = {"last": F.last("_value", ignorenulls=True), "max": F.max("_value"), "sum": F.sum("_value")}[kind].over(within)
    found = rows.withColumn("_here", here).join(ends, [*key, "_part"])
    if kind == "sum":
        total = F.coalesce("_here", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        total = F.coalesce("_here", "_carry") if kind == "last" else F.greatest("_here", "_carry")
    return found.withColumn(name, total).drop("_part", "_value", "_here", "_carry")


def islands(rows: DataFrame, label: str, key: list[str], order: str) -> DataFrame:
    """Runs of equal labels: key, island (from 1), label, first, last, n."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(*key, "island").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def gap_clusters(rows: DataFrame, key: list[str], at: str, most: int, tie: str, part: Column) -> DataFrame:
    """Clusters of values that lie at most `most` after the one before: key, cluster (from 1), first, last, n. `part` cuts a key's order into stretches (see by_parts)."""
    rows = by_parts(rows, key, [at, tie], part, "max", F.col(at), "_before", own=False)
    new = F.when(F.col(at) - F.col("_before") <= most, 0).otherwise(1)
    marked = by_parts(rows, key, [at, tie], part, "sum", new, "cluster")
    return marked.groupBy(*key, "cluster").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def hysteresis(rows: DataFrame, key: list[str], order: list[str], on: Column, off: Column, part: Column, name: str = "open") -> DataFrame:
    """A gate that opens where `on` holds, closes where `off` holds and otherwise stays; closed at first. `part` cuts a key's order into stretches (see by_parts)."""
    found = by_parts(rows, key, order, part, "last", F.when(on, True).when(off, False), name)
    return found.withColumn(name, F.coalesce(name, F.lit(False)))


def bridged(rows: DataFrame, key: list[str], order: str, value: str, longest: int, jump: float, edge: int = 0) -> DataFrame:
    """Gaps (nulls) of at most `longest` rows between values at most `jump` apart, filled by straight lines.

    `order` numbers the rows of a key without holes; gaps that reach into the last `edge` rows stay."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    found = rows.withColumn("_a", F.last(here, ignorenulls=True).over(before)).withColumn("_b", F.first(here, ignorenulls=True).over(after))
    found = found.withColumn("_end", F.max(order).over(Window.partitionBy(*key)))
    a, b, i = F.col("_a"), F.col("_b"), F.col(order)
    fits = (b["i"] - a["i"] - 1 <= longest) & (F.abs(b["v"] - a["v"]) <= jump) & (b["i"] <= F.col("_end") - edge)
    line = a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / (b["i"] - a["i"])
    return found.withColumn(value, F.coalesce(value, F.when(fits, line))).drop("_a", "_b", "_end")


def numbered_sections(runs: DataFrame, key: list[str], role: str, order: str, letters: dict[str, str], plain: tuple[str, ...] = ("intro", "outro")) -> DataFrame:
    """Runs with section_id: the role's letter, or its name, and its count so far; the first of a `plain` role has no number."""
    n = F.row_number().over(Window.partitionBy(*key, role).orderBy(order))
    pairs = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    letter = F.try_element_at(pairs, F.col(role))
    name = F.when(letter.isNotNull(), F.concat(letter, n.cast("string"))).when((n == 1) & F.col(role).isin(*plain), F.col(role)).otherwise(F.concat(F.col(role), n.cast("string")))
    return runs.withColumn("section_id", name)


def monotonic(rows: DataFrame, key: list[str], order: list[str], at: str, part: Column) -> DataFrame:
    """Rows that do not fall behind an earlier row; those kept are the running maxima. `part` cuts a key's order into stretches (see by_parts)."""
    return by_parts(rows, key, order, part, "max", F.col(at), "_top", own=False).where(F.col("_top").isNull() | (F.col(at) >= F.col("_top"))).drop("_top")


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def centred_median(rows: DataFrame, key: list[str], order: list[str], value: str, reach: int, name: str) -> DataFrame:
    """Median over `reach` rows to either side; at the ends the rows are mirrored about the end row, which stands once. Keys with fewer rows than the window get the median of all of them."""
    w = Window.partitionBy(*key).orderBy(*order)
    found = rows.withColumn("_v", F.collect_list(value).over(w.rowsBetween(-reach, reach)))
    found = found.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    low, i, n = F.greatest(F.col("_i") - reach, F.lit(0)), F.col("_i"), F.col("_n")
    mirror = lambda j: F.when(j < 0, -j).when(j >= n, 2 * n - 2 - j).otherwise(j)
    at = lambda j: F.get("_v", F.greatest(F.lit(0), F.least(mirror(j) - low, F.size("_v") - 1)).cast("int"))
    window = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: at(i + d))
    whole = F.median(value).over(Window.partitionBy(*key))
    return found.withColumn("_m", whole).withColumn(name, F.when(n > 2 * reach, F.array_sort(window)[reach].cast("double")).otherwise(F.col("_m"))).drop("_v", "_i", "_n", "_m")


def tiled(rows: DataFrame, key: list[str], at: str, length: str, total: float) -> DataFrame:
    """Events of a bar clipped at its end and at the next onset, with rests (is_rest) in the gaps: key, onset, duration, is_rest."""
    w = Window.partitionBy(*key).orderBy(at)
    end = F.least(F.col(at) + F.col(length), F.coalesce(F.lead(at).over(w), F.lit(total)), F.lit(total))
    cut = rows.where(F.col(at) < total).groupBy(*key, at).agg(F.max(length).alias(length)).withColumn("_end", end)
    cut = cut.withColumn("_from", F.coalesce(F.lag("_end").over(w), F.lit(0.0))).withColumn("_last", F.lead(at).over(w).isNull())
    piece = lambda a, b, rest: F.struct(a.alias("onset"), (b - a).alias("duration"), F.lit(rest).alias("is_rest"))
    parts = F.array(
        piece(F.col("_from"), F.col(at), True), piece(F.col(at), F.col("_end"), False), piece(F.when(F.col("_last"), F.col("_end")).otherwise(F.lit(total)), F.lit(total), True)
    )
    return cut.select(*key, F.explode(F.filter(parts, lambda x: x["duration"] > 1e-9)).alias("x")).select(*key, "x.*")
