"""History listings, pagination, quotas, caches and shards over tables of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Newest first as text: 10^13 less the time in milliseconds, 13 digits.
TOP = 10_000_000_000_000


def newest_key(millis: Column) -> Column:
    return F.lpad((F.lit(TOP) - millis).cast("string"), 13, "0")


def page_after(rows: DataFrame, key: str, cursor: str | None, size: int, visible: Column) -> DataFrame:
    """Keyset pagination: the next `size` visible rows in key order, each with next_cursor, which is null once no keys at all remain."""
    rest = rows.where(F.col(key) > cursor) if cursor else rows
    shown = rest.where(visible).orderBy(key).limit(size)
    last = shown.agg(F.max(key).alias("last"))
    # At most one row decides whether keys remain, hidden ones included.
    more = rest.agg(F.max(key).alias("top")).crossJoin(F.broadcast(last)).select(F.when(F.col("top") > F.col("last"), F.col("last")).alias("next_cursor"))
    return shown.join(F.broadcast(more), how="left")


def top(rows: DataFrame, key: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def quotas(rows: DataFrame, inner: list[str], outer: list[str], order: list, inner_n: int, outer_n: int) -> DataFrame:
    """At most inner_n rows of each inner group, and of those outer_n of each outer group."""
    return top(top(rows, inner, order, inner_n, "_i"), outer, order, outer_n, "_o").drop("_i", "_o")


def shard(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows with their shard: place in the order of `key` as text, modulo n. Places come from counts of ranges, not from one sorted task."""
    ranged = rows.withColumn("_k", F.col(key).cast("string")).withColumn("_r", F.substring("_k", 1, 3))
    before = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))
    before = before.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_k")) - 1 + F.col("_b")
    return ranged.join(F.broadcast(before.select("_r", "_b")), "_r").withColumn("shard", F.pmod(place, F.lit(n))).drop("_k", "_r", "_b")
