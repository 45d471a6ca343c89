"""Majority votes over competing readings, with the first-seen value winning ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(rows: DataFrame, place: list[str], seen: str, value: str, vote_key: str, sources: DataFrame | None = None, source_key: list[str] | None = None) -> DataFrame:
    """The winning value at each place: place, winner, support, n_keys, alternatives.

    Values with equal `vote_key` vote together; the class with most votes wins, in it the most frequent spelling, and
    what was `seen` first wins ties. Both steps combine before their shuffle, so a crowded place stays small.
    """
    spelled = rows.groupBy(*place, vote_key, value).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first"))
    by_key = spelled.groupBy(*place, vote_key).agg(
        F.sum("n").alias("votes"), F.min("first").alias("first"), F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias("spelling")
    )
    ranked = by_key.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("k"), "first", "spelling"))).alias("r"))
    others = F.transform(F.slice("r", 2, F.size("r")), lambda x: x["spelling"])
    winner = F.col("r")[0]["spelling"]
    return ranked.select(
        *place, winner.alias("winner"), (-F.col("r")[0]["k"]).alias("support"), F.size("r").alias("n_keys"),
        F.array_distinct(F.filter(others, lambda x: x != winner)).alias("alternatives"),
    )


def agreement(votes: DataFrame, total: str = "total", least: int = 2, share: float = 0.5) -> DataFrame:
    """votes with agreement: agree where enough sources, and enough of them, support the winner."""
    ok = (F.col("support") >= least) & (F.col("support") / F.col(total) >= share)
    return votes.withColumn("agreement", F.when(ok, "agree").otherwise("search_only"))


def reference_source(charts: DataFrame, song: str, source: str, bars: str, chords: str) -> DataFrame:
    """The source of each song nearest the median number of bars, the most complete of equals: song, source, score."""
    middle = charts.groupBy(song).agg(F.median(bars).alias("middle"))
    score = -F.abs(F.col(bars) - F.col("middle")) * 100.0 + F.col(bars) + 0.05 * F.col(chords)
    scored = charts.join(middle, song).withColumn("score", F.bround(score, 4))
    best = scored.groupBy(song).agg(F.max_by(F.struct(source, "score"), F.struct(F.col("score"), -F.col(source))).alias("b"))
    return best.select(song, f"b.{source}", "b.score")
