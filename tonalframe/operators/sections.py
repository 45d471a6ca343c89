"""Sections of songs mended by what is sung in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Roles without words.
PLAYED = ("intro", "interlude", "outro")


def sung_apart(sections: DataFrame, measures: DataFrame, least: int = 2) -> DataFrame:
    """song, first, last, role, energy: sections that are only played, cut where a run of `least` or more measures with words begins.

    The cut goes to the start of that measure's row of the page, within the section; what follows takes role and energy of the next section that is sung, verse and 1
    if there is none. In songs with a cut, neighbours of the same role and energy then become one. `sections` has song, first, last (measures, both included), role, energy;
    `measures` song, measure, sung (boolean), row_start."""
    w = Window.partitionBy("song").orderBy("first")
    sung = ~F.col("role").isin(*PLAYED)
    later = F.first(F.when(sung, F.struct("role", "energy")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = sections.select("song", "first", "last", "role", "energy").withColumn("next", later)

    played = rows.where(~sung).select("song", "first", "last", F.explode(F.sequence("first", "last")).alias("measure"))
    words = played.join(measures.where("sung").select("song", "measure", "row_start"), ["song", "measure"])
    island = F.col("measure") - F.row_number().over(Window.partitionBy("song", "first").orderBy("measure"))
    runs = words.withColumn("island", island).groupBy("song", "first", "island").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("measure", "row_start")).alias("head")).where(F.col("n") >= least)
    cuts = runs.groupBy("song", "first").agg(F.min("head").alias("head")).select("song", "first", F.greatest("first", "head.row_start").alias("cut"))

    own = lambda a, b, role, energy: F.struct(a.alias("first"), b.alias("last"), role.alias("role"), energy.alias("energy"))
    c, whole = F.col, own(F.col("first"), F.col("last"), F.col("role"), F.col("energy"))
    role, energy = F.coalesce(c("next.role"), F.lit("verse")), F.coalesce(c("next.energy"), F.lit(1))
    parts = (
        F.when(c("cut").isNull(), F.array(whole))
        .when(c("cut") > c("first"), F.array(own(c("first"), c("cut") - 1, c("role"), c("energy")), own(c("cut"), c("last"), role, energy)))
        .otherwise(F.array(own(c("first"), c("last"), role, energy)))
    )
    rows = rows.join(cuts, ["song", "first"], "left").withColumn("split", F.max(c("cut").isNotNull()).over(Window.partitionBy("song")))
    rows = rows.select("song", "split", F.explode(parts).alias("s")).select("song", "split", "s.*")
    same = (c("role") == F.lag("role").over(w)) & (c("energy") == F.lag("energy").over(w)) & (c("first") == F.lag("last").over(w) + 1) & c("split")
    rows = rows.withColumn("n", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy("song", "n", "role", "energy").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("n")
