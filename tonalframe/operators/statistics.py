"""Statistics of pitch and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Key profiles by semitone above the tonic, and the weight of chord tones.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
TONES = [(0, 1.5), (4, 1.0), (7, 1.0), (10, 0.5)]


def pitch_histogram(notes: DataFrame) -> DataFrame:
    """series, pc, weight of notes (series, midi, len in microseconds); chord tones above each note count with their weight."""
    tones = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in TONES])).alias("t")
    rows = notes.groupBy("series", "midi").agg(F.sum("len").alias("len")).select("series", "midi", "len", tones)
    pc, weight = F.pmod(F.col("midi") + F.col("t.d"), F.lit(12)).cast("int"), F.col("len") / 1_000_000 * F.col("t.w")
    return rows.select("series", pc.alias("pc"), weight.alias("weight")).groupBy("series", "pc").agg(F.sum("weight").alias("weight"))


def best_key(histogram: DataFrame) -> DataFrame:
    """series, tonic, minor (0 or 1), r: Pearson's correlation with 24 rotated profiles, the first of equals; a flat histogram gives tonic 0."""
    bins = histogram.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("pc", "weight"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    bins = bins.select("series", vector.alias("v"))

    def correlation(tonic: int, profile: list[float]):
        rotated = [profile[(i - tonic) % 12] for i in range(12)]
        mean = sum(profile) / 12
        spread = sum((x - mean) ** 2 for x in profile) ** 0.5
        product = sum((F.col("v")[i] * F.lit(rotated[i] - mean) for i in range(1, 12)), F.col("v")[0] * F.lit(rotated[0] - mean))
        return F.coalesce(F.try_divide(product, F.col("spread") * F.lit(spread)), F.lit(-1.0))

    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 12
    bins = bins.withColumn("_mean", total)
    bins = bins.withColumn("spread", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))))
    keys = [
        F.struct(F.bround(correlation(t, p), 9).alias("k"), F.lit(-(2 * t + m)).alias("o"), F.lit(t).alias("tonic"), F.lit(m).alias("minor"), correlation(t, p).alias("r"))
        for t in range(12) for m, p in enumerate((MAJOR, MINOR))
    ]
    return bins.select("series", F.array_max(F.array(*keys)).alias("b")).select("series", "b.tonic", "b.minor", "b.r")
