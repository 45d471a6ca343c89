"""Validators: each rule gives rows of issues (key, code), and a repair replaces what fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issues(events: DataFrame, key: list[str], beats: float, low: int, high: int, span: int) -> DataFrame:
    """Issues of bars of events (key, onset, duration, midi), one row for each bar and rule that it breaks."""
    by_bar = events.groupBy(*key).agg(
        F.bround(F.sum("duration"), 4).alias("total"), F.min("midi").alias("low"), F.max("midi").alias("high"),
        F.count_if(F.abs(F.col("onset") * 4 - F.rint(F.col("onset") * 4)) > 1e-6).alias("off_grid"), F.count(F.lit(1)).alias("n"),
    )
    rules = [
        ("tiling_mismatch", F.col("total") != beats), ("grid_alignment", F.col("off_grid") > 0), ("pitch_out_of_range", (F.col("low") < low) | (F.col("high") > high)),
        ("span_too_large", F.col("high") - F.col("low") > span), ("attacks_too_dense", F.col("n") > beats * 4),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    return by_bar.select(*key, F.explode(codes).alias("code"))


def repaired(rows: DataFrame, bad: DataFrame, fallback: DataFrame, key: list[str]) -> DataFrame:
    """Rows of good keys, and the fallback's rows for the bad ones."""
    failing = bad.select(*key).distinct()
    return rows.join(failing, key, "left_anti").unionByName(fallback.join(failing, key, "left_semi"))


def gate(issue_rows: DataFrame, key: str, confidence: str, confirmed: str, total: str) -> DataFrame:
    """Whether a chart is blocked: low confidence with structural issues or without confirmation, or too many issues to review besides structural ones."""
    structural = F.col("code").rlike("^(barline_|structural_)|measure_count")
    rows = issue_rows.groupBy(key, confidence, confirmed, total).agg(F.count_if(structural).alias("structural"), F.count_if(F.col("severity") == "needs_review").alias("review"))
    low = (F.col(confidence) < 0.6) & ((F.col("structural") > 0) | ~F.col(confirmed))
    many = (F.col("review") / F.col(total) > 0.25) & (F.col("structural") > 0)
    return rows.select(key, "structural", "review", (low | many).alias("blocked"))
