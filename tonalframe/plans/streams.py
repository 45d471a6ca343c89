"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonalframe.plans.registry import query
from tonalframe.sources.tables import table
from tonalframe.streaming.windows import drained, tumbling


@query("SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of six hours, run as a stream over the event files."""
    schema = table(spark, sf_dir, "events").schema
    # A pattern, for a table that is one file as well as for a folder.
    path = f"{sf_dir.rstrip('/')}/events.parque[t]"
    return drained(spark, path, schema, lambda s: tumbling(s, "ts", "event_type", "6 hours"))
