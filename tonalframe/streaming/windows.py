"""Windowed aggregation of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonalframe.sources.scratch import new_path


def tumbling(stream: DataFrame, at: str, key: str, width: str) -> DataFrame:
    """Counts and sums of tumbling windows; `at` is cast to a timestamp with time zone, which streams need for their windows."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp"))
    found = rows.groupBy(F.window("_at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return found.select(F.unix_seconds("w.start").alias("start"), key, "n", "top")


def drained(spark: SparkSession, path: str, schema: T.StructType, query) -> DataFrame:
    """The result table of `query` over all files of `path` there are now, run as a stream to its end."""
    out = new_path(spark, "stream-out")
    stream = spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(path)
    sink = query(stream).writeStream.outputMode("complete").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True)
    result = query(spark.createDataFrame([], schema)).schema
    sink.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(result).parquet(out)
