"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that setting is missing and all tasks run on this machine."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/tonalframe/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> str:
    """Writes `df` as a Parquet table in the shared folder and returns its path."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read again. This cuts the lineage: tasks lost with an
    executor read the table instead of computing it anew."""
    path = write_table(df, name, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    if not path.startswith(f"{shared_dir(spark)}/tonalframe/"):
        raise ValueError(f"{path} is not a table of the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
