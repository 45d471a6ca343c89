"""Exact deduplication by a keyed stream state on disk [native].

Arrivals (identifier, digest, locator) stream through a stateful aggregation whose state lives in RocksDB,
has no watermark and so never expires. For each digest the state retains the stable identifier that stays,
the locator of its content (file and row) and the number of rows. On hits, digests that came more than once, full bytes decide: the
least and the greatest text of each are compared, and digests that stand for several texts are grouped anew by text. A bitmap of fixed
size keeps texts that hit nothing out of that shuffle; if hits fill it, more texts come along, never fewer.

With `state_dir` the state and the arrivals, with their texts, stay there: each call streams its rows into the same state, so later rows
meet all earlier ones, also after a restart; a call that repeats a batch name counts nothing twice. Without it a call has a state of its own.

Defined results: null text counts as empty; equal means identical after lower-casing A-Z; of equal texts the
largest identifier stays (null is smallest); rows that repeat identifier and text all count in group_size and all
carry kept = true (`drop_copies` keeps one of them); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.llm.common import ascii_lower, free_name
from tonalframe.sources.scratch import new_path, write_table, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state's store, and no space set aside in advance for each of many small stores.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful operator: a row for each digest, of a stream with columns id, digest and locator."""
    held = F.max(F.struct("id", "locator")).alias("held")
    return stream.groupBy("digest").agg(held, F.count(F.lit(1)).alias("group_size"))


def run_state(spark: SparkSession, arrivals_path: str, schema, where: str | None = None) -> DataFrame:
    """Streams what is new in `arrivals_path` through the state at `where` and reads the state: digest, keep_id, locator, group_size."""
    where = where or new_path(spark, "dedup-state")
    own = spark.newSession()  # the store's settings hold for this stream only
    for k, v in (STORE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    stream = own.readStream.schema(schema).option("maxFileAge", "36500d").parquet(arrivals_path).select("id", "digest", "locator")
    sink = keyed_state(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", where)
    sink.trigger(availableNow=True).start().awaitTermination()
    state = spark.read.format("statestore").load(where)
    held, size = state.schema["value"].dataType.names
    held = F.col("value")[held]
    return state.select(
        F.col("key")["digest"].alias("digest"),
        held["id"].alias("keep_id"),
        held["locator"].alias("locator"),
        F.col("value")[size].alias("group_size"),
    )


def located(docs: DataFrame) -> Column:
    """File and row of each row, where `docs` comes from files."""
    if "_metadata#" not in docs._jdf.queryExecution().analyzed().metadataOutput().mkString(","):  # not a scan of files
        return F.input_file_name()
    return F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")


def in_bitmap(rows: DataFrame, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """`rows` without those whose digest is surely not among `keys`; the bitmap takes bits / 8 bytes, whatever the number of keys."""
    at = F.pmod(F.xxhash64("digest"), F.lit(bits))
    maps = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(at) == F.col("bucket"))
    return met.where(F.call_function("getbit", byte, (place % 8).cast("int")) == 1).select(rows.columns)


def _has_batch(spark: SparkSession, path: str, name: str) -> bool:
    """Whether rows of this batch were committed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={name}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, state_dir: str | None = None, batch: str | None = None) -> DataFrame:
    """A row for each row of `docs`: id, keep_id, group_size, kept, text_sha256 and the kept row's locator.

    `digest` maps the normalised text to the state's key; it need not be free of collisions.
    `batch` names this call's rows in `state_dir`: a name that is there already, as after a retry, is not counted again.
    """
    spark = docs.sparkSession
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), located(docs).alias("locator"))
    keyed = rows.withColumn("digest", digest(F.col("text")))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("text"))
    came = keyed.select("id", "digest", "locator", sha.alias("sha"), *(["text"] if state_dir else []))
    if state_dir:
        path = f"{state_dir.rstrip('/')}/arrivals"
        name = batch or uuid.uuid4().hex
        named = came.withColumn("batch", F.lit(name))
        if not _has_batch(spark, path, name):
            named.write.mode("append").partitionBy("batch").parquet(path)
        held = spark.read.schema(named.schema).parquet(path)
        arrivals = held.where(F.col("batch") == name)
    else:
        path = write_table(came, "dedup-arrivals")
        held = arrivals = spark.read.schema(came.schema).parquet(path)
    if held.isEmpty():  # a stream without a batch leaves no state to read
        state = held.select("digest", F.col("id").alias("keep_id"), "locator", F.lit(0).cast("long").alias("group_size"))
    else:
        state = run_state(spark, path, named.schema if state_dir else came.schema, f"{state_dir.rstrip('/')}/state" if state_dir else None)
    state = written(state, "dedup-held")
    found = arrivals.select("id", "digest", "sha").join(state, "digest")
    # Full bytes on hits, combined before the shuffle: a large group sends a row for each task.
    hits = in_bitmap(held if state_dir else keyed, state.where("group_size > 1"))
    spans = hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"), F.count(F.lit(1)).alias("n"))
    mixed = written(spans.where("n > 1 and least != most").select("digest"), "dedup-mixed")
    if not mixed.isEmpty():
        texts = (held if state_dir else keyed).select("id", "digest", "text", "locator")
        apart = texts.join(mixed, "digest", "left_semi")
        again = apart.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("held"), F.count(F.lit(1)).alias("group_size"))
        again = again.select("digest", "text", F.col("held.id").alias("keep_id"), F.col("held.locator").alias("locator"), "group_size")
        mine = (arrivals if state_dir else keyed).select("id", "digest", "text").join(mixed, "digest", "left_semi")
        anew = mine.join(again, ["digest", "text"]).select("digest", "id", sha256(F.col("text")).alias("sha"), "keep_id", "locator", "group_size")
        found = found.join(mixed, "digest", "left_anti").select(anew.columns).unionByName(anew)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "locator",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept."""
    found = exact_dedup(docs, id_col, text_col).where("kept")
    name = free_name(docs, "_copy_key")
    key = lambda i, sha: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), sha)
    stay = found.select(key(F.col(id_col), F.col("text_sha256")).alias(name))
    mine = docs.withColumn(name, key(F.col(id_col), F.sha2(normalised(text_col), 256)))
    return mine.join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
