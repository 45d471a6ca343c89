"""Queries of histories, caches and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.functions import texts as X
from tonalframe.operators import catalog as C
from tonalframe.operators import windows as W
from tonalframe.plans.registry import query
from tonalframe.sources.tables import table

HISTORY = "SELECT o_orderkey AS id, o_custkey AS owner, lpad(CAST(10000000000000 - epoch_ms(o_orderdate) AS VARCHAR), 13, '0') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderstatus = 'P' AS deleted, o_totalprice AS price FROM orders"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    key = F.concat(C.newest_key(millis), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), key.alias("key"), (F.col("o_orderstatus") == "P").alias("deleted"), F.col("o_totalprice").alias("price")
    )


@query(f"SELECT id, key, deleted FROM ({HISTORY})")
def history_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that sort newest first."""
    return history(spark, sf_dir).select("id", "key", "deleted")


@query(f"""
WITH h AS ({HISTORY}), p AS (SELECT id, key FROM h WHERE NOT deleted AND key > '0842' ORDER BY key LIMIT 50)
SELECT id, key, CASE WHEN (SELECT max(key) FROM h) > (SELECT max(key) FROM p) THEN (SELECT max(key) FROM p) END AS next_cursor FROM p""")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of visible entries after a cursor."""
    return C.page_after(history(spark, sf_dir).select("id", "key", "deleted"), "key", "0842", 50, ~F.col("deleted")).select("id", "key", "next_cursor")


@query(f"SELECT owner, id, price, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY price DESC, id) AS rank FROM ({HISTORY})) WHERE rank <= 3")
def topk_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each group."""
    return C.top(history(spark, sf_dir), ["owner"], [F.desc("price"), "id"], 3).select("owner", "id", "price", "rank")


@query(f"""
SELECT owner, id FROM (SELECT *, row_number() OVER (PARTITION BY owner % 100 ORDER BY key) AS o FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY key) AS i FROM ({HISTORY})) WHERE i <= 2) WHERE o <= 8""")
def quota_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of each owner and eight of each hundred owners at most."""
    rows = history(spark, sf_dir).withColumn("part", F.col("owner") % 100)
    return C.quotas(rows, ["owner"], ["part"], ["key"], 2, 8).select("owner", "id")


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) % 7 AS shard FROM orders")
def manifest_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by place in the order of identifiers as text."""
    return C.shard(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 7)


@query(f"""
SELECT owner, count(*) AS n, count(*) FILTER (NOT deleted) AS visible, min(key) FILTER (NOT deleted) AS newest FROM ({HISTORY}) GROUP BY owner""")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each owner and the newest that is not deleted (O3, H1)."""
    rows = history(spark, sf_dir).groupBy("owner")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("deleted")).alias("visible"), F.min(F.when(~F.col("deleted"), F.col("key"))).alias("newest"))


@query("""
SELECT count(*) AS scanned, count(*) FILTER (o_custkey IS NULL) AS created, count(*) FILTER (o_custkey IS NOT NULL) AS present FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey""")
def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of the backfill: entries there and entries missing."""
    have = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("have", F.lit(True))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(have, "c_custkey", "left")
    return rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("have").isNull()).alias("created"), F.count_if("have").alias("present"))


@query("SELECT c_custkey AS id, 'Customer ' || (c_custkey % 9) AS title FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def backfill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the backfill appends."""
    have = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    rows = table(spark, sf_dir, "customer").join(have, "c_custkey", "left_anti")
    return rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Customer "), F.col("c_custkey") % 9).alias("title"))


@query("SELECT chart, sha256(string_agg(bar || ':' || p, '|' ORDER BY bar)) AS cache_key FROM (SELECT l_orderkey AS chart, l_linenumber AS bar, min(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY chart")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys from the digest of a compact table."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chart"), F.col("l_linenumber").alias("bar")).agg(F.min("l_partkey").alias("p"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("bar", "p"))), lambda x: F.concat(x["bar"].cast("string"), F.lit(":"), x["p"].cast("string")))
    return rows.groupBy("chart").agg(F.sha2(F.array_join(cells, "|"), 256).alias("cache_key"))


DOMAIN = """
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages"""
REGISTERED = "CASE WHEN len(parts) <= 2 THEN host WHEN parts[-2] IN ('com', 'co', 'org', 'net', 'gov', 'edu') THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END"


@query(f"SELECT page_id, host, {REGISTERED} AS domain FROM (SELECT *, string_split(host, '.') AS parts FROM ({DOMAIN}))")
def registered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered domain of each URL."""
    host = X.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), X.registered_domain(host).alias("domain"))


@query(f"SELECT domain, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, {REGISTERED} AS domain FROM (SELECT *, string_split(host, '.') AS parts FROM ({DOMAIN}))) GROUP BY domain")
def domain_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each domain."""
    rows = table(spark, sf_dir, "pages").select("page_id", X.registered_domain(X.host(F.col("url"))).alias("domain"))
    return rows.groupBy("domain").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, regexp_matches(url, '^https?://') AND host LIKE '%.%' AND NOT (host = 'example.com' OR host LIKE '%.example.com') AS valid FROM ({DOMAIN})")
def url_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, dotted host, and no forbidden host or suffix."""
    return table(spark, sf_dir, "pages").select("page_id", X.url_ok(F.col("url"), ["example.com"]).alias("valid"))


@query("SELECT page_id, regexp_extract(u, '^gs://([^/]+)/', 1) AS bucket, regexp_extract(u, '^gs://[^/]+/(.*)$', 1) AS path FROM (SELECT page_id, 'gs://charts-' || (page_id % 4) || '/' || regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)")
def object_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and path of object URIs."""
    uri = F.concat(F.lit("gs://charts-"), (F.col("page_id") % 4).cast("string"), F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(uri, "^gs://([^/]+)/", 1).alias("bucket"), F.regexp_extract(uri, "^gs://[^/]+/(.*)$", 1).alias("path"))


@query("SELECT p_partkey AS id, CASE WHEN len(q) >= 3 THEN q[1] END AS instrument, q[-1] AS difficulty, array_to_string(q[2:-2], '_') AS style FROM (SELECT p_partkey, string_split(lower(replace(p_type, ' ', '_')), '_') AS q FROM part)")
def render_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata read out of folder names."""
    q = F.split(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), "_")
    middle = F.when(F.size("q") > 2, F.slice("q", 2, F.size("q") - 2)).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q.alias("q"))
    return rows.select("id", F.when(F.size("q") >= 3, F.col("q")[0]).alias("instrument"), F.element_at("q", -1).alias("difficulty"), F.array_join(middle, "_").alias("style"))


@query(f"SELECT id, owner FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY key, id) AS k FROM ({HISTORY})) WHERE k = 1")
def latest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each owner (O3)."""
    return W.first_of(history(spark, sf_dir), ["owner"], ["key", "id"]).select("id", "owner")
