"""The versioned model, derived from plain event, document, order and part tables.

Each view is a function of (spark, sf_dir); ``SQL`` holds the same definitions for DuckDB.
History is stored as validity intervals: a record holds from its event to the next event of its key.
A snapshot's records are the intervals that cover it, found by day, without a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..steps import small

CHUNK = 4096
SMALL = 4096
LARGE = 8192
PACK_TARGET = 65536
RECORD_HEAD = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    return table(spark, d, "events").select(
        "event_id",
        F.col("ts").alias("observed_at"),
        F.concat(F.lit("r"), F.col("user_id") % 4).alias("root_id"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit("/p"), F.col("event_id") % 7).alias("path"),
        kind.alias("kind"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("oid"),
        (F.col("event_id") % 300000).alias("size"),
        (F.col("event_id") % 8).alias("mode"),
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One a day; few rows, so the lag over all of them is a small sort."""
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    stamp = F.date_format("day", "yyyyMMdd")
    day = days.select("day", F.concat(F.lit("snap-"), stamp).alias("id"), F.concat(F.lit("op-"), stamp).alias("op_id"), F.date_add("day", 1).cast("timestamp_ntz").alias("created_at"))
    order = Window.orderBy("created_at")
    return day.select("*", F.lag("id").over(order).alias("parent_id"), F.row_number().over(order).alias("seq"))


def versions(events: DataFrame) -> DataFrame:
    """Every event with ``until``, the time of the next event of its key (null for the last)."""
    key = Window.partitionBy("root_id", "path").orderBy("observed_at", "event_id")
    return events.withColumn("until", F.lead("observed_at").over(key))


def file_records(spark: SparkSession, d: str) -> DataFrame:
    """snapshot_id and the records that it holds."""
    snaps = snapshots(spark, d)
    last = snaps.agg(F.max("day")).scalar()
    live = versions(journal(spark, d)).where("NOT tombstone")
    live = live.withColumn("to", F.coalesce(F.date_sub(F.to_date("until"), 1), last)).where(F.to_date("observed_at") <= F.col("to"))
    each = live.withColumn("day", F.explode(F.sequence(F.to_date("observed_at"), "to")))
    return each.join(small(snaps.select("day", F.col("id").alias("snapshot_id"))), "day").select("snapshot_id", "root_id", "path", "oid", "size", "mode", "event_id", F.unix_timestamp(F.col("observed_at").cast("timestamp")).alias("modified"))


def snapshot_records(spark: SparkSession, d: str, created_at) -> DataFrame:
    """The records of the one snapshot made at ``created_at``: the intervals that cover it, none laid over days."""
    t = F.lit(created_at)
    live = versions(journal(spark, d).where(F.col("observed_at") < t)).where("until IS NULL AND NOT tombstone")
    return live.select("root_id", "path", "oid", "size", "mode", "event_id", F.unix_timestamp(F.col("observed_at").cast("timestamp")).alias("modified"))


def operations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("parent_id").isNull(), "initial-scan").otherwise("file-events-batch")
    return snapshots(spark, d).select(F.col("op_id").alias("id"), "seq", kind.alias("kind"), F.col("parent_id").alias("before_snapshot"), F.col("id").alias("after_snapshot"), "created_at")


def refs(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    latest, fifth = s.agg(F.max_by("id", "seq").alias("value")), s.where("seq = 5").select(F.col("id").alias("value"))
    return latest.select(F.explode(F.array(F.lit("current"), F.lit("branches/main"))).alias("name"), "value").unionByName(fifth.select(F.lit("branches/old").alias("name"), "value"))


def blobs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("oid"), F.col("n_chars").alias("size"))
    return docs.dropDuplicates(["oid"]).select("oid", "size", F.concat(F.lit("objects/"), F.substring("oid", 1, 2), F.lit("/"), "oid").alias("object_key"), F.when(F.col("size") <= SMALL, "small").otherwise("normal").alias("tier"))


def large_objects(spark: SparkSession, d: str) -> DataFrame:
    return blobs(spark, d).where(F.col("size") > LARGE).select("oid", "size", F.ceil(F.col("size") / CHUNK).cast("bigint").alias("chunk_count"), F.concat(F.lit("large/manifests/"), "oid").alias("manifest_key"))


def large_chunks(spark: SparkSession, d: str) -> DataFrame:
    """large_oid, idx, start, len, chunk_oid of fixed ranges."""
    docs = table(spark, d, "documents").where(F.col("n_chars") > LARGE).select(F.sha2("text", 256).alias("large_oid"), "text", "n_chars").dropDuplicates(["large_oid"])
    each = docs.select("large_oid", "text", "n_chars", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chars") - 1, F.lit(CHUNK).cast("bigint"))).alias("idx", "start"))
    piece = F.substring(F.col("text"), F.col("start").cast("int") + 1, F.lit(CHUNK))
    return each.select("large_oid", F.col("idx").cast("bigint").alias("idx"), "start", F.least(F.lit(CHUNK).cast("bigint"), F.col("n_chars") - F.col("start")).alias("len"), F.sha2(piece, 256).alias("chunk_oid"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return large_chunks(spark, d).groupBy(F.col("chunk_oid").alias("oid")).agg(F.min("len").alias("size")).select("oid", "size", F.concat(F.lit("large/chunks/"), "oid").alias("object_key"))


def remote_objects(spark: SparkSession, d: str) -> DataFrame:
    """Most keys of blobs, chunks and manifests (those with a digest that begins with a are missing), and orphans."""
    b = blobs(spark, d).where("NOT startswith(oid, 'a')").select(F.col("object_key").alias("key"), "size")
    c = chunks(spark, d).where("NOT startswith(oid, 'a')").select(F.col("object_key").alias("key"), "size")
    m = large_objects(spark, d).where("NOT startswith(oid, 'a')").select(F.col("manifest_key").alias("key"), (F.col("chunk_count") * 100).alias("size"))
    p = table(spark, d, "part").select(F.concat(F.lit("objects/orphan/"), "p_partkey").alias("key"), F.col("p_size").cast("bigint").alias("size"))
    return b.unionByName(c).unionByName(m).unionByName(p)


def upload_queue(spark: SparkSession, d: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("objects", "metadata", "refs", "large/manifests"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(folder, F.lit("/"), "o_orderkey").alias("key"), (F.col("o_orderkey") % 5).alias("attempts"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("weight")
    )


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("host"), F.col("r_name").alias("area"))


#: The same views for DuckDB; a query puts ``WITH {SQL}`` in front.
SQL = f"""
journal AS (
  SELECT event_id, ts AS observed_at, 'r' || (user_id % 4) AS root_id, 'u' || user_id || '/p' || (event_id % 7) AS path,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS kind,
         event_type = 'error' AS tombstone, sha256(CAST(event_id AS VARCHAR)) AS oid, event_id % 300000 AS size, event_id % 8 AS mode
  FROM events),
snapshots AS (
  SELECT *, lag(id) OVER (ORDER BY created_at) AS parent_id, row_number() OVER (ORDER BY created_at) AS seq FROM (
    SELECT DISTINCT CAST(ts AS DATE) AS day, 'snap-' || strftime(ts, '%Y%m%d') AS id, 'op-' || strftime(ts, '%Y%m%d') AS op_id,
           CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS created_at FROM events)),
file_records AS (
  SELECT snapshot_id, root_id, path, oid, size, mode, event_id, CAST(floor(epoch(observed_at)) AS BIGINT) AS modified FROM (
    SELECT s.id AS snapshot_id, j.*, row_number() OVER (PARTITION BY s.id, root_id, path ORDER BY observed_at DESC, event_id DESC) AS rn
    FROM journal j JOIN snapshots s ON j.observed_at < s.created_at) WHERE rn = 1 AND NOT tombstone),
operations AS (
  SELECT op_id AS id, seq, CASE WHEN parent_id IS NULL THEN 'initial-scan' ELSE 'file-events-batch' END AS kind,
         parent_id AS before_snapshot, id AS after_snapshot, created_at FROM snapshots),
refs AS (
  SELECT 'current' AS name, max_by(id, seq) AS value FROM snapshots UNION ALL
  SELECT 'branches/main', max_by(id, seq) FROM snapshots UNION ALL
  SELECT 'branches/old', id FROM snapshots WHERE seq = 5),
blobs AS (
  SELECT oid, size, 'objects/' || substr(oid, 1, 2) || '/' || oid AS object_key, CASE WHEN size <= {SMALL} THEN 'small' ELSE 'normal' END AS tier
  FROM (SELECT sha256(text) AS oid, min(n_chars) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1)),
large_objects AS (
  SELECT oid, size, CAST(ceil(size / {CHUNK}.0) AS BIGINT) AS chunk_count, 'large/manifests/' || oid AS manifest_key FROM blobs WHERE size > {LARGE}),
large_chunks AS (
  SELECT large_oid, i AS idx, i * {CHUNK} AS start, least({CHUNK}, n_chars - i * {CHUNK}) AS len, sha256(substr(text, CAST(i * {CHUNK} + 1 AS BIGINT), {CHUNK})) AS chunk_oid
  FROM (SELECT sha256(text) AS large_oid, any_value(text) AS text, any_value(n_chars) AS n_chars FROM documents WHERE n_chars > {LARGE} GROUP BY 1) t,
       LATERAL (SELECT unnest(range(0, CAST(ceil(t.n_chars / {CHUNK}.0) AS BIGINT))) AS i)),
chunks AS (SELECT chunk_oid AS oid, min(len) AS size, 'large/chunks/' || chunk_oid AS object_key FROM large_chunks GROUP BY 1, 3),
remote_objects AS (
  SELECT object_key AS key, size FROM blobs WHERE oid NOT LIKE 'a%' UNION ALL
  SELECT object_key, size FROM chunks WHERE oid NOT LIKE 'a%' UNION ALL
  SELECT manifest_key, chunk_count * 100 FROM large_objects WHERE oid NOT LIKE 'a%' UNION ALL
  SELECT 'objects/orphan/' || p_partkey, CAST(p_size AS BIGINT) FROM part),
upload_queue AS (
  SELECT o_orderkey AS id, (CASE o_custkey % 4 WHEN 0 THEN 'objects' WHEN 1 THEN 'metadata' WHEN 2 THEN 'refs' ELSE 'large/manifests' END) || '/' || o_orderkey AS key,
         o_orderkey % 5 AS attempts, o_orderdate AS created_at, o_totalprice AS weight FROM orders),
hosts AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS host, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey)
"""
