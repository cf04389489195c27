"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..registry import query
from . import views as V


@query(
    """SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN round(p_size * 1024.0) WHEN 1 THEN round(p_size * 1.5 * 1000000) ELSE p_size END AS BIGINT) AS bytes,
    CAST(CASE p_size % 2 WHEN 0 THEN p_size * 3600000 ELSE p_size * 1000 END AS BIGINT) AS ms FROM part"""
)
def parse_measures(spark, d):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(size, F.lit("KiB"))).when(size % 3 == 1, F.concat((size * 1.5).cast("decimal(20,1)"), F.lit(" mb"))).otherwise(size.cast("string"))
    span = F.when(size % 2 == 0, F.concat(size, F.lit("h"))).otherwise(F.concat(size, F.lit(" s")))
    return V.table(spark, d, "part").select("p_partkey", S.byte_size(text).alias("bytes"), S.duration_ms(span).alias("ms"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') AS label, CASE WHEN length(p_type) > 6 THEN substr(p_type, 1, 5) || '…' ELSE p_type END AS short_type, replace(p_brand, '#', '&amp;') AS brand FROM part")
def labels_and_escapes(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.host_label(F.col("p_name")).alias("label"), S.truncated(F.col("p_type"), 6).alias("short_type"), S.xml_escape(F.replace("p_brand", F.lit("#"), F.lit("&"))).alias("brand"))


@query("SELECT o_orderkey, CAST(least(5 * power(2, least(greatest(o_orderkey % 12 - 1, 0), 6)), 300) AS BIGINT) AS backoff, CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE CAST(floor((o_orderkey % 5) * 100 / (o_orderkey % 7)) AS BIGINT) END AS ratio FROM orders")
def backoff_and_ratio(spark, d):
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select("o_orderkey", S.backoff_seconds(k % 12).alias("backoff"), S.percent(k % 5, k % 7).alias("ratio"))


@query("SELECT page_id, CASE regexp_extract(lower(url), '[.]([a-z0-9]+)$', 1) WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media FROM pages")
def media_types(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.media_type(F.col("url")).alias("media"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS oid, substr(sha256(coalesce(text, '')), 1, 12) AS short_id, instr(substr(coalesce(text, ''), 1, 8192), chr(0)) > 0 AS is_binary FROM documents")
def content_hash(spark, d):
    text = F.coalesce("text", F.lit(""))
    oid = F.sha2(text, 256)
    return V.table(spark, d, "documents").select("doc_id", oid.alias("oid"), S.short_id(oid).alias("short_id"), S.looks_binary(text).alias("is_binary"))


@query("SELECT key, key <> '' AND NOT contains(key, chr(92)) AND NOT regexp_matches(key, '(^|/)(|[.]|[.][.])(/|$)') AS valid FROM (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN '/' || p_name WHEN 1 THEN p_name || '/../x' WHEN 2 THEN p_name || '/a' ELSE p_name || '//b' END AS key FROM part)")
def key_validity(spark, d):
    s, n = F.col("p_size") % 4, F.col("p_name")
    key = F.when(s == 0, F.concat(F.lit("/"), n)).when(s == 1, F.concat(n, F.lit("/../x"))).when(s == 2, F.concat(n, F.lit("/a"))).otherwise(F.concat(n, F.lit("//b")))
    return V.table(spark, d, "part").select(key.alias("key")).distinct().withColumn("valid", P.valid_key(F.col("key")))


@query("SELECT key, CASE WHEN starts_with(key, 'objects/') OR starts_with(key, 'packs/') OR starts_with(key, 'large/chunks/') THEN key ELSE 'hosts/h1/' || key END AS alias FROM upload_queue")
def canonical_alias(spark, d):
    return V.upload_queue(spark, d).select("key", S.canonical_alias(F.col("key"), "h1").alias("alias"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM events")
def json_and_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    return V.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"), F.unix_timestamp(ts).alias("seconds"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("shown"))


