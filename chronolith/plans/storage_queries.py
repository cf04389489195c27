"""Storage operators applied to the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history as H
from ..operators import storage as T
from ..registry import query
from . import views as V
from .history_queries import LATEST, _records

REACH_SQL = """
used AS (SELECT sha256(text) AS oid FROM documents WHERE lang IN ('en', 'fr') AND text IS NOT NULL),
live AS (
  SELECT object_key AS key FROM blobs WHERE oid IN (SELECT oid FROM used) AND oid NOT IN (SELECT oid FROM large_objects) UNION
  SELECT manifest_key FROM large_objects WHERE oid IN (SELECT oid FROM used) UNION
  SELECT 'large/chunks/' || chunk_oid FROM large_chunks WHERE large_oid IN (SELECT oid FROM used))"""


def _used(spark, d):
    return V.table(spark, d, "documents").where(F.col("lang").isin("en", "fr") & F.col("text").isNotNull()).select(F.sha2("text", 256).alias("oid"), "source")


def _live(spark, d):
    return T.reachable(_used(spark, d), V.large_objects(spark, d), V.large_chunks(spark, d), V.blobs(spark, d))


@query("SELECT oid, size, object_key, tier FROM blobs")
def blob_dedup(spark, d):
    return V.blobs(spark, d)


@query("SELECT large_oid, idx, start, len, chunk_oid FROM large_chunks")
def fixed_chunks(spark, d):
    return V.large_chunks(spark, d)


@query("SELECT count(*) AS placed, count(DISTINCT chunk_oid) AS chunks, CAST(sum(len) AS BIGINT) AS placed_bytes, CAST((SELECT sum(size) FROM chunks) AS BIGINT) AS stored_bytes FROM large_chunks")
def chunk_dedup_stats(spark, d):
    per = V.large_chunks(spark, d).groupBy("chunk_oid").agg(F.count("*").alias("n"), F.sum("len").alias("b"), F.min("len").alias("s"))
    return per.agg(F.sum("n").alias("placed"), F.count("*").alias("chunks"), F.sum("b").alias("placed_bytes"), F.sum("s").alias("stored_bytes"))


PACK_SQL = f"""
ordered AS (SELECT tier, substr(oid, 1, 1) AS head, oid, size, row_number() OVER (PARTITION BY tier, substr(oid, 1, 1) ORDER BY oid) AS n FROM blobs),
walk AS (
  SELECT tier, head, n, oid, size, CAST(0 AS BIGINT) AS pack_no, CAST(0 AS BIGINT) AS pack_offset FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.tier, o.head, o.n, o.oid, o.size,
         w.pack_no + CASE WHEN w.pack_offset + w.size + 8 + o.size + 8 > {V.PACK_TARGET} THEN 1 ELSE 0 END,
         CASE WHEN w.pack_offset + w.size + 8 + o.size + 8 > {V.PACK_TARGET} THEN 0 ELSE w.pack_offset + w.size + 8 END
  FROM ordered o JOIN walk w ON o.tier = w.tier AND o.head = w.head AND o.n = w.n + 1)"""


def _packed(spark, d):
    """Next-fit in groups of tier and first hex digit, so that every fold is bounded by a sixteenth of a tier."""
    items = V.blobs(spark, d).select("tier", F.substring("oid", 1, 1).alias("head"), "oid", "size")
    return T.next_fit(items, ["tier", "head"], ["oid"], "size", V.PACK_TARGET)


@query(f", {PACK_SQL} SELECT tier, head, oid, size, pack_no, pack_offset, size + 8 AS record_len FROM walk")
def pack_entries(spark, d):
    return _packed(spark, d)


@query(f", {PACK_SQL} SELECT tier, head || '-' || pack_no AS pack_id, count(*) AS object_count, CAST(sum(size + 8) AS BIGINT) AS size FROM walk GROUP BY 1, 2")
def packs(spark, d):
    return _packed(spark, d).groupBy("tier", F.concat_ws("-", "head", "pack_no").alias("pack_id")).agg(F.count("*").alias("object_count"), F.sum("record_len").alias("size"))


@query(
    f""", {PACK_SQL}, {REACH_SQL}, p AS (SELECT tier, head, pack_no, sum(size + 8) AS total, coalesce(sum(size + 8) FILTER (oid IN (SELECT oid FROM used)), 0) AS live FROM walk GROUP BY 1, 2, 3)
    SELECT tier, head, pack_no, CAST(total AS BIGINT) AS total, CAST(live AS BIGINT) AS live, CASE WHEN total = 0 THEN 100 ELSE CAST(floor(live * 100 / total) AS BIGINT) END AS used_percent FROM p"""
)
def pack_utilization(spark, d):
    used = _used(spark, d).select("oid").distinct().withColumn("in_use", F.lit(True))
    p = _packed(spark, d).join(used, "oid", "left").groupBy("tier", "head", "pack_no").agg(F.sum("record_len").alias("total"), F.coalesce(F.sum(F.when(F.col("in_use"), F.col("record_len"))), F.lit(0).cast("bigint")).alias("live"))
    return p.withColumn("used_percent", T.utilization(F.col("live"), F.col("total")))


@query(
    f""", {PACK_SQL}, {REACH_SQL}, p AS (SELECT tier, head, pack_no, sum(size + 8) AS total, coalesce(sum(size + 8) FILTER (oid IN (SELECT oid FROM used)), 0) AS live FROM walk GROUP BY 1, 2, 3),
    a AS (SELECT tier, count(*) AS packs, CAST(sum(total) AS BIGINT) AS total, CAST(sum(live) AS BIGINT) AS live FROM p GROUP BY 1)
    SELECT tier, packs, total - live AS reclaim, packs >= 2 AND total - live >= {T.RECLAIM_BYTES} AND NOT floor(live * 100 / total) > {T.UTILIZATION} AS compact FROM a"""
)
def compaction_decision(spark, d):
    used = _used(spark, d).select("oid").distinct().withColumn("in_use", F.lit(True))
    p = _packed(spark, d).join(used, "oid", "left").groupBy("tier").agg(F.count_distinct("head", "pack_no").alias("packs"), F.sum("record_len").alias("total"), F.coalesce(F.sum(F.when(F.col("in_use"), F.col("record_len"))), F.lit(0).cast("bigint")).alias("live"))
    use = T.utilization(F.col("live"), F.col("total"))
    return p.select("tier", "packs", (F.col("total") - F.col("live")).alias("reclaim"), T.should_compact(F.col("packs"), F.col("total") - F.col("live"), use, use).alias("compact"))


@query(f"SELECT count(*) AS loose, count(*) >= {T.AUTO_PACK_COUNT} AS pack_now FROM blobs WHERE size <= {T.SMALL_TIER}")
def auto_pack_decision(spark, d):
    return V.blobs(spark, d).agg(F.count_if(F.col("size") <= T.SMALL_TIER).alias("loose")).withColumn("pack_now", F.col("loose") >= T.AUTO_PACK_COUNT)


@query(f", {REACH_SQL} SELECT key FROM live")
def live_set(spark, d):
    return _live(spark, d)


@query(f", {REACH_SQL} SELECT key FROM live WHERE key NOT IN (SELECT key FROM remote_objects)")
def remote_missing(spark, d):
    return T.missing(_live(spark, d), V.remote_objects(spark, d))


@query(f", {REACH_SQL} SELECT key, size FROM remote_objects WHERE key NOT IN (SELECT key FROM live) AND key NOT IN (SELECT key FROM upload_queue)")
def gc_sweep(spark, d):
    return T.sweep(V.remote_objects(spark, d), _live(spark, d), V.upload_queue(spark, d))


@query(
    f""", {REACH_SQL} SELECT key, CASE WHEN substr(key, length(key), 1) < '8' THEN 'local' WHEN key IN (SELECT key FROM remote_objects) THEN 'archived' ELSE 'missing' END AS state FROM live"""
)
def restore_availability(spark, d):
    live = _live(spark, d)
    required = live.select(F.xxhash64("key").alias("seq"), "key")
    return T.availability(required, live.where(F.substring("key", -1, 1) < "8"), V.remote_objects(spark, d)).select("key", "state")


@query(
    """SELECT b.oid, 'blob' AS place, lang AS detail, count(*) AS n FROM blobs b JOIN documents d ON sha256(d.text) = b.oid GROUP BY 1, 3
    UNION ALL SELECT chunk_oid, 'chunk', large_oid, count(*) FROM large_chunks GROUP BY 1, 3"""
)
def object_explain(spark, d):
    """All places that refer to an object."""
    docs = V.table(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("oid"), F.lit("blob").alias("place"), F.col("lang").alias("detail"))
    chunks = V.large_chunks(spark, d).select(F.col("chunk_oid").alias("oid"), F.lit("chunk").alias("place"), F.col("large_oid").alias("detail"))
    return docs.unionByName(chunks).groupBy("oid", "place", "detail").agg(F.count("*").alias("n"))


@query(
    f""", cache AS (SELECT key, size + CAST(size % 3 = 0 AS INT) AS fingerprint FROM remote_objects), {REACH_SQL},
    l AS (SELECT object_key AS key, size AS fingerprint FROM blobs WHERE object_key IN (SELECT key FROM live))
    SELECT l.key, CASE WHEN c.key IS NULL THEN 'new' ELSE 'changed' END AS reason FROM l LEFT JOIN cache c ON l.key = c.key WHERE l.fingerprint IS DISTINCT FROM c.fingerprint"""
)
def upload_plan(spark, d):
    cache = V.remote_objects(spark, d).select("key", (F.col("size") + (F.col("size") % 3 == 0).cast("int")).alias("fingerprint"))
    live = V.blobs(spark, d).select(F.col("object_key").alias("key"), F.col("size").alias("fingerprint")).join(_live(spark, d), "key", "left_semi")
    return T.upload_plan(live, cache)


@query("SELECT id, key, attempts, CASE WHEN starts_with(key, 'refs/') THEN 3 WHEN starts_with(key, 'metadata/') THEN 2 ELSE 1 END AS priority, CAST(least(5 * power(2, least(greatest(attempts - 1, 0), 6)), 300) AS BIGINT) AS backoff FROM upload_queue ORDER BY priority, key")
def upload_order(spark, d):
    return V.upload_queue(spark, d).select("id", "key", "attempts", T.publish_priority(F.col("key")).alias("priority"), S.backoff_seconds(F.col("attempts")).alias("backoff")).orderBy("priority", "key")


@query(
    """, q AS (SELECT *, created_at + to_seconds(CAST(least(5 * power(2, least(greatest(attempts - 1, 0), 6)), 300) AS BIGINT)) AS retry_after FROM upload_queue)
    SELECT count(*) AS total, count(*) FILTER (attempts > 0) AS retrying, count(*) FILTER (retry_after > TIMESTAMP '1997-01-01') AS delayed, CAST(sum(attempts) AS BIGINT) AS attempts, max(attempts) AS most, count(*) > 0 AND max(attempts) > 0 AS backpressure FROM q"""
)
def upload_queue_stats(spark, d):
    q = V.upload_queue(spark, d).withColumn("retry_after", F.col("created_at") + F.make_interval(secs=S.backoff_seconds(F.col("attempts"))))
    a = q.agg(F.count("*").alias("total"), F.count_if(F.col("attempts") > 0).alias("retrying"), F.count_if(F.col("retry_after") > F.lit("1997-01-01").cast("timestamp_ntz")).alias("delayed"), F.sum("attempts").alias("attempts"), F.max("attempts").alias("most"))
    return a.withColumn("backpressure", (F.col("total") > 0) & (F.col("most") > 0))


RETENTION_SQL = f"""
days AS (SELECT max_by(id, created_at) AS id FROM snapshots GROUP BY CAST(created_at AS DATE) ORDER BY max(created_at) DESC LIMIT 5),
months AS (SELECT max_by(id, created_at) AS id FROM snapshots GROUP BY strftime(created_at, '%Y-%m') ORDER BY max(created_at) DESC LIMIT 2),
firsts AS (SELECT DISTINCT id FROM (SELECT min(snapshot_id) AS id FROM file_records GROUP BY root_id)),
why AS (SELECT id, 'day' AS w FROM days UNION SELECT id, 'month' FROM months UNION SELECT {LATEST}, 'current' UNION SELECT value, 'protected' FROM refs UNION SELECT id, 'protected' FROM firsts)"""


@query(f", {RETENTION_SQL} SELECT s.id, count(w) > 0 AS keep, coalesce(string_agg(w, ',' ORDER BY w), '') AS reason FROM snapshots s LEFT JOIN why ON s.id = why.id GROUP BY 1")
def retention_plan(spark, d):
    snaps = V.snapshots(spark, d)
    guarded = V.refs(spark, d).select(F.col("value").alias("id")).unionByName(H.first_snapshots(V.file_records(spark, d), snaps).select(F.col("first_snapshot").alias("id"))).distinct()
    return T.retention(snaps, 5, 2, snaps.agg(F.max_by("id", "seq")).first()[0], guarded)


@query(
    f""", r AS (SELECT * FROM file_records WHERE snapshot_id = {LATEST}), b AS (SELECT oid, size FROM journal WHERE event_id % 10 <> 3),
    o AS (SELECT DISTINCT root_id, oid FROM r)
    SELECT f.*, payloads, stored_bytes, missing FROM (SELECT root_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS client_bytes FROM r GROUP BY 1) f
    JOIN (SELECT root_id, count(*) AS payloads, CAST(coalesce(sum(b.size), 0) AS BIGINT) AS stored_bytes, count(*) FILTER (b.size IS NULL) AS missing FROM o LEFT JOIN b ON o.oid = b.oid GROUP BY 1) g ON f.root_id = g.root_id"""
)
def root_size(spark, d):
    """Stored payloads are those of the journal without event ids that end in 3."""
    stored = V.journal(spark, d).where("event_id % 10 <> 3").select("oid", "size")
    return T.size_rollup(_records(spark, d), stored)


@query(
    f""", r AS (SELECT * FROM file_records WHERE oid NOT IN (SELECT oid FROM file_records WHERE snapshot_id = {LATEST}))
    SELECT oid, max(size) AS bytes, count(DISTINCT snapshot_id) AS snapshots, min(snapshot_id) AS first_seen, max(snapshot_id) AS last_seen, min(path) AS first_path FROM r GROUP BY 1 ORDER BY bytes DESC, oid LIMIT 20"""
)
def retained_history(spark, d):
    """The twenty largest payloads that only history holds."""
    current = V.snapshots(spark, d).agg(F.max_by("id", "seq")).first()[0]
    return T.retained_history(V.file_records(spark, d), current, 20)


CATEGORY_SQL = "CASE " + " ".join(f"WHEN starts_with(key, '{p}') THEN '{n}'" for p, n in T.CATEGORIES) + " ELSE 'other' END"


@query(f"SELECT {CATEGORY_SQL} AS category, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM remote_objects GROUP BY 1")
def storage_by_category(spark, d):
    return V.remote_objects(spark, d).groupBy(T.category(F.col("key")).alias("category")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query(f"SELECT CAST(sum(size) FILTER (({CATEGORY_SQL}) IN ('chunk', 'manifest')) AS BIGINT) AS large_bytes, CAST(sum(size) FILTER (key LIKE 'objects/orphan/%') AS BIGINT) AS orphan_bytes, CAST(sum(size) AS BIGINT) AS bytes FROM remote_objects")
def cleanup_rollup(spark, d):
    kind = T.category(F.col("key"))
    return V.remote_objects(spark, d).agg(F.sum(F.when(kind.isin("chunk", "manifest"), F.col("size"))).alias("large_bytes"), F.sum(F.when(F.col("key").startswith("objects/orphan/"), F.col("size"))).alias("orphan_bytes"), F.sum("size").alias("bytes"))


RULES = [("objects/", 30, "STANDARD_IA"), ("objects/", 180, "GLACIER"), ("large/", 10, "STANDARD_IA")]


@query(
    """SELECT key, CASE WHEN starts_with(key, 'objects/') AND size % 400 >= 180 THEN 'GLACIER' WHEN starts_with(key, 'objects/') AND size % 400 >= 30 THEN 'STANDARD_IA'
    WHEN starts_with(key, 'large/') AND size % 400 >= 10 THEN 'STANDARD_IA' ELSE 'STANDARD' END AS tier FROM remote_objects"""
)
def lifecycle_tiers(spark, d):
    return V.remote_objects(spark, d).select("key", T.tier_of(F.col("key"), F.col("size") % 400, RULES).alias("tier"))


@query("SELECT l.oid, l.size, l.chunk_count, substr(l.oid, 1, 1) < '4' AS pinned FROM large_objects l ORDER BY size DESC, oid")
def large_with_pins(spark, d):
    large = V.large_objects(spark, d)
    pins = large.where(F.substring("oid", 1, 1) < "4").select("oid", F.lit(True).alias("p"))
    return large.join(pins, "oid", "left").select("oid", "size", "chunk_count", F.coalesce("p", F.lit(False)).alias("pinned")).orderBy(F.desc("size"), "oid")


@query("SELECT count(*) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS logical_bytes, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM large_objects")
def large_stats(spark, d):
    return V.large_objects(spark, d).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


@query("SELECT 'snapshots' AS name, count(*) AS n FROM snapshots UNION ALL SELECT 'blobs', count(*) FROM blobs UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'journal', count(*) FROM journal UNION ALL SELECT 'upload_queue', count(*) FROM upload_queue")
def table_counts(spark, d):
    out = None
    for name, view in (("snapshots", V.snapshots), ("blobs", V.blobs), ("chunks", V.chunks), ("journal", V.journal), ("upload_queue", V.upload_queue)):
        one = view(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT area, count(*) AS hosts, min(host) AS first_host FROM hosts GROUP BY 1")
def host_summary(spark, d):
    return V.hosts(spark, d).groupBy("area").agg(F.count("*").alias("hosts"), F.min("host").alias("first_host"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang))[1:2], ',') || CASE WHEN count(DISTINCT lang) > 2 THEN '+' || (count(DISTINCT lang) - 2) ELSE '' END AS preview FROM documents GROUP BY 1")
def set_preview(spark, d):
    return V.table(spark, d, "documents").groupBy("source").agg(T.set_preview(F.collect_set("lang"), 2).alias("preview"))


@query("SELECT key FROM remote_objects WHERE substr(key, 1, 8) = 'objects/' AND key IN (SELECT object_key FROM blobs)")
def cache_eviction_plan(spark, d):
    local = V.blobs(spark, d).select(F.col("object_key").alias("key"))
    return local.join(V.remote_objects(spark, d).select("key"), "key", "left_semi")


@query("SELECT sha256(text) AS oid, string_agg(piece, '' ORDER BY i) = any_value(text) AS whole FROM (SELECT text, i, substr(text, CAST(i * 4096 + 1 AS BIGINT), 4096) AS piece FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(n_chars / 4096.0) AS BIGINT))) AS i) WHERE n_chars > 8192 GROUP BY ALL) GROUP BY text")
def payload_read(spark, d):
    """Chunks joined back in order give the payload."""
    docs = V.table(spark, d, "documents").where(F.col("n_chars") > V.LARGE).select("text", "n_chars").distinct()
    pieces = docs.select("text", F.posexplode(T.fixed_ranges(F.col("n_chars"), V.CHUNK)).alias("i", "start")).select(F.sha2("text", 256).alias("oid"), "i", F.substring(F.col("text"), F.col("start").cast("int") + 1, F.lit(V.CHUNK)).alias("piece"))
    joined = pieces.groupBy("oid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x.piece), "").alias("t"))
    return joined.select("oid", (F.sha2("t", 256) == F.col("oid")).alias("whole"))
