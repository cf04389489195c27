"""Integrity operators applied to the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as I
from ..registry import query
from . import views as V

ERR = "'error' AS severity"


@query(f"SELECT 'blob-remote-missing' AS check, {ERR}, object_key AS key, '' AS detail FROM blobs WHERE object_key NOT IN (SELECT key FROM remote_objects) UNION ALL SELECT 'blob-remote-unexpected', 'error', key, '' FROM remote_objects WHERE starts_with(key, 'objects/') AND key NOT IN (SELECT object_key FROM blobs)")
def blob_remote_checks(spark, d):
    local = V.blobs(spark, d).select(F.col("object_key").alias("key"))
    return I.two_way(local, V.remote_objects(spark, d).where(F.col("key").startswith("objects/")), "key", "blob-remote")


@query(f"SELECT 'dangling-chunk' AS check, {ERR}, oid AS key, '' AS detail FROM chunks WHERE oid NOT IN (SELECT chunk_oid FROM large_chunks WHERE large_oid NOT LIKE 'b%')")
def dangling_chunks(spark, d):
    """Chunks that large objects whose id doesn't begin with b don't need."""
    owners = V.large_chunks(spark, d).where("NOT startswith(large_oid, 'b')")
    return I.orphans(V.chunks(spark, d), "oid", owners, "chunk_oid", "dangling-chunk")


@query(f"SELECT 'duplicate-text' AS check, {ERR}, sha256(text) AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents WHERE text IS NOT NULL GROUP BY 3 HAVING count(*) > 1")
def duplicate_payloads(spark, d):
    return I.duplicates(V.table(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("oid")), "oid", "duplicate-text")


@query(
    f""", a AS (SELECT oid, size FROM journal WHERE event_id % 5 <> 0), b AS (SELECT oid, size + CAST(event_id % 11 = 0 AS INT) AS size FROM journal WHERE event_id % 7 <> 0)
    SELECT 'journal-drift' AS check, {ERR}, coalesce(a.oid, b.oid) AS key, CASE WHEN a.oid IS NULL THEN 'only-right' WHEN b.oid IS NULL THEN 'only-left' ELSE 'mismatch' END AS detail
    FROM a FULL OUTER JOIN b ON a.oid = b.oid WHERE a.size IS DISTINCT FROM b.size"""
)
def config_drift(spark, d):
    j = V.journal(spark, d)
    a = j.where("event_id % 5 <> 0").select("oid", "size")
    b = j.where("event_id % 7 <> 0").select("oid", (F.col("size") + (F.col("event_id") % 11 == 0).cast("int")).alias("size"))
    return I.drift(a, b, "oid", ["size"], "journal-drift")


@query(
    f""", o AS (SELECT id, CASE WHEN seq % 9 = 0 THEN id WHEN seq % 4 = 0 THEN 'op-none' ELSE lag(id) OVER (ORDER BY seq) END AS parent, after_snapshot FROM operations), s AS (SELECT id FROM snapshots WHERE seq % 6 <> 0)
    SELECT 'self-parent' AS check, {ERR}, id AS key, '' AS detail FROM o WHERE parent = id UNION ALL
    SELECT 'missing-parent-op', 'error', parent, '' FROM o WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM o) UNION ALL
    SELECT 'missing-snapshot', 'error', after_snapshot, '' FROM o WHERE after_snapshot NOT IN (SELECT id FROM s)"""
)
def history_graph_checks(spark, d):
    """On a history with planted faults."""
    from pyspark.sql import Window

    ops = V.operations(spark, d)
    parent = F.when(F.col("seq") % 9 == 0, F.col("id")).when(F.col("seq") % 4 == 0, "op-none").otherwise(F.lag("id").over(Window.orderBy("seq")))
    return I.history_graph(ops.withColumn("parent", parent), "parent", V.snapshots(spark, d).where("seq % 6 <> 0"))


@query(f", m AS (SELECT oid, size + CAST(substr(oid, 1, 1) = '3' AS INT) AS size, chunk_count - CAST(substr(oid, 1, 1) = '5' AS INT) AS chunk_count FROM large_objects), g AS (SELECT large_oid AS oid, count(*) AS n, sum(len) AS bytes FROM large_chunks WHERE substr(large_oid, 1, 1) <> '7' GROUP BY 1) SELECT 'large-manifest' AS check, {ERR}, m.oid AS key, CASE WHEN n IS NULL THEN 'no-chunks' WHEN n <> chunk_count THEN 'chunk-count' ELSE 'size' END AS detail FROM m LEFT JOIN g ON m.oid = g.oid WHERE n IS NULL OR n <> chunk_count OR bytes <> size")
def large_manifest_checks(spark, d):
    """On manifests with planted faults."""
    h = F.substring("oid", 1, 1)
    large = V.large_objects(spark, d).select("oid", (F.col("size") + (h == "3").cast("int")).alias("size"), (F.col("chunk_count") - (h == "5").cast("int")).alias("chunk_count"))
    return I.manifests(large, V.large_chunks(spark, d).where(F.substring("large_oid", 1, 1) != "7"))


def _faulty_refs(spark, d):
    extra = spark.createDataFrame([("last-synced", "not-a-time"), ("last-synced", "2024-01-05 00:00:00"), ("legacy", "x"), ("branches/gone", "snap-19990101")], "name string, value string")
    return V.refs(spark, d).unionByName(extra)


@query(
    f""", r AS (SELECT * FROM refs UNION ALL VALUES ('last-synced', 'not-a-time'), ('last-synced', '2024-01-05 00:00:00'), ('legacy', 'x'), ('branches/gone', 'snap-19990101'))
    SELECT 'duplicate-ref' AS check, {ERR}, name AS key, CAST(count(*) AS VARCHAR) AS detail FROM r GROUP BY name HAVING count(*) > 1 UNION ALL
    SELECT 'missing-snapshot-ref', 'error', name, value FROM r WHERE (name = 'current' OR starts_with(name, 'branches/')) AND value NOT IN (SELECT id FROM snapshots) UNION ALL
    SELECT 'invalid-last-synced', 'error', name, value FROM r WHERE name = 'last-synced' AND try_cast(value AS TIMESTAMP) IS NULL UNION ALL
    SELECT 'unknown-ref', 'warning', name, value FROM r WHERE name NOT IN ('current', 'last-synced', 'current-branch') AND NOT starts_with(name, 'branches/')"""
)
def ref_checks(spark, d):
    return I.refs(_faulty_refs(spark, d), V.snapshots(spark, d))


@query(
    f"""SELECT 'queue-rule' AS check, {ERR}, CAST(id AS VARCHAR) AS key, detail FROM (
    SELECT id, unnest([CASE WHEN attempts > 3 THEN 'too-many-attempts' END, CASE WHEN key LIKE 'refs/%' AND attempts > 0 THEN 'ref-retried' END, CASE WHEN weight < 1000 THEN 'light' END]) AS detail FROM upload_queue) WHERE detail IS NOT NULL"""
)
def queue_row_rules(spark, d):
    rules = {"too-many-attempts": F.col("attempts") > 3, "ref-retried": F.col("key").startswith("refs/") & (F.col("attempts") > 0), "light": F.col("weight") < 1000}
    return I.row_rules(V.upload_queue(spark, d), "id", rules, "queue-rule")


@query(
    f""", b AS (SELECT oid, 'p' || substr(oid, 1, 1) AS pack_id, CASE WHEN oid LIKE '_0%' THEN NULL ELSE size END AS pack_offset, CASE WHEN oid LIKE '_1%' THEN NULL ELSE size END AS pack_len FROM blobs),
    p AS (SELECT 'p' || substr(oid, 1, 1) AS pack_id, CAST(max(size) AS BIGINT) AS size FROM blobs WHERE oid NOT LIKE 'c%' GROUP BY 1)
    SELECT 'pack-bounds' AS check, {ERR}, oid AS key, CASE WHEN pack_offset IS NULL THEN 'MissingBlobOffset' WHEN pack_len IS NULL THEN 'MissingBlobLength' ELSE 'BlobRangeOutOfBounds' END AS detail
    FROM b JOIN p ON b.pack_id = p.pack_id WHERE pack_offset IS NULL OR pack_len IS NULL OR pack_offset + pack_len > size
    UNION ALL SELECT DISTINCT 'missing-pack-metadata', 'error', pack_id, '' FROM b WHERE pack_id NOT IN (SELECT pack_id FROM p)"""
)
def pack_bounds_checks(spark, d):
    """On pack places with planted faults."""
    b = V.blobs(spark, d)
    pack = F.concat(F.lit("p"), F.substring("oid", 1, 1)).alias("pack_id")
    second = F.substring("oid", 2, 1)
    placed = b.select("oid", pack, F.when(second != "0", F.col("size")).alias("pack_offset"), F.when(second != "1", F.col("size")).alias("pack_len"))
    return I.pack_bounds(placed, b.where("NOT startswith(oid, 'c')").groupBy(pack).agg(F.max("size").alias("size")))


@query(
    f""", i AS (SELECT oid, size AS "offset", size + CAST(oid LIKE '_2%' AS INT) AS len FROM blobs WHERE oid NOT LIKE 'd%'), b AS (SELECT oid, size AS pack_offset, size AS pack_len FROM blobs WHERE oid NOT LIKE 'e%')
    SELECT 'pack-index' AS check, {ERR}, coalesce(i.oid, b.oid) AS key, CASE WHEN b.oid IS NULL THEN 'EntryWithoutBlobMetadata' WHEN i.oid IS NULL THEN 'MissingBlobEntry' ELSE 'EntryOffsetMismatch' END AS detail
    FROM i FULL OUTER JOIN b ON i.oid = b.oid WHERE b.oid IS NULL OR i.oid IS NULL OR len <> pack_len"""
)
def pack_index_checks(spark, d):
    """On an index with planted faults."""
    b = V.blobs(spark, d)
    index = b.where("NOT startswith(oid, 'd')").select("oid", F.col("size").alias("offset"), (F.col("size") + (F.substring("oid", 2, 1) == "2").cast("int")).alias("len"))
    return I.pack_index(index, b.where("NOT startswith(oid, 'e')").select("oid", F.col("size").alias("pack_offset"), F.col("size").alias("pack_len")))


@query(
    """, m AS (SELECT object_key AS key FROM blobs WHERE object_key NOT IN (SELECT key FROM remote_objects)), c AS (SELECT object_key AS key FROM chunks WHERE object_key NOT IN (SELECT key FROM remote_objects)), u AS (SELECT key FROM remote_objects WHERE starts_with(key, 'objects/orphan/'))
    SELECT (SELECT count(*) FROM m) + (SELECT count(*) FROM c) + (SELECT count(*) FROM u) AS issues, CASE WHEN (SELECT count(*) FROM m) + (SELECT count(*) FROM c) > 0 THEN 'unprotected' WHEN (SELECT count(*) FROM u) > 0 THEN 'degraded' ELSE 'protected' END AS state"""
)
def health(spark, d):
    """Severity of the union of checks."""
    remote = V.remote_objects(spark, d).select("key")
    blobs, chunks = V.blobs(spark, d).select(F.col("object_key").alias("key")), V.chunks(spark, d).select(F.col("object_key").alias("key"))
    found = I.report(I.orphans(blobs, "key", remote, "key", "blob"), I.orphans(chunks, "key", remote, "key", "chunk"), I.issues(remote.where(F.col("key").startswith("objects/orphan/")), "orphan", "key", None, "warning"))
    return I.severity_fold(found)


@query("SELECT sha256(text) AS oid, count(*) AS copies FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT oid FROM blobs WHERE oid NOT LIKE 'f%') GROUP BY 1")
def payload_readability(spark, d):
    """Payloads that no readable blob holds (those whose id begins with f are not)."""
    docs = V.table(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("oid"))
    return docs.join(V.blobs(spark, d).where("NOT startswith(oid, 'f')").select("oid"), "oid", "left_anti").groupBy("oid").agg(F.count("*").alias("copies"))
