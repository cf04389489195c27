"""Integrity families, storage plans and table changes applied to the derived views, with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as O
from ..operators import integrity as I
from ..operators import mutation as M
from ..operators import storage as T
from ..registry import query
from . import views as V
from .history_queries import LATEST, _at, _records
from .integrity_queries import ERR
from .storage_queries import REACH_SQL, _live, _used

ROOTS_SQL = "roots AS (SELECT snapshot_id, root_id, CAST(sum(size) AS VARCHAR) AS tree_id, count(*) AS file_count FROM file_records GROUP BY 1, 2)"


def _roots(spark, d):
    return V.file_records(spark, d).groupBy("snapshot_id", "root_id").agg(F.sum("size").cast("string").alias("tree_id"), F.count("*").alias("file_count"))


@query(
    f""", {ROOTS_SQL}, m AS (SELECT snapshot_id, root_id, CASE WHEN file_count % 3 = 1 THEN 'x' ELSE tree_id END AS tree_id, file_count + CAST(file_count % 4 = 1 AS INT) AS file_count FROM roots WHERE file_count % 5 <> 0)
    SELECT 'tree-manifest' AS check, {ERR}, r.snapshot_id || '/' || r.root_id AS key, k AS detail FROM (
      SELECT r.snapshot_id, r.root_id, unnest([CASE WHEN m.root_id IS NULL THEN 'RootIdMismatch' END, CASE WHEN m.tree_id <> r.tree_id THEN 'TreeIdMismatch' END, CASE WHEN m.file_count <> r.file_count THEN 'FileCountMismatch' END]) AS k
      FROM roots r LEFT JOIN m ON r.snapshot_id = m.snapshot_id AND r.root_id = m.root_id) r WHERE k IS NOT NULL"""
)
def tree_manifest_checks(spark, d):
    r, n = _roots(spark, d), F.col("file_count")
    m = r.where(n % 5 != 0).select("snapshot_id", "root_id", F.when(n % 3 == 1, "x").otherwise(F.col("tree_id")).alias("tree_id"), (n + (n % 4 == 1).cast("int")).alias("file_count"))
    return I.tree_manifests(m, r)


@query(
    f""", i AS (SELECT oid, size + CAST(oid LIKE '2%' AS INT) AS size FROM chunks WHERE oid NOT LIKE '1%' UNION ALL SELECT oid, size FROM chunks WHERE oid LIKE '3%' UNION ALL SELECT 'zz' || oid, size FROM chunks WHERE oid LIKE '4%')
    SELECT 'chunk-index' AS check, {ERR}, key, detail FROM (
      SELECT DISTINCT i.oid AS key, 'UnexpectedEntry' AS detail FROM i WHERE oid NOT IN (SELECT oid FROM chunks) UNION ALL
      SELECT oid, 'DuplicateEntry' FROM i WHERE oid IN (SELECT oid FROM chunks) GROUP BY 1 HAVING count(*) > 1 UNION ALL
      SELECT DISTINCT i.oid, 'EntryMismatch' FROM i JOIN chunks c ON i.oid = c.oid WHERE i.size <> c.size UNION ALL
      SELECT oid, 'MissingEntry' FROM chunks WHERE oid NOT IN (SELECT oid FROM i))"""
)
def chunk_index_checks(spark, d):
    c = V.chunks(spark, d).select("oid", "size")
    h = F.substring("oid", 1, 1)
    index = c.where(h != "1").select("oid", (F.col("size") + (h == "2").cast("int")).alias("size")).unionByName(c.where(h == "3")).unionByName(c.where(h == "4").select(F.concat(F.lit("zz"), "oid").alias("oid"), "size"))
    return I.chunk_index(index, c)


@query(
    f""", {REACH_SQL}, k AS (SELECT key FROM live WHERE substr(key, length(key), 1) <> '0' UNION ALL SELECT key FROM live WHERE substr(key, length(key), 1) = '1' UNION ALL SELECT key FROM remote_objects WHERE starts_with(key, 'objects/orphan/'))
    SELECT 'gc-mark' AS check, {ERR}, 'h2' AS key, unnest(['UnsupportedVersion', 'HostMismatch', 'CurrentSnapshotMismatch']) AS detail UNION ALL
    SELECT 'gc-mark', 'error', key, 'DuplicateObjectKeys' FROM k GROUP BY key HAVING count(*) > 1 UNION ALL
    SELECT 'gc-mark', 'error', key, 'MissingLiveObject' FROM live WHERE key NOT IN (SELECT key FROM k) UNION ALL
    SELECT DISTINCT 'gc-mark', 'error', key, 'UnexpectedObjectKey' FROM k WHERE key NOT IN (SELECT key FROM live)"""
)
def gc_mark_checks(spark, d):
    live, end = _live(spark, d), F.substring("key", -1, 1)
    orphan = V.remote_objects(spark, d).where(F.col("key").startswith("objects/orphan/")).select("key")
    keys = live.where(end != "0").unionByName(live.where(end == "1")).unionByName(orphan)
    mark = spark.createDataFrame([(2, "h2", "snap-none")], "version int, host_id string, current_snapshot string")
    return I.gc_mark(mark, keys, live, "h1", V.snapshots(spark, d).agg(F.max_by("id", "seq")).first()[0])


@query(
    f""", t AS (SELECT CASE WHEN id % 5 = 0 THEN '/' || key WHEN id % 7 = 0 THEN key || '/../x' ELSE key END AS key, 1 + CAST(id % 3 = 0 AS INT) AS version, CASE WHEN id % 4 = 0 THEN 'h2' ELSE 'h1' END AS host_id FROM upload_queue)
    SELECT 'gc-tombstone' AS check, {ERR}, key, detail FROM (SELECT key, unnest([CASE WHEN version <> 1 THEN 'UnsupportedVersion' END, CASE WHEN host_id <> 'h1' THEN 'HostMismatch' END, CASE WHEN starts_with(key, '/') OR contains(key, '..') THEN 'InvalidDeletedKey' END]) AS detail FROM t) WHERE detail IS NOT NULL"""
)
def gc_tombstone_checks(spark, d):
    n = F.col("id")
    key = F.when(n % 5 == 0, F.concat(F.lit("/"), "key")).when(n % 7 == 0, F.concat("key", F.lit("/../x"))).otherwise(F.col("key"))
    rows = V.upload_queue(spark, d).select(key.alias("key"), (F.lit(1) + (n % 3 == 0).cast("int")).alias("version"), F.when(n % 4 == 0, "h2").otherwise("h1").alias("host_id"))
    return I.gc_tombstones(rows, "h1")


REMOTE_REFS = [
    ("origin", "hosts/h1/refs/current", "snap-none", "2024-01-01T00:00:00Z"),
    ("", "hosts/h1/refs/last-synced", "never", "2024-01-01T00:00:00Z"),
    ("origin", "hosts/h2/refs/last-synced", "2024-01-02T00:00:00Z", "yesterday"),
    ("origin", "hosts/h1/roots/r0/ack", "no json", "2024-01-01T00:00:00Z"),
    ("origin", "hosts/h1/roots/r1/ack", '{"snapshot_id": "snap-none"}', "2024-01-01T00:00:00Z"),
    ("origin", "hosts/h1/refs/other", "x", "2024-01-01T00:00:00Z"),
    ("origin", "odd", "x", "2024-01-01T00:00:00Z"),
]
_REF = r"regexp_extract(name, '^hosts/([^/]+)/refs/([^/]+)$', {})"
_ACK = r"regexp_extract(name, '^hosts/([^/]+)/roots/([^/]+)/ack$', 1)"


@query(
    f""", v AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in REMOTE_REFS)}) t(remote, name, value, observed_at) UNION ALL SELECT 'origin', 'hosts/h1/roots/s' || seq || '/ack', '{{"snapshot_id": "' || id || '"}}', '2024-01-01T00:00:00Z' FROM snapshots),
    x AS (SELECT *, {_REF.format(1)} AS rh, {_REF.format(2)} AS ref, {_ACK} AS ah FROM v),
    y AS (SELECT *, CASE WHEN ah <> '' THEN CASE WHEN json_valid(value) THEN json_extract_string(value, '$.snapshot_id') END WHEN rh <> '' AND ref = 'current' THEN value END AS points, CASE WHEN rh <> '' THEN rh WHEN ah <> '' THEN ah END AS h FROM x)
    SELECT 'remote-ref' AS check, {ERR}, name AS key, detail FROM (SELECT name, unnest([CASE WHEN trim(remote) = '' THEN 'EmptyRemote' END, CASE WHEN try_cast(observed_at AS TIMESTAMP) IS NULL THEN 'InvalidObservedAt' END, CASE WHEN h IS NULL THEN 'UnsupportedName' END,
      CASE WHEN h <> 'h1' THEN 'HostMismatch' END, CASE WHEN ah <> '' AND points IS NULL THEN 'InvalidAck' END, CASE WHEN points IS NOT NULL AND points NOT IN (SELECT id FROM snapshots) THEN 'MissingSnapshot' END,
      CASE WHEN ref = 'last-synced' AND try_cast(value AS TIMESTAMP) IS NULL THEN 'InvalidLastSynced' END, CASE WHEN rh <> '' AND ref NOT IN ('current', 'last-synced') THEN 'UnsupportedRefName' END]) AS detail FROM y) WHERE detail IS NOT NULL"""
)
def remote_ref_checks(spark, d):
    s = V.snapshots(spark, d)
    good = s.select(F.lit("origin").alias("remote"), F.concat(F.lit("hosts/h1/roots/s"), "seq", F.lit("/ack")).alias("name"), F.to_json(F.struct(F.col("id").alias("snapshot_id"))).alias("value"), F.lit("2024-01-01T00:00:00Z").alias("observed_at"))
    return I.remote_refs(spark.createDataFrame(REMOTE_REFS, "remote string, name string, value string, observed_at string").unionByName(good), "h1", s)


@query(f", p AS (SELECT CASE WHEN oid LIKE '1%' THEN 'zz' || oid ELSE oid END AS oid, CASE WHEN oid LIKE '2%' THEN 'soon' ELSE '2024-01-01 00:00:00' END AS pinned_at FROM large_objects) SELECT 'large-pin' AS check, {ERR}, oid AS key, 'Dangling' AS detail FROM p WHERE oid NOT IN (SELECT oid FROM large_objects) UNION ALL SELECT 'large-pin', 'error', oid, 'InvalidTimestamp' FROM p WHERE pinned_at = 'soon'")
def large_pin_checks(spark, d):
    large, h = V.large_objects(spark, d), F.substring("oid", 1, 1)
    pins = large.select(F.when(h == "1", F.concat(F.lit("zz"), "oid")).otherwise(F.col("oid")).alias("oid"), F.when(h == "2", "soon").otherwise("2024-01-01 00:00:00").alias("pinned_at"))
    return I.large_pins(pins, large)


@query(f"SELECT 'host-file' AS check, {ERR}, CAST(id AS VARCHAR) AS key, detail FROM (SELECT id, unnest([CASE WHEN id % 6 = 0 THEN 'IdMismatch' END, CASE WHEN id % 4 = 0 THEN 'NameMismatch' END]) AS detail FROM hosts) WHERE detail IS NOT NULL")
def host_file_checks(spark, d):
    h = V.hosts(spark, d)
    files = h.select(F.col("id").alias("key"), (F.col("id") + F.when(F.col("id") % 6 == 0, 100).otherwise(0)).alias("host_id"), F.when(F.col("id") % 4 == 0, "renamed").otherwise(F.col("host")).alias("host_name"))
    return I.host_files(files, h.select(F.col("id").alias("key"), F.col("id").alias("config_id"), F.col("host").alias("config_name")))


@query(
    f""", a AS (SELECT root_id, tree_id, file_count FROM roots WHERE snapshot_id = {LATEST}), b AS (SELECT root_id, CASE root_id WHEN 'r1' THEN 'old' ELSE tree_id END AS tree_id, file_count FROM a WHERE root_id <> 'r2' UNION ALL SELECT 'r9', 'x', 1)
    SELECT 'root-ack' AS check, {ERR}, coalesce(a.root_id, b.root_id) AS key, CASE WHEN b.root_id IS NULL THEN 'only-right' WHEN a.root_id IS NULL THEN 'only-left' ELSE 'mismatch' END AS detail FROM a FULL OUTER JOIN b ON a.root_id = b.root_id WHERE (a.tree_id, a.file_count) IS DISTINCT FROM (b.tree_id, b.file_count)""".replace(", a AS", f", {ROOTS_SQL}, a AS", 1)
)
def root_ack_checks(spark, d):
    head = _records(spark, d).groupBy("root_id").agg(F.sum("size").cast("string").alias("tree_id"), F.count("*").alias("file_count"))
    acks = head.where("root_id <> 'r2'").select("root_id", F.when(F.col("root_id") == "r1", "old").otherwise(F.col("tree_id")).alias("tree_id"), "file_count")
    return I.root_acks(acks.unionByName(spark.createDataFrame([("r9", "x", 1)], acks.schema)), head)


@query(
    f""", e AS (SELECT 'ops/' || id AS key FROM operations UNION ALL SELECT 'snapshots/' || id FROM snapshots), k AS (SELECT key FROM e WHERE NOT key LIKE '%15' UNION ALL SELECT key || '.bak' FROM e WHERE key LIKE '%07')
    SELECT 'timeline-missing' AS check, {ERR}, key, '' AS detail FROM e WHERE key NOT IN (SELECT key FROM k) UNION ALL SELECT 'timeline-unexpected', 'error', key, '' FROM k WHERE key NOT IN (SELECT key FROM e)
    UNION ALL SELECT * FROM (VALUES ('lifecycle-missing', 'error', 'large/chunks/:30:ARCHIVE', ''), ('lifecycle-unexpected', 'error', 'large/chunks/:60:ARCHIVE', ''))"""
)
def timeline_checks(spark, d):
    """Only expected keys stand under the prefixes of snapshots and operations, and the store's tier rules are those configured."""
    e = V.operations(spark, d).select(F.concat(F.lit("ops/"), "id").alias("key")).unionByName(V.snapshots(spark, d).select(F.concat(F.lit("snapshots/"), "id").alias("key")))
    k = e.where(~F.col("key").endswith("15")).unionByName(e.where(F.col("key").endswith("07")).select(F.concat("key", F.lit(".bak")).alias("key")))
    rules = lambda days: spark.createDataFrame([("objects/", 90, "COLD"), ("large/chunks/", days, "ARCHIVE")], "prefix string, days int, class string")
    return I.report(I.only_expected(k, e, ["ops/", "snapshots/"], "timeline"), I.lifecycle_rules(rules(30), rules(60)))


@query(f"SELECT 'head' AS check, {ERR}, 'current' AS key, 'lagging' AS detail UNION ALL SELECT 'missing-snapshot-ref', 'error', 'branches/gone', 'snap-19990101' UNION ALL SELECT 'current-manifest-missing', 'error', root_id, '' FROM (SELECT DISTINCT root_id FROM {_at(LATEST)}) WHERE root_id = 'r3'")
def quick_remote_checks(spark, d):
    """The cheap part of the remote checks: head, refs and the current snapshot's manifests."""
    from ..operators.control import head_status

    s = V.snapshots(spark, d)
    head = s.agg(F.max_by("id", "seq").alias("l"), F.min_by("id", "seq").alias("r")).select(head_status(F.col("l"), F.col("r")).alias("state"))
    refs = V.refs(spark, d).unionByName(spark.createDataFrame([("branches/gone", "snap-19990101")], "name string, value string"))
    roots = _records(spark, d).select("root_id").distinct()
    have = roots.where("root_id <> 'r3'")
    return I.report(I.issues(head.where("state <> 'synced'"), "head", F.lit("current"), "state"), I.refs(refs, s), I.two_way(roots, have, "root_id", "current-manifest"))


@query(f", {REACH_SQL}, l AS (SELECT key FROM live WHERE substr(key, length(key), 1) < '8') SELECT key, CASE WHEN key IN (SELECT key FROM l) THEN 'reupload' ELSE 'lost' END AS action FROM live WHERE key NOT IN (SELECT key FROM remote_objects)")
def remote_repair(spark, d):
    """Live keys that the remote lacks: uploaded again where a local copy (a key that ends below 8) is there."""
    live = _live(spark, d)
    return I.repair_list(live, V.remote_objects(spark, d), live.where(F.substring("key", -1, 1) < "8"))


SCOPED = """rec AS (SELECT DISTINCT strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INT), 'snap-%Y%m%d') AS snapshot_id, sha256(text) AS oid FROM documents WHERE text IS NOT NULL)"""


def _doc_records(spark, d):
    docs = V.table(spark, d, "documents").where("text IS NOT NULL")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return docs.select(F.concat(F.lit("snap-"), F.date_format(day, "yyyyMMdd")).alias("snapshot_id"), F.sha2("text", 256).alias("oid")).distinct()


@query(
    f""", {SCOPED}, used AS (SELECT oid FROM rec WHERE snapshot_id >= 'snap-20240121')
    SELECT object_key AS key FROM blobs WHERE oid IN (SELECT oid FROM used) AND oid NOT IN (SELECT oid FROM large_objects) UNION SELECT manifest_key FROM large_objects WHERE oid IN (SELECT oid FROM used) UNION SELECT 'large/chunks/' || chunk_oid FROM large_chunks WHERE large_oid IN (SELECT oid FROM used)"""
)
def scoped_check_keys(spark, d):
    """What a check of the snapshots since a time looks at."""
    records = _doc_records(spark, d)
    snaps = records.select(F.col("snapshot_id").alias("id")).distinct().withColumn("created_at", F.to_timestamp(F.substring("id", 6, 8), "yyyyMMdd"))
    return O.scoped(records, snaps, F.lit("2024-01-21").cast("timestamp"), V.large_objects(spark, d), V.large_chunks(spark, d), V.blobs(spark, d))


@query(f", {SCOPED} SELECT snapshot_id, oid FROM rec WHERE CAST(substr(snapshot_id, 13, 1) AS INT) % 2 = 1")
def index_backfill(spark, d):
    """Edges of snapshots that the edge table lacks (those of odd days)."""
    r = _doc_records(spark, d)
    return O.backfill(r, r.where(F.substring("snapshot_id", 13, 1).cast("int") % 2 == 0))


@query("SELECT object_key AS old_key, 'blobs/loose/' || substr(oid, 1, 2) || '/' || oid AS new_key FROM blobs WHERE object_key IN (SELECT key FROM remote_objects) AND substr(oid, 2, 1) <> '3'")
def legacy_migration(spark, d):
    """Old keys and where their copies go; those whose new key is there already (a 3 in the second place) are done."""
    new = F.concat(F.lit("blobs/loose/"), F.substring("oid", 1, 2), F.lit("/"), "oid").alias("new_key")
    b = V.blobs(spark, d).select("oid", F.col("object_key").alias("old_key"), new)
    there = b.join(V.remote_objects(spark, d).select(F.col("key").alias("old_key")), "old_key", "left_semi")
    done = b.where("substr(oid, 2, 1) = '3'").select("new_key")
    return there.join(done, "new_key", "left_anti").select("old_key", "new_key")


@query("SELECT key FROM remote_objects r JOIN blobs b ON r.key = b.object_key WHERE substr(oid, 2, 1) = '3' AND size_ok".replace("size_ok", "b.size <= 3000"))
def legacy_alias_sweep(spark, d):
    """Old keys that may go: their alias is there, and no mark protects them (those over 3000 bytes are)."""
    b = V.blobs(spark, d).select("oid", "size", F.col("object_key").alias("key"))
    alias, marked = b.where("substr(oid, 2, 1) = '3'").select("key"), b.where("size > 3000").select("key")
    return V.remote_objects(spark, d).select("key").join(alias, "key", "left_semi").join(marked, "key", "left_anti")


@query(
    f""", {REACH_SQL}, o AS (SELECT tier, substr(oid, 1, 1) AS head, oid, size, oid NOT IN (SELECT oid FROM used) AS history FROM blobs), n AS (SELECT *, row_number() OVER (PARTITION BY tier, head, history ORDER BY oid) AS n FROM o),
    w AS (SELECT tier, head, history, n, oid, size, CAST(0 AS BIGINT) AS pack_no, CAST(0 AS BIGINT) AS pack_offset FROM n WHERE n = 1 UNION ALL
      SELECT n.tier, n.head, n.history, n.n, n.oid, n.size, w.pack_no + CASE WHEN w.pack_offset + w.size + 8 + n.size + 8 > {V.PACK_TARGET} THEN 1 ELSE 0 END, CASE WHEN w.pack_offset + w.size + 8 + n.size + 8 > {V.PACK_TARGET} THEN 0 ELSE w.pack_offset + w.size + 8 END
      FROM n JOIN w ON n.tier = w.tier AND n.head = w.head AND n.history = w.history AND n.n = w.n + 1)
    SELECT tier, head, history, oid, pack_no, pack_offset FROM w"""
)
def compact_packs(spark, d):
    """Blobs packed anew: those of the current snapshots apart from history, each next-fit in order."""
    b = O.in_compaction(V.blobs(spark, d), _used(spark, d)).select("tier", F.substring("oid", 1, 1).alias("head"), "history", "oid", "size")
    return T.next_fit(b, ["tier", "head", "history"], ["oid"], "size", V.PACK_TARGET).select("tier", "head", "history", "oid", "pack_no", "pack_offset")


@query("SELECT oid, row_number() OVER (ORDER BY pack_id NULLS FIRST, pack_offset NULLS FIRST, oid) AS place FROM (SELECT oid, CASE WHEN oid LIKE '_0%' THEN NULL ELSE 'p' || substr(oid, 1, 1) END AS pack_id, CASE WHEN oid LIKE '_1%' THEN NULL ELSE size END AS pack_offset FROM blobs) ORDER BY place LIMIT 100")
def compaction_order(spark, d):
    """The first hundred blobs in the order in which compaction takes them."""
    second = F.substring("oid", 2, 1)
    b = V.blobs(spark, d).select("oid", F.when(second != "0", F.concat(F.lit("p"), F.substring("oid", 1, 1))).alias("pack_id"), F.when(second != "1", F.col("size")).alias("pack_offset"))
    rows = O.compaction_order(b).limit(100)
    from pyspark.sql import Window

    return rows.select("oid", F.row_number().over(Window.orderBy(F.asc_nulls_first("pack_id"), F.asc_nulls_first("pack_offset"), "oid")).cast("bigint").alias("place"))


@query("SELECT category, count(*) AS removed, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, CASE WHEN starts_with(key, 'objects/') THEN 'payload' WHEN starts_with(key, 'large/chunks/') THEN 'chunk' ELSE 'manifest' END AS category FROM remote_objects WHERE size % 3 = 0) GROUP BY 1")
def cache_eviction_counts(spark, d):
    """What applying an eviction plan (every third size) removes."""
    plan = V.remote_objects(spark, d).where("size % 3 = 0").select("key")
    gone = V.remote_objects(spark, d).join(plan, "key", "left_semi")
    return gone.groupBy(T.category(F.col("key")).alias("category")).agg(F.count("*").alias("removed"), F.sum("size").alias("bytes"))


@query(f", {REACH_SQL} SELECT object_key AS key FROM blobs WHERE object_key NOT IN (SELECT key FROM live) AND size <= {T.SMALL_TIER} AND size % 2 = 0")
def packed_loose_prune(spark, d):
    """Loose copies that nothing refers to and that are older than the cutoff (those of even size)."""
    loose = V.blobs(spark, d).where((F.col("size") <= T.SMALL_TIER) & (F.col("size") % 2 == 0)).select(F.col("object_key").alias("key"))
    return loose.join(_live(spark, d), "key", "left_anti")


@query("SELECT 'snapshots/' || s.id AS key FROM snapshots s WHERE seq % 3 <> 0 AND seq % 5 <> 0 AND seq % 7 <> 0 UNION ALL SELECT 'ops/' || op_id FROM snapshots WHERE seq % 3 <> 0 AND seq % 5 <> 0")
def upload_delta(spark, d):
    """Snapshots and operations to enqueue: not those cached with the same fingerprint (every third), queued (every fifth) or there (every seventh snapshot)."""
    s, n = V.snapshots(spark, d), F.col("seq")
    key = F.explode(F.array(F.concat(F.lit("snapshots/"), "id"), F.concat(F.lit("ops/"), "op_id"))).alias("key")
    every = s.select(n, key, F.md5("id").alias("fingerprint"))
    cache = every.where(n % 3 == 0).select("key", "fingerprint")
    known = every.where(n % 5 == 0).select("key").unionByName(every.where((n % 7 == 0) & F.col("key").startswith("snapshots/")).select("key"))
    return T.upload_plan(every, cache).select("key").join(known, "key", "left_anti")


@query("SELECT object_key AS old_key, 'objects/' || substr(sha256(oid || 'k2'), 1, 2) || '/' || sha256(oid || 'k2') AS new_key, NULL AS pack_id FROM blobs")
def key_rotation(spark, d):
    """A bulk rewrite after a change of key: each object gets a new name, places in packs are cleared."""
    name = F.sha2(F.concat("oid", F.lit("k2")), 256)
    b = V.blobs(spark, d).select(F.col("object_key").alias("old_key"), name.alias("n"), F.lit("p").alias("pack_id"))
    return M.update(b, F.lit(True), pack_id=F.lit(None).cast("string")).select("old_key", F.concat(F.lit("objects/"), F.substring("n", 1, 2), F.lit("/"), "n").alias("new_key"), "pack_id")


@query("SELECT id, key, CASE WHEN id % 10 = 0 THEN 0 ELSE attempts END AS attempts FROM upload_queue WHERE NOT (attempts = 4 AND id % 10 <> 0)")
def queue_reset(spark, d):
    """An update by a condition, then a delete by another."""
    q = M.update(V.upload_queue(spark, d).select("id", "key", "attempts"), F.col("id") % 10 == 0, attempts=F.lit(0).cast("bigint"))
    return M.delete(q, F.col("attempts") == 4)


@query("SELECT * FROM (VALUES ('r0', 'active', NULL), ('r1', 'paused', NULL), ('r2', 'deleted', 'gone'), ('r4', 'active', NULL)) t(root_id, status, degraded)")
def root_changes(spark, d):
    """Roots added, paused, resumed, marked deleted and removed, as table versions."""
    roots = V.journal(spark, d).select("root_id").distinct().select("root_id", F.lit("active").alias("status"), F.when(F.col("root_id") == "r0", "unmounted").alias("degraded"))
    status = lambda t, r, s, why=None: M.update(t, F.col("root_id") == r, status=F.lit(s), degraded=F.lit(why).cast("string") if s == "active" or why else F.col("degraded"))
    roots = M.upsert(roots, spark.createDataFrame([("r4", "paused", None)], roots.schema), ["root_id"])
    roots = status(status(status(roots, "r1", "paused"), "r4", "active"), "r2", "deleted", "gone")
    return M.delete(status(roots, "r0", "active"), F.col("root_id") == "r3")
