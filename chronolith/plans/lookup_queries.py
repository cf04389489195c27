"""References, lookups, sizes, bundles and change levels applied to the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..operators import history as H
from ..operators import integrity as I
from ..operators import mutation as M
from ..operators import storage as T
from ..registry import query
from . import views as V
from .history_queries import BEFORE_LATEST, BY_SEQ, LATEST, LIVE_SQL, _at, _live, _records
from .integrity_queries import ERR
from .storage_queries import REACH_SQL, _live as _live_keys, _used

@query(f"SELECT coalesce(o.root_id, n.root_id) AS root_id, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' ELSE 'modify' END AS status FROM {_at(BEFORE_LATEST)} o FULL OUTER JOIN {_at(LATEST)} n ON o.root_id = n.root_id AND o.path = n.path WHERE (o.oid, o.size, o.mode) IS DISTINCT FROM (n.oid, n.size, n.mode)")
def journal_level_diff(spark, d):
    return H.diff(_records(spark, d, back=1), _records(spark, d), "journal")


OWNED = "SELECT *, event_id % 3 AS uid, event_id % 2 AS gid, 'file' AS kind FROM {}"


@query(
    f"""SELECT root_id, path, list_aggregate(list_filter([CASE WHEN a.oid <> b.oid THEN 'payload' END, CASE WHEN a.mode <> b.mode THEN 'mode' END, CASE WHEN a.uid <> b.uid THEN 'uid' END, CASE WHEN a.gid <> b.gid THEN 'gid' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS fields
    FROM ({OWNED.format(_at(BY_SEQ.format(6)))}) a JOIN ({OWNED.format(_at(BY_SEQ.format(12)))}) b USING (root_id, path) WHERE (a.oid, a.mode, a.uid, a.gid) IS DISTINCT FROM (b.oid, b.mode, b.uid, b.gid)"""
)
def record_fields(spark, d):
    """Which fields of a record differ: payload, mode and owners."""
    own = lambda r: r.withColumns({"uid": F.col("event_id") % 3, "gid": F.col("event_id") % 2, "kind": F.lit("file")})
    return H.changed_fields(own(_records(spark, d, 6)), own(_records(spark, d, 12)), {"kind": "kind", "payload": "oid", "mode": "mode", "uid": "uid", "gid": "gid"}).select("root_id", "path", F.array_join("fields", ",").alias("fields"))


@query("SELECT event_id, root_id, s.id AS snapshot_id FROM journal j ASOF LEFT JOIN (SELECT 'r' || (seq % 4) AS root, created_at, id FROM snapshots) s ON j.root_id = s.root AND j.observed_at >= s.created_at")
def as_of_per_root(spark, d):
    """The latest snapshot of an event's own root at its time; each root has every fourth snapshot."""
    snaps = V.snapshots(spark, d).withColumn("root_id", F.concat(F.lit("r"), F.col("seq") % 4))
    return H.as_of(V.journal(spark, d).select("event_id", "root_id", "observed_at"), "observed_at", snaps, "root_id").select("event_id", "root_id", "snapshot_id")


NAMED = "('current'), ('branches/old'), ('main'), ('first'), ('latest'), ('2024-01-12')"


@query(
    f"""SELECT name, CASE WHEN name = 'first' THEN (SELECT min_by(id, seq) FROM snapshots) WHEN name = 'latest' THEN {LATEST} WHEN name = '2024-01-12' THEN (SELECT max_by(id, seq) FROM snapshots WHERE created_at <= TIMESTAMP '2024-01-12')
    ELSE (SELECT max(value) FROM refs r WHERE r.name = t.name OR r.name = 'branches/' || t.name) END AS snapshot_id FROM (VALUES {NAMED}) t(name)"""
)
def reference_resolution(spark, d):
    """References by ref, branch, end of the history or time."""
    return H.resolve(spark.createDataFrame([(x.strip("' ()"),) for x in NAMED.split(",")], "name string"), V.refs(spark, d), V.snapshots(spark, d))


@query(f"SELECT r.root_id, r.path, r.oid, b.event_id % 10 = 3 AS stored_loose, CASE WHEN b.event_id % 10 <> 3 THEN 'p' || substr(r.oid, 1, 1) END AS pack_id FROM {_at(LATEST)} r JOIN journal b ON b.oid = r.oid")
def record_pack_lookup(spark, d):
    """Where each record's payload lies: loose, or in which pack."""
    n = F.col("blob_event")
    blobs = V.journal(spark, d).select("oid", F.col("event_id").alias("blob_event"))
    packs = V.journal(spark, d).select(F.concat(F.lit("p"), F.substring("oid", 1, 1)).alias("pack_id")).distinct()
    j = _records(spark, d).join(blobs, "oid").withColumn("want", F.when(n % 10 != 3, F.concat(F.lit("p"), F.substring("oid", 1, 1))))
    return j.join(packs, F.col("want") == F.col("pack_id"), "left").select("root_id", "path", "oid", (n % 10 == 3).alias("stored_loose"), "pack_id")


@query(f"SELECT count(DISTINCT root_id) AS roots, count(*) AS files, CAST(sum(size) AS BIGINT) AS client_bytes, count(DISTINCT oid) AS payloads FROM {_at(LATEST)}")
def root_size_totals(spark, d):
    return _records(spark, d).agg(F.count_distinct("root_id").alias("roots"), F.count("*").alias("files"), F.sum("size").alias("client_bytes"), F.count_distinct("oid").alias("payloads"))


@query(f"SELECT root_id, files, client_bytes, CAST(floor(client_bytes * 100 / sum(client_bytes) OVER ()) AS BIGINT) AS percent FROM (SELECT root_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS client_bytes FROM {_at(LATEST)} GROUP BY 1)")
def root_size_report(spark, d):
    r = _records(spark, d).groupBy("root_id").agg(F.count("*").alias("files"), F.sum("size").alias("client_bytes"))
    return r.select("root_id", "files", "client_bytes", F.floor(F.col("client_bytes") * 100 / r.agg(F.sum("client_bytes")).scalar()).cast("bigint").alias("percent")).orderBy(F.desc("client_bytes"), "root_id")


@query("SELECT area, objects, bytes FROM (SELECT CASE WHEN starts_with(key, 'objects/orphan/') THEN 'orphans' WHEN starts_with(key, 'objects/') THEN 'blobs' ELSE 'large' END AS area, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM remote_objects GROUP BY 1 UNION ALL SELECT 'queue', count(*), NULL FROM upload_queue)")
def storage_areas(spark, d):
    area = F.when(F.col("key").startswith("objects/orphan/"), "orphans").when(F.col("key").startswith("objects/"), "blobs").otherwise("large")
    r = V.remote_objects(spark, d).groupBy(area.alias("area")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    return r.unionByName(V.upload_queue(spark, d).agg(F.lit("queue").alias("area"), F.count("*").alias("objects"), F.lit(None).cast("bigint").alias("bytes")))


@query(f", {REACH_SQL}, s AS (SELECT b.size, CASE WHEN substr(b.oid, 64, 1) < '8' THEN 'local' WHEN b.object_key IN (SELECT key FROM remote_objects) THEN 'archived' ELSE 'missing' END AS state FROM blobs b WHERE b.oid IN (SELECT oid FROM used)) SELECT state, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY 1")
def restore_object_stats(spark, d):
    """Objects and bytes that a restore needs, by where they are."""
    b = V.blobs(spark, d).join(_used(spark, d).select("oid").distinct(), "oid", "left_semi").select("oid", "size", F.col("object_key").alias("key"))
    local = b.where("substr(oid, 64, 1) < '8'").select("key")
    state = T.availability(b.select(F.xxhash64("key").alias("seq"), "key"), local, V.remote_objects(spark, d)).select("key", "state")
    return b.join(state, "key").groupBy("state").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query("SELECT root_id, min(snapshot_id) AS earliest, max(snapshot_id) AS latest, count(DISTINCT snapshot_id) AS snapshots FROM file_records GROUP BY 1")
def root_span(spark, d):
    """Earliest and latest snapshot of each root."""
    s = V.file_records(spark, d).select("root_id", "snapshot_id").distinct()
    return s.groupBy("root_id").agg(F.min("snapshot_id").alias("earliest"), F.max("snapshot_id").alias("latest"), F.count("*").alias("snapshots"))


@query(f", {LIVE_SQL} SELECT root_id, path FROM journal WHERE tombstone EXCEPT SELECT root_id, path FROM live")
def tombstone_paths(spark, d):
    return V.journal(spark, d).where("tombstone").select("root_id", "path").distinct().join(_live(spark, d).select("root_id", "path"), ["root_id", "path"], "left_anti")


@query(f", {REACH_SQL}, kept AS (SELECT key FROM live UNION SELECT key FROM upload_queue UNION SELECT 'objects/orphan/' || event_id FROM events WHERE event_id % 2 = 0 UNION SELECT key FROM remote_objects WHERE key LIKE 'objects/orphan/%5') SELECT key, size FROM remote_objects WHERE key NOT IN (SELECT key FROM kept)")
def gc_protected_sweep(spark, d):
    """A sweep that also spares what journal rows refer to (even event ids) and what the last mark names (orphans that end in 5)."""
    journal = V.table(spark, d, "events").where("event_id % 2 = 0").select(F.concat(F.lit("objects/orphan/"), "event_id").alias("key"))
    mark = V.remote_objects(spark, d).where(F.col("key").rlike("^objects/orphan/.*5$")).select("key")
    return T.sweep(V.remote_objects(spark, d), _live_keys(spark, d), V.upload_queue(spark, d).select("key").unionByName(journal).unionByName(mark))


@query(f", {REACH_SQL} SELECT 1 AS version, 'h1' AS host_id, {LATEST} AS current_snapshot, count(*) AS keys, min(key) AS first_key, max(key) AS last_key FROM live")
def gc_mark_build(spark, d):
    """The mark of what is live: its head, with how many keys it names."""
    current = V.snapshots(spark, d).agg(F.max_by("id", "seq")).scalar()
    a = _live_keys(spark, d).agg(F.count("*").alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    return a.select(F.lit(1).alias("version"), F.lit("h1").alias("host_id"), current.alias("current_snapshot"), "keys", "first_key", "last_key")


@query("SELECT b.oid, 'objects/' || substr(b.oid, 1, 2) || '/' || b.oid AS loose, 'blobs/loose/' || substr(b.oid, 1, 2) || '/' || b.oid AS canonical, 'large/manifests/' || b.oid AS manifest, 'hosts/h1/refs/' || substr(b.oid, 1, 4) AS ref FROM blobs b")
def key_builders(spark, d):
    return V.blobs(spark, d).select("oid", S.loose_key(F.col("oid")).alias("loose"), S.canonical_key(F.col("oid")).alias("canonical"), F.concat(F.lit("large/manifests/"), "oid").alias("manifest"), S.host_ref(F.lit("h1"), F.substring("oid", 1, 4)).alias("ref"))


@query("SELECT p_partkey, url_encode(p_name || '/é&=~_.-') AS escaped FROM part")
def uri_escape(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.uri_escape(F.concat("p_name", F.lit("/é&=~_.-"))).alias("escaped"))


@query("SELECT id, kind, before_snapshot, after_snapshot, true AS same FROM operations")
def operation_codec(spark, d):
    """Operations written as lines of a log and read back."""
    from ..sources.io import decode_operations, encode_operations

    ops = V.operations(spark, d).select("id", "kind", "before_snapshot", "after_snapshot")
    back = decode_operations(encode_operations(ops))
    same = F.struct("kind", "before_snapshot", "after_snapshot").eqNullSafe(F.col("want"))
    return back.join(ops.select("id", F.struct("kind", "before_snapshot", "after_snapshot").alias("want")), "id").select("id", "kind", "before_snapshot", "after_snapshot", same.alias("same"))


OPLOG_SQL = "a AS (SELECT id, kind, after_snapshot FROM operations WHERE seq % 6 <> 0), b AS (SELECT id, CASE WHEN seq % 5 = 0 THEN 'gc' ELSE kind END AS kind, after_snapshot FROM operations WHERE seq % 7 <> 0)"


@query(f", {OPLOG_SQL} SELECT 'op-log' AS check, {ERR}, coalesce(a.id, b.id) AS key, CASE WHEN a.id IS NULL THEN 'only-right' WHEN b.id IS NULL THEN 'only-left' ELSE 'mismatch' END AS detail FROM a FULL OUTER JOIN b ON a.id = b.id WHERE (a.kind, a.after_snapshot) IS DISTINCT FROM (b.kind, b.after_snapshot)")
def operation_log_checks(spark, d):
    """The local operation log against the remote one, with planted gaps and changes."""
    ops = V.operations(spark, d)
    b = ops.where("seq % 7 <> 0").select("id", F.when(F.col("seq") % 5 == 0, "gc").otherwise(F.col("kind")).alias("kind"), "after_snapshot")
    return I.drift(ops.where("seq % 6 <> 0").select("id", "kind", "after_snapshot"), b, "id", ["kind", "after_snapshot"], "op-log")


@query(
    f"""SELECT 'operation-rule' AS check, {ERR}, id AS key, detail FROM (SELECT id, unnest([CASE WHEN seq % 6 = 0 THEN 'unknown-kind' END, CASE WHEN seq % 5 = 0 THEN 'unknown-status' END, CASE WHEN seq % 8 = 0 THEN 'no-time' END]) AS detail FROM operations) WHERE detail IS NOT NULL"""
)
def operation_row_rules(spark, d):
    from ..operators import control as C

    n = F.col("seq")
    ops = V.operations(spark, d).select("id", F.when(n % 6 == 0, "odd").otherwise(F.col("kind")).alias("kind"), F.when(n % 5 == 0, "lost").otherwise("done").alias("status"), F.when(n % 8 != 0, F.col("created_at")).alias("created_at"))
    return I.row_rules(ops, "id", {"unknown-kind": ~F.col("kind").isin(*C.OPERATION_KINDS), "unknown-status": ~F.col("status").isin(*C.OPERATION_STATUSES), "no-time": F.col("created_at").isNull()}, "operation-rule")


@query(
    f"""SELECT 'event-rule' AS check, {ERR}, CAST(event_id AS VARCHAR) AS key, detail FROM (SELECT event_id, unnest([CASE WHEN event_id % 41 = 0 THEN 'no-path' END, CASE WHEN event_id % 43 = 0 AND event_id % 41 <> 0 THEN 'bad-path' END, CASE WHEN tombstone AND event_id % 3 = 0 THEN 'tombstone-with-payload' END]) AS detail FROM journal) WHERE detail IS NOT NULL
    UNION ALL SELECT 'restore-rule', 'error', source, detail FROM (SELECT source, unnest([CASE WHEN count(*) % 2 = 0 THEN 'unknown-status' END, CASE WHEN count(*) % 3 = 0 THEN 'done-with-pending' END]) AS detail FROM documents WHERE source IS NOT NULL GROUP BY 1) WHERE detail IS NOT NULL"""
)
def event_and_restore_rules(spark, d):
    """Rules of journal rows and of restore jobs, on rows with planted faults."""
    from ..operators import control as C

    n = F.col("event_id")
    path = F.when(n % 41 != 0, F.when(n % 43 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path")))
    ev = V.journal(spark, d).select("event_id", path.alias("path"), "tombstone", F.when(~F.col("tombstone") | (n % 3 == 0), F.col("oid")).alias("oid"))
    rules = {"no-path": F.col("path").isNull(), "bad-path": F.col("path").isNotNull() & ~P.valid_key(F.col("path")) , "tombstone-with-payload": F.col("tombstone") & F.col("oid").isNotNull()}
    j = V.table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    j = j.select("source", F.when(F.col("n") % 2 == 0, "odd").otherwise("done").alias("status"), (F.col("n") % 3 == 0).alias("pending"))
    jobs = I.row_rules(j, "source", {"unknown-status": ~F.col("status").isin(*C.JOB_STATUSES), "done-with-pending": F.col("pending")}, "restore-rule")
    return I.row_rules(ev, "event_id", rules, "event-rule").unionByName(jobs)


@query(f"SELECT 'payload-hash' AS check, {ERR}, sha256(text) AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents WHERE text IS NOT NULL AND doc_id % 11 = 0 GROUP BY 3")
def payload_rehash(spark, d):
    """Payloads read and hashed again; every eleventh has changed since."""
    docs = V.table(spark, d, "documents").where("text IS NOT NULL")
    now = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    bad = docs.select(F.sha2("text", 256).alias("oid"), F.sha2(now, 256).alias("found")).where("oid <> found").groupBy("oid").agg(F.count("*").alias("n"))
    return I.issues(bad, "payload-hash", "oid", "n")


@query(
    f"""SELECT 'remote-large-missing' AS check, {ERR}, manifest_key AS key, '' AS detail FROM large_objects WHERE manifest_key NOT IN (SELECT key FROM remote_objects)
    UNION ALL SELECT 'remote-chunk-missing', 'error', object_key, '' FROM chunks WHERE object_key NOT IN (SELECT key FROM remote_objects)
    UNION ALL SELECT 'remote-snapshot-missing', 'error', 'snapshots/' || id, '' FROM snapshots WHERE seq % 4 = 0
    UNION ALL SELECT 'remote-pack-missing', 'error', 'packs/' || p, '' FROM (SELECT DISTINCT substr(oid, 1, 1) AS p FROM blobs) WHERE p > 'c'"""
)
def remote_object_checks(spark, d):
    """Manifests, chunks, snapshots and packs that the remote lacks."""
    remote = V.remote_objects(spark, d).select("key")
    snaps = V.snapshots(spark, d).select(F.concat(F.lit("snapshots/"), "id").alias("key"), "seq")
    packs = V.blobs(spark, d).select(F.concat(F.lit("packs/"), F.substring("oid", 1, 1)).alias("key")).distinct()
    remote = remote.unionByName(snaps.where("seq % 4 <> 0").select("key")).unionByName(packs.where("key <= 'packs/c'"))
    named = {"large": V.large_objects(spark, d).select(F.col("manifest_key").alias("key")), "chunk": V.chunks(spark, d).select(F.col("object_key").alias("key")), "snapshot": snaps.select("key"), "pack": packs}
    return I.report(*(I.orphans(t, "key", remote, "key", f"remote-{n}-missing") for n, t in named.items()))


@query("SELECT key, NOT (key = '' OR starts_with(key, '/') OR contains(key, '\\') OR len(list_filter(string_split(key, '/'), lambda p: p IN ('', '.', '..'))) > 0) AS valid FROM (SELECT CASE id % 5 WHEN 0 THEN '/' || key WHEN 1 THEN key || '/' WHEN 2 THEN replace(key, '/', '/../') WHEN 3 THEN replace(key, '/', '\\') ELSE key END AS key FROM upload_queue)")
def bundle_keys(spark, d):
    """The shape of every key of a bundle."""
    n, key = F.col("id") % 5, F.col("key")
    odd = F.when(n == 0, F.concat(F.lit("/"), key)).when(n == 1, F.concat(key, F.lit("/"))).when(n == 2, F.replace(key, F.lit("/"), F.lit("/../"))).when(n == 3, F.replace(key, F.lit("/"), F.lit("\\"))).otherwise(key)
    return V.upload_queue(spark, d).select(odd.alias("key")).select("key", P.valid_key(F.col("key")).alias("valid"))


@query("SELECT name, regexp_full_match(name, '[^\\s/\\\\]+') AND NOT contains(name, '..') AND name NOT IN ('.', 'HEAD', 'current', 'current-branch', 'last-synced') AS valid FROM (SELECT CASE n_nationkey % 6 WHEN 0 THEN 'current' WHEN 1 THEN n_name || '/x' WHEN 2 THEN n_name || '..' WHEN 3 THEN n_name || ' b' WHEN 4 THEN '.' ELSE n_name || '-ok' END AS name FROM nation)")
def branch_names(spark, d):
    n, name = F.col("n_nationkey") % 6, F.col("n_name")
    given = F.when(n == 0, "current").when(n == 1, F.concat(name, F.lit("/x"))).when(n == 2, F.concat(name, F.lit(".."))).when(n == 3, F.concat(name, F.lit(" b"))).when(n == 4, ".").otherwise(F.concat(name, F.lit("-ok")))
    return V.table(spark, d, "nation").select(given.alias("name")).select("name", P.valid_branch(F.col("name")).alias("valid"))


@query("SELECT large_oid, count(*) AS chunk_count, CAST(sum(len) AS BIGINT) AS size, count(*) - count(DISTINCT chunk_oid) AS shared, 'large/manifests/' || large_oid AS manifest_key FROM large_chunks GROUP BY 1")
def large_store_plan(spark, d):
    """What storing each large object writes: its chunks once each, and a manifest."""
    c = V.large_chunks(spark, d)
    return c.groupBy("large_oid").agg(F.count("*").alias("chunk_count"), F.sum("len").alias("size"), (F.count("*") - F.count_distinct("chunk_oid")).alias("shared")).withColumn("manifest_key", F.concat(F.lit("large/manifests/"), "large_oid"))


@query("SELECT oid, oid LIKE '1%' OR (oid < '8' AND NOT oid LIKE '2%') AS pinned FROM large_objects")
def pin_changes(spark, d):
    """Pins of objects below 8, of which those with 2 are taken back and those with 1 set again."""
    large = V.large_objects(spark, d).select("oid")
    pins = large.where("oid < '8'").withColumn("pinned", F.lit(True))
    pins = M.delete(pins, F.col("oid").startswith("2"))
    pins = M.upsert(pins, large.where("startswith(oid, '1')").withColumn("pinned", F.lit(True)), ["oid"])
    return large.join(pins, "oid", "left").select("oid", F.coalesce("pinned", F.lit(False)).alias("pinned"))


@query("SELECT id, host, area FROM hosts WHERE id % 3 <> 0 UNION ALL SELECT id, lower(host), area FROM hosts WHERE id % 3 = 0")
def host_upsert(spark, d):
    h = V.hosts(spark, d)
    return M.upsert(h, h.where("id % 3 = 0").withColumn("host", F.lower("host")), ["id"])


@query("SELECT event_id, root_id, path FROM journal WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'import', path FROM journal WHERE event_id % 3 = 0 AND event_id % 2 = 0")
def journal_import(spark, d):
    """A remote journal taken in: rows with known ids are dropped, and so are repeats."""
    from ..sources.io import import_journal

    j = V.journal(spark, d).select("event_id", "root_id", "path")
    remote = j.where("event_id % 2 = 0").select("event_id", F.lit("import").alias("root_id"), "path")
    return import_journal(j.where("event_id % 3 <> 0"), remote.unionByName(remote))


@query(", t AS (SELECT event_id AS id, size FROM journal WHERE event_id % 3 <> 0), n AS (SELECT event_id AS id, size + 1 AS size FROM journal WHERE event_id % 4 = 0) SELECT id, size FROM t WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, size FROM n")
def metadata_import(spark, d):
    """An imported table replaces rows of the same id."""
    from ..sources.io import import_rows

    j = V.journal(spark, d)
    return import_rows(j.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), "size"), j.where("event_id % 4 = 0").select(F.col("event_id").alias("id"), (F.col("size") + 1).alias("size")), ["id"])


@query(f", {REACH_SQL} SELECT key, CASE WHEN key IN (SELECT key FROM remote_objects) THEN 'fetch' ELSE 'missing' END AS action FROM live WHERE substr(key, length(key), 1) >= '8'")
def hydrate_plan(spark, d):
    """What to fetch: needed keys without a local copy (those that end in 8 or more) that the remote has."""
    live = _live_keys(spark, d)
    need = T.missing(live, live.where(F.substring("key", -1, 1) < "8"))
    there = V.remote_objects(spark, d).select("key", F.lit(True).alias("there")).distinct()
    return need.join(there, "key", "left").select("key", F.when(F.col("there"), "fetch").otherwise("missing").alias("action"))


@query("SELECT root_id, dir, file_count FROM (SELECT root_id, dir, count(*) AS file_count FROM (SELECT root_id, unnest(['', split_part(path, '/', 1)]) AS dir FROM LATEST_RECORDS) GROUP BY 1, 2) WHERE dir = '' OR file_count >= 2".replace("LATEST_RECORDS", _at(LATEST)))
def subtree_index(spark, d):
    """Nodes of folders with two records or more below them, and of the roots."""
    return H.tree_rollup(_records(spark, d)).where("dir = '' OR file_count >= 2").select("root_id", "dir", "file_count")


@query(f"SELECT DISTINCT root_id, split_part(path, '/', 1) AS host FROM {_at(LATEST)} UNION SELECT 'remote', host FROM hosts")
def host_discovery(spark, d):
    """Hosts named by keys and by the table of hosts."""
    seen = _records(spark, d).select("root_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("host"))
    return seen.unionByName(V.hosts(spark, d).select(F.lit("remote").alias("root_id"), "host")).distinct()


@query(f"SELECT r.root_id, count(*) AS files, count(*) FILTER (j.event_id % 10 = 3) AS degraded, CASE WHEN count(*) FILTER (j.event_id % 50 = 3) > 0 THEN 'unprotected' WHEN count(*) FILTER (j.event_id % 10 = 3) > 0 THEN 'degraded' ELSE 'protected' END AS state FROM {_at(LATEST)} r JOIN journal j ON r.oid = j.oid GROUP BY 1")
def root_health(spark, d):
    """State of each root from the worst of its records: some payloads are not stored twice, some not at all."""
    r = _records(spark, d)
    once, lost = r.where("event_id % 10 = 3").select("oid", F.lit("warning").alias("w")), r.where("event_id % 50 = 3").select("oid", F.lit("error").alias("e"))
    j = r.join(once.distinct(), "oid", "left").join(lost.distinct(), "oid", "left")
    g = j.groupBy("root_id").agg(F.count("*").alias("files"), F.count("w").alias("degraded"), F.count("e").alias("lost"))
    return g.select("root_id", "files", "degraded", F.when(F.col("lost") > 0, "unprotected").when(F.col("degraded") > 0, "degraded").otherwise("protected").alias("state"))
