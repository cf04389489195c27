"""Control operators applied to the derived views: operations, branches, jobs, queues, notices, coverage, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import coverage as O
from ..operators import history as H
from ..operators import storage as T
from ..registry import query
from . import views as V
from .history_queries import BY_SEQ, LATEST, LIVE_SQL, _at, _live, _records

KINDS = str(C.CHANGE_KINDS)
#: Operations with the columns that only a fixture has.
OPS_SQL = """ops AS (SELECT *, CASE WHEN seq % 7 = 0 THEN 'running' WHEN seq % 11 = 0 THEN 'failed' ELSE 'done' END AS status, seq % 2 = 0 AS alive,
  CASE WHEN seq % 5 = 0 THEN 'app' END AS origin_label, CASE WHEN seq % 5 < 2 THEN 's' || seq END AS origin_session, CASE WHEN seq % 5 = 2 THEN seq * 10 END AS origin_pid,
  CASE WHEN seq % 3 = 0 THEN 'daemon' END AS own_label, CASE WHEN seq % 4 = 0 THEN 'watch journal replay' ELSE 'watch flush' END AS message,
  CASE WHEN seq % 13 = 0 THEN after_snapshot ELSE before_snapshot END AS was FROM operations)"""


def _ops(spark, d):
    n = F.col("seq")
    return V.operations(spark, d).select(
        "*",
        F.when(n % 7 == 0, "running").when(n % 11 == 0, "failed").otherwise("done").alias("status"),
        (n % 2 == 0).alias("alive"),
        F.when(n % 5 == 0, "app").alias("origin_label"),
        F.when(n % 5 < 2, F.concat(F.lit("s"), n)).alias("origin_session"),
        F.when(n % 5 == 2, n * 10).alias("origin_pid"),
        F.when(n % 3 == 0, "daemon").alias("own_label"),
        F.when(n % 4 == 0, "watch journal replay").otherwise("watch flush").alias("message"),
        F.when(n % 13 == 0, F.col("after_snapshot")).otherwise(F.col("before_snapshot")).alias("was"),
    )


def _changing(spark, d):
    return C.changing(_ops(spark, d).drop("before_snapshot").withColumnRenamed("was", "before_snapshot"))


CHANGING = f"(SELECT * FROM ops WHERE kind IN {KINDS} AND after_snapshot IS NOT NULL AND was IS DISTINCT FROM after_snapshot)"


@query(f", {OPS_SQL} SELECT id, kind, after_snapshot FROM {CHANGING}")
def change_operations(spark, d):
    return _changing(spark, d).select("id", "kind", "after_snapshot")


@query(f", {OPS_SQL} SELECT id, seq FROM {CHANGING} ORDER BY seq DESC LIMIT 7 OFFSET 5")
def recent_change_page(spark, d):
    """The second page of recent changes."""
    return C.newest(_changing(spark, d), 7, 5).select("id", F.col("seq").cast("bigint").alias("seq"))


@query(f", {OPS_SQL} SELECT id, seq FROM ops ORDER BY seq DESC LIMIT 20")
def recent_operations(spark, d):
    return C.newest(_ops(spark, d)).select("id", F.col("seq").cast("bigint").alias("seq"))


@query(f", {OPS_SQL} SELECT count(*) AS n FROM {CHANGING}")
def change_operation_count(spark, d):
    return _changing(spark, d).agg(F.count("*").alias("n"))


@query("SELECT max_by(id, seq) AS id FROM operations")
def current_operation(spark, d):
    return C.current_operation(V.operations(spark, d))


@query("SELECT id AS op_id, coalesce(before_snapshot, after_snapshot) AS snapshot_id FROM operations")
def undo_pointers(spark, d):
    return C.undo_pointer(V.operations(spark, d))


@query(f", {OPS_SQL} SELECT id, CASE WHEN status = 'running' AND epoch(created_at) < (SELECT max(epoch(created_at)) FROM ops) - 600 AND NOT alive THEN 'failed' ELSE status END AS status FROM ops")
def stale_operations(spark, d):
    ops = _ops(spark, d)
    now = ops.agg(F.max(F.unix_timestamp(F.col("created_at").cast("timestamp")))).scalar()
    return C.stale_running(ops.withColumn("created_at", F.col("created_at").cast("timestamp")), now).select("id", "status")


@query(
    f""", {OPS_SQL} SELECT id, coalesce(origin_label || ':' || origin_session, origin_session, 'origin-pid:' || origin_pid,
    CASE WHEN kind = 'file-events-batch' AND own_label = 'daemon' THEN CASE WHEN contains(message, 'journal replay') THEN 'unattributed:watch-replay' ELSE 'unattributed:watch' END END, '-') AS origin,
    coalesce(own_label || ':' || origin_session, origin_session, 'pid:' || origin_pid, '-') AS session FROM ops"""
)
def operation_labels(spark, d):
    c = F.col
    origin = C.origin_label(c("origin_label"), c("origin_session"), c("origin_pid"), c("kind"), c("own_label"), c("message"))
    return _ops(spark, d).select("id", origin.alias("origin"), C.session_label(c("own_label"), c("origin_session"), c("origin_pid")).alias("session"))


@query(f", {OPS_SQL} SELECT kind, status, count(*) AS n, kind IN {C.OPERATION_KINDS} AS valid_kind, status IN {C.OPERATION_STATUSES} AS valid_status FROM (SELECT CASE WHEN seq % 6 = 0 THEN 'odd' ELSE kind END AS kind, CASE WHEN seq % 9 = 0 THEN 'lost' ELSE status END AS status FROM ops) GROUP BY 1, 2")
def label_checks(spark, d):
    n = F.col("seq")
    odd = _ops(spark, d).select(F.when(n % 6 == 0, "odd").otherwise(F.col("kind")).alias("kind"), F.when(n % 9 == 0, "lost").otherwise(F.col("status")).alias("status"))
    return odd.groupBy("kind", "status").agg(F.count("*").alias("n")).select("*", F.col("kind").isin(*C.OPERATION_KINDS).alias("valid_kind"), F.col("status").isin(*C.OPERATION_STATUSES).alias("valid_status"))


@query("SELECT id, created_at >= (SELECT created_at FROM snapshots WHERE seq = 12) AS recent, id = (SELECT max_by(id, seq) FROM snapshots) AS current FROM snapshots WHERE created_at >= (SELECT created_at FROM snapshots WHERE seq = 12) OR id = (SELECT max_by(id, seq) FROM snapshots)")
def snapshots_since(spark, d):
    """Snapshots from the time of the twelfth on, and the current one."""
    s = V.snapshots(spark, d)
    cut, last = s.where("seq = 12").select(F.max("created_at")).scalar(), s.agg(F.max_by("id", "seq")).scalar()
    t = s.select("id", F.coalesce(F.col("created_at") >= cut, F.lit(False)).alias("recent"), (F.col("id") == last).alias("current"))
    return t.where("recent OR current")


@query(
    f"""SELECT name, value FROM (VALUES ('branches/feature'), ('branches/trunk'), ('branches/old'), ('current'), ('current-branch')) t(name),
    LATERAL (SELECT CASE name WHEN 'branches/feature' THEN {BY_SEQ.format(7)} WHEN 'branches/trunk' THEN {LATEST} WHEN 'branches/old' THEN {BY_SEQ.format(9)} WHEN 'current' THEN {BY_SEQ.format(9)} ELSE 'old' END AS value)"""
)
def branch_changes(spark, d):
    """A branch made, one renamed, one switched to and moved with the current ref, one made and deleted."""
    s = {r.seq: r.id for r in V.snapshots(spark, d).where("seq IN (3, 7, 9)").select("seq", "id").collect()}  # three rows
    r = V.refs(spark, d).unionByName(spark.createDataFrame([(C.ACTIVE, "main")], "name string, value string"))
    r = C.create_branch(r, "feature", s[7])
    r = C.rename_branch(r, "main", "trunk")
    r = C.switch_branch(r, "old")
    r = C.set_head(r, "old", s[9])
    return C.delete_branch(C.create_branch(r, "short", s[3]), "short")


@query(
    f""", {LIVE_SQL}, w AS {_at("(SELECT id FROM snapshots WHERE seq = 5)")}
    SELECT w.root_id, w.path, CASE WHEN l.oid IS NULL THEN 'restore' WHEN l.oid = w.oid THEN 'keep' ELSE 'modify' END AS action FROM w LEFT JOIN live l ON w.root_id = l.root_id AND w.path = l.path
    UNION ALL SELECT root_id, path, 'delete' FROM live l WHERE root_id IN (SELECT root_id FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE w.root_id = l.root_id AND w.path = l.path)"""
)
def branch_switch_plan(spark, d):
    """Switching to the branch ``old`` with a restore: the plan of its head."""
    refs = C.switch_branch(V.refs(spark, d), "old")
    head = refs.where("name = 'current'").join(V.snapshots(spark, d), F.col("value") == F.col("id")).select("seq").first()[0]
    return H.restore_plan(_records(spark, d, head), _live(spark, d))


@query(f", {LIVE_SQL} SELECT w.root_id, w.path FROM {_at(BY_SEQ.format(10))} w JOIN live l ON w.root_id = l.root_id AND w.path = l.path WHERE w.oid <> l.oid")
def restore_conflicts(spark, d):
    return O.conflicts(_records(spark, d, 10), _live(spark, d))


REQUIRED_SQL = """req AS (SELECT source AS job, 'objects/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS key, sha256(text) AS oid FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
st AS (SELECT DISTINCT job, key, substr(oid, 64, 1) AS last, CASE WHEN substr(oid, 64, 1) < '6' THEN 'local' WHEN oid LIKE 'a%' THEN 'missing' ELSE 'archived' END AS state FROM req)"""


def _required(spark, d):
    docs = V.table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select(F.col("source").alias("job"), F.sha2("text", 256).alias("oid"))
    key = F.concat(F.lit("objects/"), F.substring("oid", 1, 2), F.lit("/"), "oid")
    state = F.when(F.substring("oid", 64, 1) < "6", "local").when(F.col("oid").startswith("a"), "missing").otherwise("archived")
    return docs.select("job", key.alias("key"), state.alias("state")).distinct()


JOB_SQL = "SELECT job, count(*) AS n_required, count(*) FILTER ({archived}) AS n_archived, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER ({requested}) AS n_requested, {status} AS status FROM st GROUP BY job"


def _counted(jobs):
    n = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return jobs.select("job", n("required"), n("archived"), n("missing"), n("requested"), "status")


@query(f", {REQUIRED_SQL} {JOB_SQL.format(archived="state = 'archived'", requested='false', status="'prepared'")}")
def restore_jobs(spark, d):
    return _counted(C.restore_jobs(_required(spark, d), "job"))


ASKED = "state = 'archived' AND last < 'c'"


@query(f", {REQUIRED_SQL} {JOB_SQL.format(archived="state = 'archived'", requested=ASKED, status=f"CASE WHEN count(*) FILTER ({ASKED}) > 0 THEN 'archive-requested' ELSE 'prepared' END")}")
def restore_archive_requests(spark, d):
    """The store takes requests for keys that end below c."""
    return _counted(C.request_archives(C.restore_jobs(_required(spark, d), "job"), lambda k: F.substring(k, -1, 1) < "c"))


LEFT = "state = 'archived' AND last >= 'e'"


@query(
    f""", {REQUIRED_SQL}, x AS ({JOB_SQL.format(archived=LEFT, requested=LEFT + " AND last < 'c'", status=f"CASE WHEN count(*) FILTER ({LEFT}) = 0 THEN 'ready' WHEN count(*) FILTER ({ASKED}) > 0 THEN 'archive-requested' ELSE 'prepared' END")})
    SELECT job, CASE WHEN n_archived = 0 AND n_missing = 0 THEN 'done' ELSE status END AS status, CASE WHEN n_missing > 0 THEN 'missing objects: ' || n_missing WHEN n_archived > 0 THEN 'archived objects pending: ' || n_archived END AS blocked FROM x"""
)
def restore_job_states(spark, d):
    """Jobs whose keys that end below e have come, and what still blocks the others."""
    jobs = C.request_archives(C.restore_jobs(_required(spark, d), "job"), lambda k: F.substring(k, -1, 1) < "c")
    return C.finish(C.hydrate(jobs, lambda k: F.substring(k, -1, 1) < "e")).select("job", "status", "blocked")


@query("SELECT id, host, CASE WHEN l IS NULL AND r IS NULL THEN 'no snapshot' WHEN r IS NULL THEN 'not synced' WHEN l IS NULL THEN 'remote only' WHEN l = r THEN 'synced' ELSE 'lagging' END AS state FROM (SELECT id, host, CASE WHEN id % 5 <> 0 THEN (SELECT id FROM snapshots s WHERE s.seq = hosts.id % 3 + 1) END AS l, CASE WHEN id % 4 <> 0 THEN (SELECT id FROM snapshots s WHERE s.seq = hosts.id % 2 + 1) END AS r FROM hosts)")
def remote_heads(spark, d):
    """Each host's current snapshot against the one known of the remote."""
    s = V.snapshots(spark, d).select(F.col("seq"), F.col("id").alias("snap"))
    h = V.hosts(spark, d)
    local, remote = s.select(F.col("seq").alias("ls"), F.col("snap").alias("l")), s.select(F.col("seq").alias("rs"), F.col("snap").alias("r"))
    j = h.join(local, F.when(F.col("id") % 5 != 0, F.col("id") % 3 + 1) == F.col("ls"), "left").join(remote, F.when(F.col("id") % 4 != 0, F.col("id") % 2 + 1) == F.col("rs"), "left")
    return j.select("id", "host", C.head_status(F.col("l"), F.col("r")).alias("state"))


@query("SELECT area, count(*) AS hosts, string_agg(host, ',' ORDER BY host, id) AS names FROM hosts GROUP BY 1")
def hosts_sorted(spark, d):
    """Hosts of an area by name, then id."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("host", "id"))), lambda x: x.host)
    return V.hosts(spark, d).groupBy("area").agg(F.count("*").alias("hosts"), F.array_join(each, ",").alias("names"))


QUEUE_STATE = """CASE WHEN p = 0 THEN 'clear' WHEN q > 0 THEN 'syncing' WHEN age >= 300 THEN 'stalled' ELSE 'processing' END"""


@query(f", m AS (SELECT max(epoch(observed_at)) AS now FROM journal), r AS (SELECT root_id, count(*) FILTER (event_id % 3 = 0) AS p, CAST(floor((SELECT now FROM m)) - floor(min(epoch(observed_at)) FILTER (event_id % 3 = 0)) AS BIGINT) AS age, count(*) FILTER (event_id % 3 = 0 AND root_id = 'r1') AS q FROM journal GROUP BY 1) SELECT root_id, p AS pending, age AS oldest_age, q AS queued, {QUEUE_STATE} AS state FROM r")
def daemon_stats(spark, d):
    """Pending events (every third) of each root, the age of the oldest and the state that follows; uploads wait for root r1."""
    at = F.unix_timestamp(F.col("observed_at").cast("timestamp"))
    j = V.journal(spark, d).select("root_id", at.alias("at"), (F.col("event_id") % 3 == 0).alias("open"))
    g = j.groupBy("root_id").agg(F.count_if("open").alias("pending"), F.min(F.when(F.col("open"), F.col("at"))).alias("oldest"), F.count_if(F.col("open") & (F.col("root_id") == "r1")).alias("queued"))
    g = g.withColumn("oldest_age", j.agg(F.max("at")).scalar() - F.col("oldest"))
    return g.select("root_id", "pending", "oldest_age", "queued", C.pending_state(F.col("pending"), F.col("oldest_age"), F.col("queued")).alias("state"))


@query(", r AS (SELECT root_id, CASE root_id WHEN 'r0' THEN 'active' WHEN 'r1' THEN 'paused' WHEN 'r2' THEN 'deleted' ELSE 'missing' END AS status, count(*) FILTER (tombstone) AS issues FROM journal GROUP BY 1) SELECT root_id, status, issues, CASE status WHEN 'active' THEN 1 WHEN 'paused' THEN 2 WHEN 'deleted' THEN 3 ELSE 0 END AS rank, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r WHERE status = 'active') AS active FROM r")
def root_list(spark, d):
    status = F.when(F.col("root_id") == "r0", "active").when(F.col("root_id") == "r1", "paused").when(F.col("root_id") == "r2", "deleted").otherwise("missing")
    r = V.journal(spark, d).groupBy("root_id").agg(F.count_if("tombstone").alias("issues")).select("root_id", status.alias("status"), "issues", C.root_rank(status).alias("rank"))
    return r.withColumns({"total": r.agg(F.count("*")).scalar(), "active": r.agg(F.count_if(F.col("status") == "active")).scalar()}).orderBy("rank", "root_id")


@query("SELECT root_id, max_by(kind, (observed_at, event_id)) AS kind, max_by(size, (observed_at, event_id)) AS detail FROM journal WHERE kind IN ('create', 'delete') GROUP BY 1")
def latest_by_kind(spark, d):
    """Of two kinds of events the latest decides each root's status."""
    last = F.max_by(F.struct("kind", "size"), F.struct("observed_at", "event_id"))
    return V.journal(spark, d).where(F.col("kind").isin("create", "delete")).groupBy("root_id").agg(last.alias("x")).select("root_id", "x.kind", F.col("x.size").alias("detail"))


@query("SELECT id, key, attempts, priority, rank, outcome, attempts + CAST(outcome = 'retry' AS INT) AS next_attempts FROM (SELECT *, CASE WHEN rank // 64 > (SELECT min(rank // 64) FROM q WHERE failed) THEN 'waiting' WHEN failed THEN 'retry' ELSE 'done' END AS outcome FROM q)".replace("SELECT id", ", p AS (SELECT *, CASE WHEN key LIKE 'refs/%' THEN 3 WHEN key LIKE 'metadata/%' THEN 2 ELSE 1 END AS priority, id % 400 = 3 AS failed FROM upload_queue), q AS (SELECT *, row_number() OVER (ORDER BY priority, key) - 1 AS rank FROM p) SELECT id", 1))
def queue_drain(spark, d):
    """One pass, 64 at a time; every fourhundredth item fails."""
    q = V.upload_queue(spark, d).select("id", "key", "attempts")
    return C.drain(q, F.col("id") % 400 == 3, T.publish_priority(F.col("key")), 64)


@query(
    """, ordered AS (SELECT root_id, CAST(floor(epoch(observed_at)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY root_id ORDER BY floor(epoch(observed_at)), event_id) AS n FROM journal WHERE tombstone),
    w AS (SELECT root_id, sec, n, sec AS last, true AS sent FROM ordered WHERE n = 1 UNION ALL
      SELECT o.root_id, o.sec, o.n, CASE WHEN o.sec - w.last >= 3600 THEN o.sec ELSE w.last END, o.sec - w.last >= 3600 FROM ordered o JOIN w ON o.root_id = w.root_id AND o.n = w.n + 1)
    SELECT root_id, count(*) AS alerts, count(*) FILTER (sent) AS notices FROM w GROUP BY 1"""
)
def notice_rate(spark, d):
    """An alert a tombstone; a notice for it at most once an hour a root."""
    at = F.unix_timestamp(F.col("observed_at").cast("timestamp")).alias("at")
    sent = C.notices(V.journal(spark, d).where("tombstone").select("root_id", at), ["root_id"])
    return sent.groupBy("root_id").agg(F.count("*").alias("alerts"), F.count_if("sent").alias("notices"))


@query("SELECT key, starts_with(key, 'metadata/') OR starts_with(key, 'trees/') OR starts_with(key, 'large/manifests/') OR starts_with(key, 'indexes/') OR contains(key, '/metadata/') OR contains(key, '/refs/') OR contains(key, '/journal/') OR contains(key, '/ops/') OR contains(key, '/snapshots/') AS hot FROM (SELECT key FROM upload_queue UNION ALL SELECT 'h1/ops/' || id FROM operations UNION ALL SELECT key FROM remote_objects)")
def hot_metadata(spark, d):
    keys = V.upload_queue(spark, d).select("key").unionByName(V.operations(spark, d).select(F.concat(F.lit("h1/ops/"), "id").alias("key"))).unionByName(V.remote_objects(spark, d).select("key"))
    return keys.select("key", O.hot_metadata(F.col("key")).alias("hot"))


EVENT_SQL = "ev AS (SELECT event_id, root_id, CASE WHEN event_id % 17 = 0 THEN '.git/index.lock' WHEN event_id % 19 = 0 THEN path || '/.git/HEAD' ELSE path END AS path, CASE WHEN event_id % 23 = 0 THEN 'access' ELSE kind END AS kind FROM journal)"


def _raw_events(spark, d):
    n = F.col("event_id")
    path = F.when(n % 17 == 0, ".git/index.lock").when(n % 19 == 0, F.concat("path", F.lit("/.git/HEAD"))).otherwise(F.col("path"))
    return V.journal(spark, d).select("event_id", "root_id", path.alias("path"), F.when(n % 23 == 0, "access").otherwise(F.col("kind")).alias("kind"))


@query(f", {EVENT_SQL} SELECT event_id, path FROM ev WHERE kind <> 'access' AND path <> '.git/index.lock'")
def relevant_events(spark, d):
    return _raw_events(spark, d).where(O.relevant(F.col("kind"), F.col("path"))).select("event_id", "path")


@query(
    f""", {EVENT_SQL}, roots(root_path, of_root) AS (VALUES ('/data/r0', 'r0'), ('/data/r1', 'r1'), ('/data/r1/u', 'r1u')),
    n AS (SELECT event_id, '/data/' || root_id || '/' || path AS abs_path, CASE WHEN kind IN ('create', 'modify', 'delete') THEN CASE kind WHEN 'delete' THEN 'remove' ELSE kind END ELSE 'access' END AS kind FROM ev)
    SELECT event_id, kind, of_root, substr(abs_path, length(root_path) + 2) AS path FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY length(root_path) DESC) AS rn FROM n JOIN roots ON starts_with(abs_path, root_path || '/')) WHERE rn = 1"""
)
def file_events(spark, d):
    """Raw events with absolute paths become rows of root, relative path and kind, by the deepest of the roots above them."""
    from ..streaming import journal as J

    roots = spark.createDataFrame([("/data/r0", "r0"), ("/data/r1", "r1"), ("/data/r1/u", "r1u")], "root_path string, of_root string")
    raw = _raw_events(spark, d).select("event_id", F.array(F.concat(F.lit("/data/"), "root_id", F.lit("/"), "path")).alias("paths"), "kind")
    return J.file_events(raw, roots).select("event_id", "kind", "of_root", "path")


COVER_T = "(SELECT created_at FROM snapshots WHERE seq = 10)"


@query(
    f""", {LIVE_SQL}, df AS (SELECT coalesce(o.root_id, n.root_id) AS root_id, coalesce(o.path, n.path) AS path, n.oid FROM {_at(BY_SEQ.format(10))} o FULL OUTER JOIN live n ON o.root_id = n.root_id AND o.path = n.path WHERE o.oid IS DISTINCT FROM n.oid)
    SELECT root_id, path FROM df WHERE EXISTS (SELECT 1 FROM journal e WHERE e.root_id = df.root_id AND e.path = df.path AND observed_at > {COVER_T} AND (event_id % 9 = 0 OR CASE WHEN df.oid IS NULL THEN tombstone ELSE e.oid = df.oid END))"""
)
def live_coverage(spark, d):
    """Live differences from snapshot 10 that a later event covers; every ninth event waits for its upload."""
    t = V.snapshots(spark, d).where("seq = 10").select("created_at").first()[0]
    old, live = _records(spark, d, 10).select("root_id", "path", F.col("oid").alias("was")), _live(spark, d).select("root_id", "path", "oid")
    changed = old.join(live, ["root_id", "path"], "full_outer").where(~F.col("was").eqNullSafe(F.col("oid"))).select("root_id", "path", "oid")
    events = V.journal(spark, d).withColumn("synced_at", F.when(F.col("event_id") % 9 != 0, F.col("observed_at")))
    return O.live_covered(changed, events, F.lit(t)).select("root_id", "path")


@query(f", r AS {_at(BY_SEQ.format(10))} SELECT j.event_id, CASE WHEN j.tombstone THEN r.path IS NULL ELSE coalesce(r.oid = j.oid, false) END AS covered FROM journal j LEFT JOIN r ON j.root_id = r.root_id AND j.path = r.path")
def snapshot_coverage(spark, d):
    t = V.snapshots(spark, d).where("seq = 10").select("created_at").first()[0]
    return O.snapshot_covered(V.journal(spark, d), _records(spark, d, 10), F.lit(t)).select("event_id", "covered")


@query("SELECT b.object_key AS key, coalesce(a.key, k.key) AS found, coalesce(a.size, k.size) AS size FROM blobs b LEFT JOIN (SELECT 'objects/' || substr(oid, 1, 2) || '/' || oid AS of_key, 'blobs/loose/' || oid AS key, size FROM blobs WHERE oid LIKE '_3%') a ON a.of_key = b.object_key LEFT JOIN remote_objects k ON k.key = b.object_key")
def candidate_probe(spark, d):
    """For each blob the alias in the new layout (there for ids with a 3 in the second place), else the old key, else nothing."""
    b = V.blobs(spark, d)
    alias = b.where("substr(oid, 2, 1) = '3'").select(F.concat(F.lit("blobs/loose/"), "oid").alias("key"), "size")
    names = F.array(F.concat(F.lit("blobs/loose/"), F.substring_index("key", "/", -1)), F.col("key"))
    return O.first_present(b.select(F.col("object_key").alias("key")), names, alias.unionByName(V.remote_objects(spark, d)))


@query("SELECT object_key AS key FROM blobs WHERE substr(oid, 2, 1) = '3' AND substr(oid, 64, 1) >= '8'")
def alias_without_local(spark, d):
    """Blobs whose alias the remote has while there is no local copy (those that end in 8 or more)."""
    b = V.blobs(spark, d).select("oid", F.col("object_key").alias("key"), F.concat(F.lit("blobs/loose/"), "oid").alias("alias"))
    remote, local = b.where("substr(oid, 2, 1) = '3'").select("alias"), b.where("substr(oid, 64, 1) < '8'").select("key")
    return b.join(remote, "alias", "left_semi").join(local, "key", "left_anti").select("key")


@query("SELECT host, scope, count(DISTINCT key) AS keys FROM (SELECT 'h' || (ascii(oid) % 3) AS host, CASE WHEN size > 2000 THEN 'history' ELSE 'current' END AS scope, object_key AS key FROM blobs UNION ALL SELECT 'h1', 'history', 'large/chunks/' || chunk_oid FROM large_chunks) GROUP BY 1, 2")
def host_key_sets(spark, d):
    """Keys that hosts refer to, now or in their history."""
    b = V.blobs(spark, d).select(F.concat(F.lit("h"), F.ascii("oid") % 3).alias("host"), F.when(F.col("size") > 2000, "history").otherwise("current").alias("scope"), F.col("object_key").alias("key"))
    c = V.large_chunks(spark, d).select(F.lit("h1").alias("host"), F.lit("history").alias("scope"), F.concat(F.lit("large/chunks/"), "chunk_oid").alias("key"))
    return b.unionByName(c).distinct().groupBy("host", "scope").agg(F.count("*").alias("keys"))


@query("SELECT count(*) FILTER (k = 'payload') AS payloads, CAST(coalesce(sum(size) FILTER (k = 'payload'), 0) AS BIGINT) AS payload_bytes, count(*) FILTER (k = 'metadata') AS metadata, CAST(coalesce(sum(size) FILTER (k = 'metadata'), 0) AS BIGINT) AS metadata_bytes FROM (SELECT size, CASE WHEN starts_with(key, 'objects/') OR starts_with(key, 'large/chunks/') THEN 'payload' ELSE 'metadata' END AS k FROM remote_objects)")
def cache_prune_stats(spark, d):
    """Count and bytes of payloads and of metadata that a prune would take."""
    payload = T.category(F.col("key")).isin("payload", "chunk")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("bigint")
    return V.remote_objects(spark, d).agg(F.count_if(payload).alias("payloads"), n(payload).alias("payload_bytes"), F.count_if(~payload).alias("metadata"), n(~payload).alias("metadata_bytes"))


@query("SELECT CASE WHEN attempts = 0 THEN 'PUT' WHEN attempts < 3 THEN 'HEAD' ELSE 'GET' END AS request, count(*) AS requests, CAST(sum(attempts + 1) AS BIGINT) AS tries, CAST(sum(CAST(round(weight) AS BIGINT)) AS BIGINT) AS bytes FROM upload_queue GROUP BY 1")
def traffic_metrics(spark, d):
    kind = F.when(F.col("attempts") == 0, "PUT").when(F.col("attempts") < 3, "HEAD").otherwise("GET")
    return V.upload_queue(spark, d).groupBy(kind.alias("request")).agg(F.count("*").alias("requests"), F.sum(F.col("attempts") + 1).alias("tries"), F.sum(F.round("weight").cast("bigint")).alias("bytes"))


@query(f", t AS (SELECT DISTINCT root_id, path FROM journal WHERE event_id % 2 = 0), u AS (SELECT DISTINCT root_id, path FROM journal WHERE event_id % 13 = 0) SELECT root_id, path FROM (SELECT * FROM t UNION SELECT root_id, path FROM {_at(BY_SEQ.format(10))}) EXCEPT SELECT * FROM u")
def known_paths(spark, d):
    j = V.journal(spark, d)
    return O.known_paths(j.where("event_id % 2 = 0"), _records(spark, d, 10), j.where("event_id % 13 = 0").select("root_id", "path").distinct())


@query(f", {LIVE_SQL}, u AS (SELECT DISTINCT root_id, path FROM journal WHERE event_id % 13 = 0) SELECT root_id, path FROM (SELECT root_id, path FROM {_at(BY_SEQ.format(1))} UNION SELECT root_id, path FROM live UNION SELECT root_id, path FROM journal WHERE tombstone) EXCEPT SELECT * FROM u")
def lifecycle_paths(spark, d):
    """Tracked, first snapshot's and deleted paths without untracked ones."""
    j = V.journal(spark, d)
    first = _records(spark, d, 1).select("root_id", "path").unionByName(j.where("tombstone").select("root_id", "path"))
    return O.known_paths(_live(spark, d), first, j.where("event_id % 13 = 0").select("root_id", "path").distinct())


@query("SELECT DISTINCT root_id FROM file_records UNION SELECT DISTINCT root_id FROM journal WHERE tombstone")
def plan_roots(spark, d):
    return V.file_records(spark, d).select("root_id").unionByName(V.journal(spark, d).where("tombstone").select("root_id")).distinct().orderBy("root_id")


@query(
    f""", {LIVE_SQL}, m AS (SELECT root_id, path FROM live WHERE CAST(substr(split_part(path, '/', 1), 2) AS INT) % 3 = 0 AND path LIKE '%/p1'), l AS (SELECT root_id, path FROM live EXCEPT SELECT * FROM m)
    SELECT DISTINCT l.root_id, CASE WHEN x.dir IS NULL THEN split_part(path, '/', 1) ELSE path END AS path, x.dir IS NULL AS is_dir FROM l LEFT JOIN (SELECT DISTINCT root_id, split_part(path, '/', 1) AS dir FROM m) x ON x.root_id = l.root_id AND x.dir = split_part(l.path, '/', 1)"""
)
def untracked_state(spark, d):
    """Rows of what isn't managed; a folder with nothing managed stands for all below it."""
    live = _live(spark, d).select("root_id", "path")
    managed = live.where("CAST(substring(split_part(path, '/', 1), 2) AS INT) % 3 = 0 AND endswith(path, '/p1')")
    return O.untracked_rows(live, managed)


@query(", old AS (SELECT DISTINCT 'p' || substr(oid, 1, 2) AS id FROM blobs), new AS (SELECT DISTINCT 'p' || substr(oid, 1, 2) AS id FROM blobs WHERE size > 1500) SELECT id FROM old EXCEPT SELECT id FROM new")
def packs_to_delete(spark, d):
    pack = F.concat(F.lit("p"), F.substring("oid", 1, 2)).alias("id")
    old, new = V.blobs(spark, d).select(pack).distinct(), V.blobs(spark, d).where("size > 1500").select(pack).distinct()
    return old.join(new, "id", "left_anti")


@query("SELECT key, (SELECT count(*) > 50 FROM remote_objects) AS limited FROM remote_objects ORDER BY key LIMIT 50")
def sampled_keys(spark, d):
    """The first fifty keys, as a sampling check takes them; the sample is the feature."""
    return O.sampled(V.remote_objects(spark, d).select("key"), 50)


@query("SELECT root_id, CAST(count(*) AS BIGINT) AS kept, CAST(count(*) FILTER (drop) AS BIGINT) AS dropped, count(DISTINCT snapshot_id) FILTER (drop) AS rewritten FROM (SELECT *, path LIKE '%/p3' AS drop FROM file_records) GROUP BY 1")
def forget_unmanaged(spark, d):
    """What forgetting the paths that are no longer managed (those in p3) does to all snapshots."""
    r = V.file_records(spark, d).withColumn("drop", F.col("path").endswith("/p3"))
    return r.groupBy("root_id").agg(F.count("*").alias("kept"), F.count_if("drop").alias("dropped"), F.count_distinct(F.when(F.col("drop"), F.col("snapshot_id"))).alias("rewritten"))


@query("SELECT snapshot_id, root_id, count(*) AS file_count FROM file_records WHERE NOT path LIKE '%/p3' GROUP BY 1, 2")
def rewritten_snapshots(spark, d):
    """All versions without the unmanaged paths, with new tree ids."""
    return H.tree_ids(V.file_records(spark, d).where(~F.col("path").endswith("/p3"))).select("snapshot_id", "root_id", "file_count")


@query("SELECT a, b, greatest(coalesce(a, b), coalesce(b, a)) AS latest, coalesce(a, b) AS first_known FROM (SELECT CASE WHEN event_id % 3 <> 0 THEN event_id END AS a, CASE WHEN event_id % 4 <> 0 THEN event_id * 7 % 1000 END AS b FROM events)")
def order_times(spark, d):
    e = V.table(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("a"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 7 % 1000).alias("b"))
    return e.select("a", "b", F.greatest("a", "b").alias("latest"), F.coalesce("a", "b").alias("first_known"))


@query("SELECT doc_id, CASE WHEN n_chars > 8192 THEN 'large' WHEN doc_id % 10 = 0 THEN 'symlink' ELSE 'blob' END AS kind, CASE WHEN n_chars > 8192 OR doc_id % 10 <> 0 THEN sha256(text) END AS oid, CASE WHEN n_chars > 8192 THEN 'large/manifests/' || sha256(text) WHEN doc_id % 10 <> 0 THEN 'objects/' || sha256(text) END AS key FROM documents WHERE text IS NOT NULL")
def payload_accessors(spark, d):
    """Kind, object id and key of payloads by variant; links have neither id nor key."""
    from ..functions import scalars as S

    docs = V.table(spark, d, "documents").where("text IS NOT NULL")
    kind = F.when(F.col("n_chars") > V.LARGE, "large").when(F.col("doc_id") % 10 == 0, "symlink").otherwise("blob")
    p = docs.select("doc_id", F.struct(kind.alias("kind"), F.sha2("text", 256).alias("oid")).alias("payload"))
    return p.select("doc_id", "payload.kind", S.payload_oid(F.col("payload")).alias("oid"), S.payload_key(F.col("payload")).alias("key"))
