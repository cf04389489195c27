"""History operators applied to the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..registry import query
from ..steps import small
from . import views as V

def _at(snapshot: str) -> str:
    """SQL for the records of one snapshot, from the events before it alone."""
    return f"""(SELECT root_id, path, oid, size, mode, event_id, CAST(floor(epoch(observed_at)) AS BIGINT) AS modified FROM (
    SELECT *, row_number() OVER (PARTITION BY root_id, path ORDER BY observed_at DESC, event_id DESC) AS rn FROM journal WHERE observed_at < (SELECT created_at FROM snapshots WHERE id = {snapshot})) WHERE rn = 1 AND NOT tombstone)"""


def _diff_sql(old: str, new: str) -> str:
    return f"""
  SELECT coalesce(o.root_id, n.root_id) AS root_id, coalesce(o.path, n.path) AS path,
         CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN (o.oid, o.size, o.mode) IS DISTINCT FROM (n.oid, n.size, n.mode) THEN 'M' END AS status
  FROM {_at(old)} o FULL OUTER JOIN {_at(new)} n ON o.root_id = n.root_id AND o.path = n.path"""


BY_SEQ = "(SELECT id FROM snapshots WHERE seq = {})"
LATEST = "(SELECT max_by(id, seq) FROM snapshots)"
BEFORE_LATEST = "(SELECT max_by(parent_id, seq) FROM snapshots)"
LAST_DIFF = _diff_sql(BEFORE_LATEST, LATEST)
CHANGES_SQL = """
changes AS (
  SELECT snapshot_id, root_id, path, status FROM (
    SELECT s.id AS snapshot_id, root_id, path, 'A' AS status FROM file_records n JOIN snapshots s ON n.snapshot_id = s.id
      WHERE NOT EXISTS (SELECT 1 FROM file_records o WHERE o.snapshot_id = s.parent_id AND o.root_id = n.root_id AND o.path = n.path)
    UNION ALL SELECT s.id, n.root_id, n.path, 'M' FROM file_records n JOIN snapshots s ON n.snapshot_id = s.id
      JOIN file_records o ON o.snapshot_id = s.parent_id AND o.root_id = n.root_id AND o.path = n.path WHERE (o.oid, o.size, o.mode) IS DISTINCT FROM (n.oid, n.size, n.mode)
    UNION ALL SELECT s.id, o.root_id, o.path, 'D' FROM file_records o JOIN snapshots s ON o.snapshot_id = s.parent_id
      WHERE NOT EXISTS (SELECT 1 FROM file_records n WHERE n.snapshot_id = s.id AND o.root_id = n.root_id AND o.path = n.path)))"""
LAST_EVENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id, path ORDER BY observed_at DESC, event_id DESC) AS rn FROM journal{}) WHERE rn = 1)"
LIVE_SQL = f"live AS (SELECT root_id, path, oid, size, mode, CAST(floor(epoch(observed_at)) AS BIGINT) AS modified FROM {LAST_EVENT.format('')} WHERE NOT tombstone)"


def _records(spark, d, seq=None, latest=False, back=0):
    """Records of one snapshot, by sequence number or counted back from the latest."""
    snaps = V.snapshots(spark, d)
    if seq is None:
        seq = snaps.agg(F.max("seq")).first()[0] - back
    row = snaps.where(F.col("seq") == seq).select("created_at").first()
    return V.snapshot_records(spark, d, row[0]) if row else V.snapshot_records(spark, d, None)


def _live(spark, d):
    return H.latest_events(V.journal(spark, d)).where("NOT tombstone").withColumn("modified", F.unix_timestamp(F.col("observed_at").cast("timestamp")))


@query("SELECT snapshot_id, root_id, path, oid, size, mode, modified FROM file_records")
def file_records(spark, d):
    return V.file_records(spark, d).select("snapshot_id", "root_id", "path", "oid", "size", "mode", "modified")


@query("SELECT id, parent_id, op_id, seq FROM snapshots WHERE seq = 3")
def snapshot_header(spark, d):
    return snapshot_headers(spark, d).where("seq = 3")


@query("SELECT id, parent_id, op_id, seq FROM snapshots")
def snapshot_headers(spark, d):
    """Of every snapshot."""
    return V.snapshots(spark, d).select("id", "parent_id", "op_id", F.col("seq").cast("bigint").alias("seq"))


@query("SELECT id, kind, before_snapshot, after_snapshot FROM operations")
def operation_log(spark, d):
    return V.operations(spark, d).select("id", "kind", "before_snapshot", "after_snapshot")


@query(f"SELECT * FROM ({LAST_DIFF}) WHERE status IS NOT NULL")
def snapshot_diff(spark, d):
    return H.diff(_records(spark, d, back=1), _records(spark, d))


@query(f"SELECT root_id, count(*) AS total, count(*) FILTER (status = 'A') AS n_added, count(*) FILTER (status = 'M') AS n_modified, count(*) FILTER (status = 'D') AS n_deleted FROM ({LAST_DIFF}) WHERE status IS NOT NULL GROUP BY 1")
def snapshot_diff_counts(spark, d):
    return H.status_counts(H.diff(_records(spark, d, back=1), _records(spark, d)), "root_id")


@query(f", {CHANGES_SQL} SELECT * FROM changes")
def operation_changes(spark, d):
    return H.consecutive_changes(V.file_records(spark, d), V.snapshots(spark, d))


@query(f", {CHANGES_SQL} SELECT o.id AS op_id, o.kind, count(*) AS total, count(*) FILTER (status = 'A') AS n_added, count(*) FILTER (status = 'M') AS n_modified, count(*) FILTER (status = 'D') AS n_deleted FROM changes c JOIN operations o ON c.snapshot_id = o.after_snapshot GROUP BY 1, 2")
def change_log(spark, d):
    ops = V.operations(spark, d).select(F.col("id").alias("op_id"), "kind", F.col("after_snapshot").alias("snapshot_id"))
    changes = H.consecutive_changes(V.file_records(spark, d), V.snapshots(spark, d))
    return H.status_counts(changes.join(small(ops), "snapshot_id"), "op_id", "kind")


@query(
    f""", {CHANGES_SQL}, sized AS (SELECT snapshot_id, root_id, count(*) AS n FROM changes GROUP BY 1, 2)
    SELECT snapshot_id, root_id, NULL AS path, 'M' AS status, n FROM sized WHERE n > 40 UNION ALL
    SELECT c.snapshot_id, c.root_id, path, status, 1 FROM changes c JOIN sized s ON c.snapshot_id = s.snapshot_id AND c.root_id = s.root_id WHERE n <= 40"""
)
def folded_log(spark, d):
    return H.folded(H.consecutive_changes(V.file_records(spark, d), V.snapshots(spark, d)), ["snapshot_id", "root_id"], 40)


@query(
    f""", {CHANGES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, root_id ORDER BY path) AS n FROM changes)
    SELECT snapshot_id, root_id, path, status FROM ranked WHERE n <= 30 UNION ALL
    SELECT snapshot_id, root_id, '(+' || (count(*) - 30) || ' more)', 'M' FROM changes GROUP BY 1, 2 HAVING count(*) > 30"""
)
def capped_summary(spark, d):
    return H.capped(H.consecutive_changes(V.file_records(spark, d), V.snapshots(spark, d)), ["snapshot_id", "root_id"], 30)


@query(f"SELECT * FROM ({_diff_sql(BY_SEQ.format(6), BY_SEQ.format(7))}) WHERE status IS NOT NULL AND root_id = 'r1' AND (path = 'u1' OR starts_with(path, 'u1/') OR path = 'u5' OR starts_with(path, 'u5/')) AND status IN ('A', 'M')")
def operation_diff_filtered(spark, d):
    """The operation that made snapshot 7, one root, two pathspecs, two statuses; filters go before the join."""
    from ..functions.paths import matches_specs

    def side(seq):
        return _records(spark, d, seq).where((F.col("root_id") == "r1") & matches_specs(F.col("path"), ["./u1/", "u5"]))

    return H.diff(side(6), side(7)).where(F.col("status").isin("A", "M"))


@query("SELECT event_id, s.id AS snapshot_id FROM journal j ASOF LEFT JOIN snapshots s ON j.observed_at >= s.created_at")
def as_of_join(spark, d):
    return H.as_of(V.journal(spark, d).select("event_id", "observed_at"), "observed_at", V.snapshots(spark, d)).select("event_id", "snapshot_id")


@query("SELECT root_id, min(snapshot_id) AS first_snapshot FROM file_records GROUP BY 1")
def first_snapshot_per_root(spark, d):
    return H.first_snapshots(V.file_records(spark, d), V.snapshots(spark, d))


@query(
    """, t AS (SELECT snapshot_id, root_id, md5(string_agg(path || oid || size || mode, ',' ORDER BY path)) AS tree FROM file_records GROUP BY 1, 2),
    m AS (SELECT *, tree IS DISTINCT FROM lag(tree) OVER (PARTITION BY root_id ORDER BY snapshot_id) AS new FROM t)
    SELECT root_id, max(snapshot_id) AS last_change FROM m WHERE new GROUP BY 1"""
)
def last_change_per_root(spark, d):
    return H.last_changes(V.file_records(spark, d), V.snapshots(spark, d))


@query("SELECT snapshot_id, root_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM file_records GROUP BY 1, 2")
def root_snapshots(spark, d):
    return H.tree_ids(V.file_records(spark, d)).drop("tree_id")


@query(f", up AS (SELECT id, parent_id, CAST(0 AS BIGINT) AS depth FROM snapshots WHERE id = {LATEST} UNION ALL SELECT s.id, s.parent_id, depth + 1 FROM snapshots s JOIN up ON s.id = up.parent_id) SELECT id, depth FROM up")
def snapshot_lineage(spark, d):
    snaps = V.snapshots(spark, d)
    return H.lineage(snaps, snaps.agg(F.max_by("id", "seq")).first()[0])


@query(
    f""", won AS {LAST_EVENT.format(" WHERE observed_at > (SELECT created_at FROM snapshots WHERE seq = 5) AND observed_at <= (SELECT created_at FROM snapshots WHERE seq = 8)")}
    SELECT root_id, path, oid, size, mode FROM {_at(BY_SEQ.format(5))} r WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.root_id = r.root_id AND w.path = r.path)
    UNION ALL SELECT root_id, path, oid, size, mode FROM won WHERE NOT tombstone"""
)
def restore_overlay(spark, d):
    """Snapshot 5 with the durable events up to the time of snapshot 8."""
    t = {r[0]: r[1] for r in V.snapshots(spark, d).where("seq IN (5, 8)").select("seq", "created_at").collect()}  # two rows
    return H.overlay(_records(spark, d, 5), V.journal(spark, d), F.lit(t[5]), F.lit(t[8]))


STATE_SQL = f"""
  SELECT coalesce(o.root_id, n.root_id) AS root_id, coalesce(o.path, n.path) AS path,
         CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN o.oid <> n.oid THEN 'M' WHEN (o.size, o.mode) IS DISTINCT FROM (n.size, n.mode) THEN 'm' END AS status,
         CAST(n.modified AS VARCHAR) AS order_time
  FROM {_at(BY_SEQ.format(20))} o FULL OUTER JOIN live n ON o.root_id = n.root_id AND o.path = n.path"""


@query(f", {LIVE_SQL} SELECT * FROM ({STATE_SQL}) WHERE status IS NOT NULL")
def state_vs_reference(spark, d):
    return H.state(_live(spark, d), _records(spark, d, 20)).withColumn("order_time", F.col("order_time").cast("string"))


@query(f", {LIVE_SQL} SELECT * FROM ({STATE_SQL}) WHERE status IS NOT NULL AND (order_time IS NULL OR CAST(order_time AS BIGINT) >= 1706000000)")
def state_since(spark, d):
    return H.state(_live(spark, d), _records(spark, d, 20), F.lit(1706000000)).withColumn("order_time", F.col("order_time").cast("string"))


@query(
    f""", {LIVE_SQL}, firsts AS (SELECT root_id, min(snapshot_id) AS s FROM file_records GROUP BY 1),
    base AS (SELECT r.* FROM file_records r JOIN firsts f ON r.root_id = f.root_id AND r.snapshot_id = f.s)
    SELECT coalesce(o.root_id, n.root_id) AS root_id, coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'D' WHEN o.path IS NOT NULL AND o.oid <> n.oid THEN 'M' ELSE 'A' END AS status
    FROM base o FULL OUTER JOIN live n ON o.root_id = n.root_id AND o.path = n.path"""
)
def state_lifecycle(spark, d):
    records, snaps = V.file_records(spark, d), V.snapshots(spark, d)
    first = records.join(H.first_snapshots(records, snaps), "root_id").where("snapshot_id = first_snapshot")
    return H.lifecycle_state(first, _live(spark, d))


@query(
    f""", {LIVE_SQL}, w AS (SELECT * FROM {_at(BY_SEQ.format(10))} WHERE root_id IN ('r0', 'r2'))
    SELECT w.root_id, w.path, CASE WHEN l.oid IS NULL THEN 'restore' WHEN l.oid = w.oid THEN 'keep' ELSE 'modify' END AS action FROM w LEFT JOIN live l ON w.root_id = l.root_id AND w.path = l.path
    UNION ALL SELECT root_id, path, 'delete' FROM live l WHERE root_id IN (SELECT root_id FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE w.root_id = l.root_id AND w.path = l.path)"""
)
def restore_plan(spark, d):
    return H.restore_plan(_records(spark, d, 10).where(F.col("root_id").isin("r0", "r2")), _live(spark, d))


@query(
    f""", {LIVE_SQL}, w AS {_at(BY_SEQ.format(10))}
    SELECT w.root_id, w.path, CASE WHEN l.oid IS NULL THEN 'restore' WHEN l.oid = w.oid THEN 'keep' ELSE 'modify' END AS action FROM w LEFT JOIN live l ON w.root_id = l.root_id AND w.path = l.path
    UNION ALL SELECT root_id, path, 'delete' FROM live l WHERE root_id IN (SELECT root_id FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE w.root_id = l.root_id AND w.path = l.path)"""
)
def restore_plan_all_roots(spark, d):
    return H.restore_plan(_records(spark, d, 10), _live(spark, d))


@query(
    f""", {LIVE_SQL}, w AS {_at(BY_SEQ.format(10))}
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN l.oid IS NULL THEN 'restore' WHEN l.oid = w.oid THEN 'keep' ELSE 'modify' END AS action FROM w LEFT JOIN live l ON w.root_id = l.root_id AND w.path = l.path
    UNION ALL SELECT 'delete' FROM live l WHERE root_id IN (SELECT root_id FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE w.root_id = l.root_id AND w.path = l.path)) GROUP BY 1"""
)
def restore_counts(spark, d):
    return H.restore_plan(_records(spark, d, 10), _live(spark, d)).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT root_id, path, CAST(floor(epoch(min(observed_at))) AS BIGINT) AS first_seen, CAST(floor(epoch(max(observed_at))) AS BIGINT) AS last_seen, max_by(tombstone, observed_at) AS untracked, count(*) AS n_events FROM journal GROUP BY 1, 2")
def tracked_paths(spark, d):
    return H.tracked_paths(V.journal(spark, d))


ANCESTORS = f"(SELECT root_id, size, oid, mode, path, unnest(['', split_part(path, '/', 1)]) AS dir FROM {{}})"


@query(f"SELECT root_id, dir, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM {ANCESTORS.format(_at(LATEST))} GROUP BY 1, 2")
def tree_rollup(spark, d):
    return H.tree_rollup(_records(spark, d))


@query(
    f""", a AS (SELECT root_id, dir, md5(string_agg(path || oid || size || mode, ',' ORDER BY path)) AS node FROM {ANCESTORS.format(_at(BEFORE_LATEST))} GROUP BY 1, 2),
    b AS (SELECT root_id, dir, md5(string_agg(path || oid || size || mode, ',' ORDER BY path)) AS node FROM {ANCESTORS.format(_at(LATEST))} GROUP BY 1, 2)
    SELECT root_id, dir FROM a FULL OUTER JOIN b USING (root_id, dir) WHERE a.node IS DISTINCT FROM b.node"""
)
def merkle_diff(spark, d):
    return H.changed_dirs(_records(spark, d, back=1), _records(spark, d))


@query("SELECT id, op_id FROM snapshots WHERE seq = 1")
def id_prefix_lookup(spark, d):
    """By the upper-cased head of the first snapshot's id; ids of one day are alone with it."""
    snaps = V.snapshots(spark, d)
    first = snaps.agg(F.min("id")).first()[0]
    return H.id_prefix(snaps, first.upper()).select("id", "op_id")


@query("SELECT r.name, r.value, s.seq, o.id AS op_id FROM refs r JOIN snapshots s ON r.value = s.id JOIN operations o ON o.after_snapshot = s.id")
def branch_list(spark, d):
    snaps, ops = V.snapshots(spark, d).select("id", F.col("seq").cast("bigint").alias("seq")), V.operations(spark, d).select(F.col("id").alias("op_id"), "after_snapshot")
    return V.refs(spark, d).join(snaps, F.col("value") == F.col("id")).join(ops, F.col("after_snapshot") == F.col("value")).select("name", "value", "seq", "op_id")
