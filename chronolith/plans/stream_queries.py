"""Journal operators applied to the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import journal as J
from ..streaming import watch as W
from . import views as V

J_SQL = ", j AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'snapshot-finish' WHEN event_id % 31 = 0 THEN 'event-journal-replay' ELSE kind END AS k FROM journal)"


def _journal(spark, d):
    kind = F.when(F.col("event_id") % 97 == 0, J.FINISH).when(F.col("event_id") % 31 == 0, "event-journal-replay").otherwise(F.col("kind"))
    return V.journal(spark, d).withColumn("kind", kind).withColumn("synced_at", F.when(F.col("event_id") % 2 == 0, F.col("observed_at")))


LAST = "(SELECT max(observed_at) FROM j WHERE k = 'snapshot-finish')"
OTHERS = "('snapshot-finish', 'event-journal-replay')"


@query(f"{J_SQL} SELECT count(*) AS total, count(*) FILTER (k NOT IN {OTHERS} AND observed_at > {LAST}) AS pending, count(*) FILTER (k NOT IN {OTHERS} AND observed_at <= {LAST}) AS processed, count(*) FILTER (k = 'snapshot-finish') AS finishes FROM j")
def journal_stats(spark, d):
    return J.stats(_journal(spark, d))


@query(f"{J_SQL} SELECT event_id, k AS kind FROM j WHERE k NOT IN {OTHERS} AND observed_at > {LAST} AND event_id % 2 <> 0")
def journal_pending_unsynced(spark, d):
    return J.pending(_journal(spark, d), synced=True).select("event_id", "kind")


@query(
    f"""{J_SQL}, c AS (SELECT max(observed_at) AS latest, min(observed_at) AS second FROM (SELECT DISTINCT observed_at FROM j WHERE k = 'snapshot-finish' ORDER BY 1 DESC LIMIT 2))
    SELECT event_id, k AS kind FROM j, c WHERE NOT ((k NOT IN {OTHERS} AND observed_at < latest) OR (k IN {OTHERS} AND observed_at < second))"""
)
def journal_compaction(spark, d):
    return J.compacted(_journal(spark, d)).select("event_id", "kind")


SESSION_SQL = """s AS (SELECT root_id, event_id, observed_at, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY root_id ORDER BY observed_at, event_id) AS session FROM (
    SELECT *, coalesce(epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY root_id ORDER BY observed_at, event_id)) >= 3600000000, true) AS opens FROM journal))"""


@query(f", {SESSION_SQL} SELECT root_id, CAST(session AS BIGINT) AS session, count(*) AS events, min_by(event_id, observed_at) AS first_id, max_by(event_id, observed_at) AS last_id FROM s GROUP BY 1, 2")
def gap_sessions(spark, d):
    return J.gap_sessions(V.journal(spark, d), "root_id", 3600)


@query(
    """, s AS (SELECT path, tombstone, observed_at, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY path ORDER BY observed_at, event_id) AS session FROM (
    SELECT *, coalesce(epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY path ORDER BY observed_at, event_id)) > 43200000000, true) AS opens FROM journal))
    SELECT path, min(epoch_us(observed_at)) AS start_us, count(*) AS events, count(*) FILTER (tombstone) AS deletes FROM s GROUP BY path, session"""
)
def session_windows(spark, d):
    return J.windowed(V.journal(spark, d), "path", "12 hours")


@query(
    """, e AS (SELECT root_id AS key, epoch_us(observed_at) // 1000 AS t, row_number() OVER (PARTITION BY root_id ORDER BY epoch_us(observed_at) // 1000) AS n, count(*) OVER (PARTITION BY root_id) AS total FROM journal),
    w AS (SELECT key, n, total, t, t AS start, CAST(1 AS BIGINT) AS cnt, false AS full_up, CAST(NULL AS BIGINT) AS s0, CAST(NULL AS BIGINT) AS n0, CAST(NULL AS BIGINT) AS e0, CAST(NULL AS VARCHAR) AS r0 FROM e WHERE n = 1
      UNION ALL SELECT key, n, total, t, CASE WHEN joins THEN start ELSE t END, CASE WHEN joins THEN cnt + 1 ELSE 1 END, joins AND cnt + 1 >= 20, CASE WHEN closes THEN start END, CASE WHEN closes THEN cnt END, CASE WHEN closes THEN last - start END, CASE WHEN closes THEN CASE WHEN t - last >= 3600000 THEN 'quiet' ELSE 'max-latency' END END
      FROM (SELECT e.key, e.n, e.total, e.t, w.t AS last, w.start, w.cnt, NOT w.full_up AND (e.t - w.t >= 3600000 OR e.t - w.start >= 18000000) AS closes, NOT w.full_up AND e.t - w.t < 3600000 AND e.t - w.start < 18000000 AS joins FROM e JOIN w ON e.key = w.key AND e.n = w.n + 1))
    SELECT key, s0 AS start_ms, n0 AS events, e0 AS elapsed_ms, r0 AS reason FROM w WHERE r0 IS NOT NULL UNION ALL SELECT key, start, cnt, t - start, 'max-events' FROM w WHERE full_up UNION ALL SELECT key, start, cnt, t - start, 'quiet' FROM w WHERE n = total AND NOT full_up"""
)
def capped_gap_batches(spark, d):
    """Batches closed by a quiet hour, five hours or twenty events."""
    return J.capped_batches(V.journal(spark, d), "root_id", J.GapBuffer(3_600_000, 18_000_000, 20))


@query(", h AS (SELECT root_id, epoch_us(date_trunc('hour', observed_at)) AS hour_us, kind FROM journal) SELECT root_id, hour_us, kind, count(*) AS n FROM h GROUP BY 1, 2, 3")
def streamed_hourly_counts(spark, d):
    """A stream over the events, run to its end, as a table of hourly counts."""
    # a glob, as a file stream takes a plain path for a folder
    source = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    rows = source.select(F.concat(F.lit("r"), F.col("user_id") % 4).alias("root_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify").alias("kind"))
    counted = rows.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour").alias("w"), "root_id", "kind").agg(F.count("*").alias("n"))
    name = f"hourly_{uuid.uuid4().hex}"
    running = counted.select("root_id", F.unix_micros("w.start").alias("hour_us"), "kind", "n").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


@query(f"{J_SQL} SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM j WHERE k NOT IN {OTHERS} AND observed_at > {LAST} HAVING count(*) > 0")
def replay_pending(spark, d):
    return W.replay(_journal(spark, d))


@query(f"{J_SQL}, m AS (SELECT max(floor(epoch(observed_at))) AS now FROM j), g AS (SELECT root_id, count(*) AS pending, min(floor(epoch(observed_at))) AS oldest FROM j WHERE k NOT IN {OTHERS} AND observed_at > {LAST} AND event_id % 2 <> 0 GROUP BY 1) SELECT root_id, pending, CAST(now - oldest AS BIGINT) AS oldest_age FROM g, m WHERE now - oldest >= 300")
def stalled_roots(spark, d):
    j = _journal(spark, d)
    now = j.agg(F.max(F.unix_timestamp(F.col("observed_at").cast("timestamp")))).scalar()
    return W.stalled(j, now)


@query(f"{J_SQL} SELECT event_id, event_id % 2 = 0 OR event_id % 3 = 0 AS synced FROM j")
def journal_acknowledged(spark, d):
    """Every third event has come to the remote journal; those of even ids were acknowledged before."""
    j = _journal(spark, d)
    up = j.where("event_id % 3 = 0").select("event_id", F.col("observed_at").alias("uploaded_at"))
    return W.acknowledged(j, up.unionByName(up)).select("event_id", F.col("synced_at").isNotNull().alias("synced"))


@query(
    """, t AS (SELECT DISTINCT root_id, CAST(floor(epoch(observed_at)) AS BIGINT) AS sec FROM journal), m AS (SELECT max(sec) + 20000 AS top FROM t),
    g AS (SELECT root_id, sec, coalesce(lead(sec) OVER (PARTITION BY root_id ORDER BY sec), (SELECT top FROM m)) AS nxt FROM t)
    SELECT root_id, tick AS "at" FROM g, LATERAL (SELECT unnest(range(sec + 3600, nxt, 3600)) AS tick)"""
)
def periodic_rescans(spark, d):
    """Rescans that fall due an hour after the last event or rescan of a root."""
    j = V.journal(spark, d)
    top = j.agg(F.max(F.unix_timestamp(F.col("observed_at").cast("timestamp"))) + 20000).scalar()
    return W.idle_ticks(j, 3600, top)


@query("SELECT CAST(root_id AS VARCHAR) AS key, epoch_us(observed_at) // 1000 AS start_ms, CAST(1 AS BIGINT) AS events, 'max-events' AS reason FROM journal")
def strict_batches(spark, d):
    """A batch for every event."""
    return J.capped_batches(V.journal(spark, d), "root_id", W.strict()).select("key", "start_ms", "events", "reason")


HEALTH_SQL = "st AS (SELECT root_id AS host, CAST(floor(epoch(observed_at)) AS BIGINT) AS sec, CASE event_id % 5 WHEN 0 THEN 'protected' WHEN 1 THEN 'unprotected' ELSE 'degraded' END AS state, CAST(event_id % 3 AS VARCHAR) AS codes, row_number() OVER (PARTITION BY root_id ORDER BY floor(epoch(observed_at)), event_id) AS n FROM journal WHERE event_id % 4 = 0)"


@query(
    f""", {HEALTH_SQL}, w AS (
      SELECT host, n, state, CASE WHEN state = 'protected' THEN NULL ELSE state || codes END AS last, CASE WHEN state <> 'protected' THEN sec END AS last_at, state <> 'protected' AS sent FROM st WHERE n = 1
      UNION ALL SELECT s.host, s.n, s.state,
        CASE WHEN s.state = 'protected' THEN NULL WHEN w.last IS DISTINCT FROM s.state || s.codes OR s.sec - w.last_at >= 43200 THEN s.state || s.codes ELSE w.last END,
        CASE WHEN s.state = 'protected' THEN NULL WHEN w.last IS DISTINCT FROM s.state || s.codes OR s.sec - w.last_at >= 43200 THEN s.sec ELSE w.last_at END,
        s.state <> 'protected' AND (w.last IS DISTINCT FROM s.state || s.codes OR s.sec - w.last_at >= 43200)
      FROM st s JOIN w ON s.host = w.host AND s.n = w.n + 1)
    SELECT host, state, count(*) AS records, count(*) FILTER (sent) AS notices FROM w GROUP BY 1, 2"""
)
def health_notices(spark, d):
    """Changes of health that are told: not the same within half a day, and nothing of a protected host."""
    n = F.col("event_id")
    at = F.unix_timestamp(F.col("observed_at").cast("timestamp"))
    state = F.when(n % 5 == 0, "protected").when(n % 5 == 1, "unprotected").otherwise("degraded")
    r = V.journal(spark, d).where(n % 4 == 0).select(F.col("root_id").alias("host"), at.alias("at"), state.alias("state"), (n % 3).cast("string").alias("codes"))
    return W.health_notices(r, 43200).groupBy("host", "state").agg(F.count("*").alias("records"), F.count_if("sent").alias("notices"))


@query("SELECT (SELECT max(seq) FROM snapshots) - 8 AS lag, (SELECT count(*) FROM upload_queue WHERE attempts = 4) AS queued, (SELECT max(seq) FROM snapshots) - 8 <= 100 AND (SELECT count(*) FROM upload_queue WHERE attempts = 4) = 0 AS caught_up")
def sync_catchup(spark, d):
    s = V.snapshots(spark, d)
    return W.caught_up(s, s.where("seq <= 8"), V.upload_queue(spark, d).where("attempts = 4"), 100)


@query("SELECT (SELECT count(*) FROM blobs) AS checked, (SELECT count(*) FROM blobs WHERE object_key NOT IN (SELECT key FROM remote_objects)) AS missing, false AS limited, (SELECT count(*) FROM upload_queue) AS queued, (SELECT count(*) FROM upload_queue WHERE attempts > 0) AS retrying")
def sync_status(spark, d):
    return W.sync_status(V.blobs(spark, d).select(F.col("object_key").alias("key")), V.remote_objects(spark, d), V.upload_queue(spark, d))


@query("SELECT concat_ws(chr(9), root_id, CAST(count(*) AS VARCHAR), '-') AS line FROM journal GROUP BY root_id")
def report_lines(spark, d):
    """A report as tab-separated lines; a null shows as a dash."""
    from ..sources.plugins import as_lines

    r = V.journal(spark, d).groupBy("root_id").agg(F.count("*").alias("n")).withColumn("note", F.lit(None).cast("string"))
    return as_lines(r)


@query("SELECT root_id, path, size * 2 AS doubled FROM journal WHERE kind = 'create'")
def visited_records(spark, d):
    """A visitor's view of the records."""
    from ..sources.plugins import visit

    rows = V.journal(spark, d).select("root_id", "path", "kind", "size")
    return visit(rows, lambda r: {"root_id": r["root_id"], "path": r["path"], "doubled": r["size"] * 2} if r["kind"] == "create" else None, "root_id string, path string, doubled bigint")
