"""The watch loop as stream pieces: strict and periodic triggers, replay, coverage, notices, queue passes, catch-up and status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import control
from . import journal as J

RESCAN = "periodic-rescan"


def strict() -> J.GapBuffer:
    """A buffer that closes a batch at every event."""
    return J.GapBuffer(quiet_ms=0, max_latency_ms=0, max_events=1)


def periodic(spark, every_seconds: int, key: str = "root_id", value: str | None = None) -> DataFrame:
    """A stream of ``periodic-rescan`` events, one each ``every_seconds``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % every_seconds == 0)
    return ticks.select(F.col("value").alias("event_id"), F.lit(value).alias(key), F.lit(RESCAN).alias("kind"), F.col("timestamp").alias("observed_at"))


def idle_ticks(rows: DataFrame, every: int, until: Column) -> DataFrame:
    """The batch form: at (seconds) of the rescans that fall due ``every`` seconds after the last event or rescan, up to ``until``."""
    at = F.unix_timestamp(F.col("observed_at").cast("timestamp"))
    from pyspark.sql import Window

    t = rows.select("root_id", at.alias("at")).distinct()
    w = Window.partitionBy("root_id").orderBy("at")
    gap = t.select("root_id", "at", F.coalesce(F.lead("at").over(w), until).alias("next"))
    due = gap.where(F.col("next") - F.col("at") >= every)
    # a rescan on the next event's second comes with it, so only times before it are due
    return due.select("root_id", F.explode(F.sequence(F.col("at") + every, F.col("next"), F.lit(every).cast("bigint"))).alias("at"), "next").where(F.col("at") < F.col("next")).select("root_id", "at")


def replay(rows: DataFrame) -> DataFrame:
    """One ``event-journal-replay`` batch if triggers came after the last finish: n, first_id and last_id of them; else no row."""
    left = J.pending(rows).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return left.where("n > 0")


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events whose key and payload did not come before within the watermark; a live difference already sent isn't sent again."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["root_id", "path", "oid"])


def acknowledged(rows: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Journal rows with synced_at set where the remote journal has their event_id (durable upload and its acknowledgement)."""
    done = uploaded.groupBy("event_id").agg(F.min("uploaded_at").alias("uploaded_at"))
    return rows.join(done, "event_id", "left").withColumn("synced_at", F.coalesce("synced_at", "uploaded_at")).drop("uploaded_at").select(*rows.columns)


def stalled(rows: DataFrame, now: Column) -> DataFrame:
    """root_id, pending, oldest_age of the roots whose oldest pending event is too old, and whose alert is due."""
    left = J.pending(rows, synced=True)
    g = left.groupBy("root_id").agg(F.count("*").alias("pending"), F.min(F.unix_timestamp(F.col("observed_at").cast("timestamp"))).alias("oldest"))
    return g.select("root_id", "pending", (now - F.col("oldest")).alias("oldest_age")).where(F.col("oldest_age") >= control.STALLED_AFTER)


def health_notices(states: DataFrame, every: int = control.NOTICE_EVERY) -> DataFrame:
    """Health records (host, at, state, codes) with ``sent``: told unless the same state and codes went out within ``every`` seconds.

    ``protected`` is never told and forgets what was sent. A host's records stream in order through one task.
    """
    names = states.columns
    at = {c: names.index(c) for c in ("host", "at", "state", "codes")}

    def run(batches):
        import pyarrow as pa

        host, last = None, None
        for b in batches:
            h, t, s, c = (b.column(at[k]).to_pylist() for k in ("host", "at", "state", "codes"))
            out = []
            for x, when, state, codes in zip(h, t, s, c, strict=True):
                if x != host:
                    host, last = x, None
                if state == "protected":
                    last = None
                    out.append(False)
                    continue
                sent = last is None or last[:2] != (state, codes) or when - last[2] >= every
                last = (state, codes, when) if sent else last
                out.append(sent)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*names, "sent"])

    return states.repartition("host").sortWithinPartitions("host", "at").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in states.dtypes) + ", sent boolean")


def caught_up(local: DataFrame, remote: DataFrame, queued: DataFrame, allowed_lag: int = 0) -> DataFrame:
    """One row: whether the remote has the current snapshot (or lags by at most ``allowed_lag`` in seq) and no upload waits."""
    lag = local.agg(F.max("seq").alias("l")).select("l", F.lit(remote.agg(F.max("seq")).scalar()).alias("r"), F.lit(queued.agg(F.count("*")).scalar()).alias("queued"))
    return lag.select((F.col("l") - F.coalesce("r", F.lit(0))).cast("bigint").alias("lag"), "queued", ((F.col("l") - F.coalesce("r", F.lit(0)) <= allowed_lag) & (F.col("queued") == 0)).alias("caught_up"))


def sync_status(wanted: DataFrame, present: DataFrame, queue: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: checked, missing, limited, queued and retrying; a sample checks the first keys in order."""
    from ..operators.coverage import sampled

    asked = wanted.select("key").distinct()
    asked = asked.withColumn("limited", F.lit(False)) if sample is None else sampled(asked, sample)
    met = asked.join(present.select("key", F.lit(True).alias("there")).distinct(), "key", "left")
    q = queue.agg(F.count("*").alias("queued"), F.count_if(F.col("attempts") > 0).alias("retrying"))
    s = met.agg(F.count("*").alias("checked"), F.count_if(F.col("there").isNull()).alias("missing"), F.coalesce(F.max("limited"), F.lit(False)).alias("limited"))
    return s.withColumns({"queued": q.select("queued").scalar(), "retrying": q.select("retrying").scalar()})


def within_memory(used_mib: int, limit_mib: int = 2048) -> bool:
    """The watcher's guard: a driver loop stops its query when this is false; executors have their own limits."""
    return limit_mib <= 0 or used_mib <= limit_mib


def after_each_batch(*steps: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: sinks and follow-up jobs (a prune after a sync, notices) in order, on rows kept for all of them."""

    def run(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            for step in steps:
                step(kept, epoch)
        finally:
            kept.unpersist()

    return run
