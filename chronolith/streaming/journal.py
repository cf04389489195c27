"""The event journal: statistics, compaction, gap windows; the same rules in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of journal rows that ask for a snapshot, and the one that marks its end.
TRIGGERS = ("fs-event", "periodic-rescan", "create", "modify", "delete")
FINISH = "snapshot-finish"
QUIET_MS, MAX_LATENCY_MS, MAX_EVENTS = 2000, 60_000, 1000


def is_trigger() -> Column:
    return F.col("kind").isin(*TRIGGERS)


def _last_finish(rows: DataFrame) -> Column:
    return rows.agg(F.max(F.when(F.col("kind") == FINISH, F.col("observed_at")))).scalar()


def pending(rows: DataFrame, synced: bool = False) -> DataFrame:
    """Trigger rows after the last finish; with ``synced`` only those not yet synced."""
    late = rows.where(is_trigger()).withColumn("last_finish", _last_finish(rows)).where(F.col("last_finish").isNull() | (F.col("observed_at") > F.col("last_finish"))).drop("last_finish")
    return late.where(F.col("synced_at").isNull()) if synced else late


def stats(rows: DataFrame) -> DataFrame:
    """total, pending, processed, finishes."""
    open_ = is_trigger() & (F.col("last_finish").isNull() | (F.col("observed_at") > F.col("last_finish")))
    return rows.withColumn("last_finish", _last_finish(rows)).agg(F.count("*").alias("total"), F.count_if(open_).alias("pending"), F.count_if(is_trigger() & ~open_).alias("processed"), F.count_if(F.col("kind") == FINISH).alias("finishes"))


def compacted(rows: DataFrame) -> DataFrame:
    """What stays: other rows from the second latest distinct finish on, triggers from the latest finish on."""
    ends = rows.where(F.col("kind") == FINISH).select("observed_at").distinct().orderBy(F.desc("observed_at")).limit(2)
    cut = ends.agg(F.struct(F.max("observed_at").alias("latest"), F.min("observed_at").alias("second"), F.count("*").alias("n")).alias("cut")).scalar()
    second = F.when(F.col("cut.n") == 2, F.col("cut.second"))
    gone = (is_trigger() & F.coalesce(F.col("observed_at") < F.col("cut.latest"), F.lit(False))) | (~is_trigger() & F.coalesce(F.col("observed_at") < second, F.lit(False)))
    return rows.withColumn("cut", cut).where(~gone).select(*rows.columns)


def gap_sessions(rows: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """key, session, events, first_id, last_id of runs whose neighbours lie less than the gap apart."""
    at = F.unix_micros(F.col("observed_at").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("observed_at", "event_id")
    opens = F.coalesce(at - F.lag(at).over(w) >= gap_seconds * 1_000_000, F.lit(True))
    s = rows.select(key, "event_id", "observed_at", opens.cast("bigint").alias("opens"))
    s = s.withColumn("session", F.sum("opens").over(w))
    return s.groupBy(key, "session").agg(F.count("*").alias("events"), F.min_by("event_id", F.struct("observed_at", "event_id")).alias("first_id"), F.max_by("event_id", F.struct("observed_at", "event_id")).alias("last_id"))


def windowed(stream: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """A streaming (or batch) session window by key: counts and tombstones of every gap-closed batch."""
    timed = stream.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", late)
    agg = timed.groupBy(F.session_window("observed_at", gap).alias("w"), key).agg(F.count("*").alias("events"), F.count_if(F.col("tombstone")).alias("deletes"))
    return agg.select(key, F.unix_micros("w.start").alias("start_us"), "events", "deletes")


class GapBuffer:
    """One key's open batch: closed by a quiet gap, a count or an age. Shared by batch and stream."""

    def __init__(self, quiet_ms: int = QUIET_MS, max_latency_ms: int = MAX_LATENCY_MS, max_events: int = MAX_EVENTS):
        self.limits = quiet_ms, max_latency_ms, max_events

    def feed(self, state: tuple[int, int, int] | None, times: list[int]):
        """state: (first, last, n) in ms. Gives the closed batches (start, n, elapsed, reason) and the new state."""
        quiet, latency, most = self.limits
        out = []
        for t in times:
            if state and t - state[1] >= quiet:
                out.append((state[0], state[2], state[1] - state[0], "quiet"))
                state = None
            if state and t - state[0] >= latency:
                out.append((state[0], state[2], state[1] - state[0], "max-latency"))
                state = None
            state = (state[0], t, state[2] + 1) if state else (t, t, 1)
            if state[2] >= most:
                out.append((state[0], state[2], state[1] - state[0], "max-events"))
                state = None
        return out, state

    def flush(self, state):
        return [(state[0], state[2], state[1] - state[0], "quiet")] if state else []


BATCH_SCHEMA = "key string, start_ms bigint, events bigint, elapsed_ms bigint, reason string"


def capped_batches(rows: DataFrame, key: str, buffer: GapBuffer) -> DataFrame:
    """The closed batches of every key; a key's times are walked in order in chunks, never as one frame."""
    timed = rows.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col("observed_at").cast("timestamp")).alias("t"))

    def run(frames):
        import pandas as pd

        now, state = None, None
        for f in frames:
            out = []
            f["key"] = f["key"].astype(object).where(f["key"].notna(), None)
            for k, part in f.groupby("key", sort=False, dropna=False):
                k = k if isinstance(k, str) else None  # noqa: PLW2901  a null key is a key
                if k != now:
                    out += [(now, *b) for b in buffer.flush(state)]
                    now, state = k, None
                done, state = buffer.feed(state, part.t.tolist())
                out += [(k, *b) for b in done]
            yield pd.DataFrame(out, columns=["key", "start_ms", "events", "elapsed_ms", "reason"])
        yield pd.DataFrame([(now, *b) for b in buffer.flush(state)], columns=["key", "start_ms", "events", "elapsed_ms", "reason"])

    return timed.repartition("key").sortWithinPartitions("key", "t").mapInPandas(run, BATCH_SCHEMA)


def capped_stream(stream: DataFrame, key: str, buffer: GapBuffer) -> DataFrame:
    """The same as a stateful stream: a timer closes a quiet batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    timed = stream.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col("observed_at").cast("timestamp")).alias("t"))

    def step(group, frames, state):
        import pandas as pd

        held = state.get if state.exists else None
        if state.hasTimedOut:
            out = buffer.flush(held)
            state.remove()
        else:
            times = sorted(t for f in frames for t in f.t.tolist())
            out, held = buffer.feed(held, times)
            if held:
                state.update(held)
                state.setTimeoutDuration(buffer.limits[0])
            elif state.exists:
                state.remove()
        yield pd.DataFrame([(group[0], *b) for b in out], columns=["key", "start_ms", "events", "elapsed_ms", "reason"])

    return timed.groupBy("key").applyInPandasWithState(step, BATCH_SCHEMA, "first bigint, last bigint, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: What kinds of raw events are called as file events.
KIND_NAMES = {"create": "create", "modify": "modify", "delete": "remove", "remove": "remove", "access": "access"}


def file_events(raw: DataFrame, roots: DataFrame) -> DataFrame:
    """event_id, kind, of_root, path: a row for each path of a raw event (paths), by the deepest root above it; others drop.

    ``raw`` may be a stream; ``roots`` (root_path, of_root) is the configured table. Paths meet roots by equality on the folders above them.
    """
    kind = F.lit("other")
    for k, name in KIND_NAMES.items():
        kind = F.when(F.col("kind") == k, name).otherwise(kind)
    each = raw.select("event_id", kind.alias("kind"), F.posexplode("paths").alias("place", "full"))
    parts = F.split("full", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    known = roots.agg(F.map_from_entries(F.collect_list(F.struct("root_path", "of_root"))).alias("roots"))  # the configured table is one row
    deepest = F.element_at(F.filter(F.transform(above, lambda a: F.struct(a.alias("at"), F.try_element_at(F.col("roots"), a).alias("of_root"))), lambda x: x.of_root.isNotNull()), -1)
    found = each.withColumn("roots", known.scalar()).select("event_id", "kind", "full", F.when(F.size(F.filter(above, lambda a: F.map_contains_key("roots", a))) > 0, deepest).alias("x"))
    return found.where("x IS NOT NULL").select("event_id", "kind", F.col("x.of_root").alias("of_root"), F.substring(F.col("full"), F.length("x.at") + 2, F.length("full")).alias("path"))
