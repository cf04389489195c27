"""Branches, operations, restore jobs, queues and states: plans over small control tables, as new versions of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = "branches/"
ACTIVE = "current-branch"

#: What an operation, its status and its sync state may be called.
OPERATION_KINDS = (
    "init", "root-added", "config-change", "root-removed", "root-paused", "root-resumed", "root-mark-deleted", "root-missing", "root-unmounted",
    "root-permission-denied", "path-tracked", "path-untracked", "initial-scan", "manual-snapshot", "file-events-batch", "op-restore", "restore",
    "restore-prepare", "restore-resume", "mount", "mount-fuse", "unmount", "unmount-fuse", "hydrate", "large-pin", "large-unpin", "remote-sync",
    "remote-repair", "key-rotation", "pack", "pack-compact", "prune", "gc", "cache-prune", "lifecycle-apply", "fsck",
)
OPERATION_STATUSES = ("done", "running", "failed")
SYNC_STATES = ("not-synced", "queued", "synced", "failed")
JOB_STATUSES = ("prepared", "ready", "archive-requested", "done")
#: Kinds of operations that change files.
CHANGE_KINDS = ("initial-scan", "manual-snapshot", "file-events-batch")
STALLED_AFTER, NOTICE_EVERY, STALE_AFTER = 300, 3600, 600


class BranchError(ValueError):
    """A change of branches that the state of the refs forbids."""


def _values(refs: DataFrame) -> dict[str, str]:
    """The refs themselves: names that a person gave, a handful."""
    return {r.name: r.value for r in refs.select("name", "value").limit(100_000).collect()}


def _as_table(refs: DataFrame, values: dict[str, str]) -> DataFrame:
    return refs.sparkSession.createDataFrame(sorted(values.items()), "name string, value string")


def _known(v: dict[str, str], name: str) -> str:
    if HEAD + name not in v:
        raise BranchError(f"unknown branch: {name}")
    return v[HEAD + name]


def create_branch(refs: DataFrame, name: str, snapshot: str, force: bool = False) -> DataFrame:
    """A branch at a snapshot; an active one takes the current ref along. One that is there moves only by ``force``."""
    v = _values(refs)
    if HEAD + name in v and not force:
        raise BranchError(f"branch already exists: {name}")
    v[HEAD + name] = snapshot
    return _as_table(refs, v | ({"current": snapshot} if v.get(ACTIVE) == name else {}))


def set_head(refs: DataFrame, name: str, snapshot: str) -> DataFrame:
    _known(_values(refs), name)
    return create_branch(refs, name, snapshot, force=True)


def switch_branch(refs: DataFrame, name: str) -> DataFrame:
    """The branch becomes active and its head current; the caller may apply the restore plan of that snapshot."""
    v = _values(refs)
    return _as_table(refs, v | {ACTIVE: name, "current": _known(v, name)})


def rename_branch(refs: DataFrame, old: str, new: str, force: bool = False) -> DataFrame:
    v = _values(refs)
    if old == new:
        raise BranchError("the new name is the old one")
    if HEAD + new in v and not force:
        raise BranchError(f"branch already exists: {new}")
    head, touched = _known(v, old), v.get(ACTIVE) in (old, new)
    v.pop(HEAD + old)
    v[HEAD + new] = head
    if v.get(ACTIVE) == old:
        v[ACTIVE] = new
    return _as_table(refs, v | ({"current": head} if touched else {}))


def delete_branch(refs: DataFrame, name: str, force: bool = False) -> DataFrame:
    """The active branch goes only by ``force``; the first by name that is left then becomes active."""
    v = _values(refs)
    _known(v, name)
    if v.get(ACTIVE) == name and not force:
        raise BranchError(f"cannot delete the current branch {name}")
    v.pop(HEAD + name)
    if v.get(ACTIVE) == name:
        rest = sorted(k for k in v if k.startswith(HEAD))
        if rest:
            v |= {ACTIVE: rest[0].removeprefix(HEAD), "current": v[rest[0]]}
        else:
            v.pop(ACTIVE)
    return _as_table(refs, v)


def undo_pointer(ops: DataFrame) -> DataFrame:
    """op_id, snapshot_id: where ``current`` goes when an operation is undone, the snapshot before it, else after it."""
    return ops.select(F.col("id").alias("op_id"), F.coalesce("before_snapshot", "after_snapshot").alias("snapshot_id")).where("snapshot_id IS NOT NULL")


def changing(ops: DataFrame) -> DataFrame:
    """Operations that changed files: of three kinds, with a snapshot after that isn't the one before."""
    return ops.where(F.col("kind").isin(*CHANGE_KINDS) & F.col("after_snapshot").isNotNull() & ~F.col("after_snapshot").eqNullSafe(F.col("before_snapshot")))


def newest(ops: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of operations, newest first by ``seq``."""
    return ops.orderBy(F.desc("seq")).offset(offset).limit(limit)


def current_operation(ops: DataFrame) -> DataFrame:
    return ops.agg(F.max_by("id", "seq").alias("id"))


def stale_running(ops: DataFrame, now: Column, older: int = STALE_AFTER) -> DataFrame:
    """``ops`` with those failed that run for longer than ``older`` seconds though their process has ended (column ``alive``)."""
    late = (F.col("status") == "running") & (F.unix_timestamp("created_at") < now - older) & ~F.coalesce("alive", F.lit(False))
    return ops.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def origin_label(label: Column, session: Column, pid: Column, kind: Column, own_label: Column, message: Column) -> Column:
    """Who caused an operation: label and session, session, process, or what kind of watcher saw it; '-' if nothing says."""
    watch = (kind == "file-events-batch") & (own_label == "daemon")
    seen = F.when(watch & F.coalesce(message.contains("journal replay"), F.lit(False)), "unattributed:watch-replay").when(watch, "unattributed:watch")
    return F.coalesce(F.concat(label, F.lit(":"), session), session, F.concat(F.lit("origin-pid:"), pid.cast("string")), seen, F.lit("-"))


def session_label(label: Column, session: Column, pid: Column) -> Column:
    return F.coalesce(F.concat(label, F.lit(":"), session), session, F.concat(F.lit("pid:"), pid.cast("string")), F.lit("-"))


def restore_jobs(required: DataFrame, *by: str) -> DataFrame:
    """A prepared job for each group of (key, state): sorted required, archived and missing keys, none requested yet."""
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("key"))))
    j = required.groupBy(*by).agg(F.array_sort(F.collect_set("key")).alias("required"), of("archived").alias("archived"), of("missing").alias("missing"))
    return j.select(*j.columns, F.array().cast("array<string>").alias("requested"), F.lit("prepared").alias("status"))


def request_archives(jobs: DataFrame, accepted: Callable[[Column], Column]) -> DataFrame:
    """Asks for the archived keys of open jobs; those that the store accepts are requested."""
    took = F.filter("archived", accepted)
    ask = F.col("status").isin("prepared", "ready", "archive-requested") & (F.size(took) > 0)
    return jobs.withColumns({"requested": F.when(ask, took).otherwise(F.col("requested")), "status": F.when(ask, "archive-requested").otherwise(F.col("status"))})


def hydrate(jobs: DataFrame, here: Callable[[Column], Column]) -> DataFrame:
    """Archived keys that have come (``here`` of a key) leave the job; with none left it is ready."""
    left = F.filter("archived", lambda key: ~here(key))
    open_ = F.col("status").isin("prepared", "ready", "archive-requested")
    j = jobs.withColumn("archived", F.when(open_, left).otherwise(F.col("archived")))
    return j.withColumns({"requested": F.array_intersect("requested", "archived"), "status": F.when(open_ & (F.size("archived") == 0), "ready").otherwise(F.col("status"))})


def finish(jobs: DataFrame) -> DataFrame:
    """Ready jobs without missing keys are done; ``blocked`` says why the others are not."""
    why = F.when(F.size("missing") > 0, F.concat(F.lit("missing objects: "), F.size("missing"))).when(F.size("archived") > 0, F.concat(F.lit("archived objects pending: "), F.size("archived")))
    done = F.col("status").isin("prepared", "ready") & why.isNull()
    return jobs.withColumns({"blocked": why, "status": F.when(done, "done").otherwise(F.col("status"))})


def head_status(local: Column, remote: Column) -> Column:
    """How the current snapshot stands to the one that the remote is known to have."""
    return F.when(local.isNull() & remote.isNull(), "no snapshot").when(remote.isNull(), "not synced").when(local.isNull(), "remote only").when(local == remote, "synced").otherwise("lagging")


def pending_state(pending: Column, oldest_age: Column, queued: Column) -> Column:
    """clear, syncing (uploads are queued), stalled (the oldest is STALLED_AFTER seconds old) or processing."""
    return F.when(pending == 0, "clear").when(queued > 0, "syncing").when(oldest_age >= STALLED_AFTER, "stalled").otherwise("processing")


def root_rank(status: Column) -> Column:
    """Order of roots in a list: unknown states first, then active, paused and deleted ones."""
    return F.when(status == "active", 1).when(status == "paused", 2).when(status == "deleted", 3).otherwise(0)


def notices(times: DataFrame, key: list[str], every: int = NOTICE_EVERY) -> DataFrame:
    """``times`` (key, at in seconds) with ``sent``: a notice goes out unless one did for the same key within ``every`` seconds.

    A key's times stream through one task in order, and only the time of the last notice is held.
    """
    names = times.columns
    at, by = names.index("at"), [names.index(c) for c in key]

    def run(batches):
        import pyarrow as pa

        now, last = None, None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in by), strict=True))
            out = []
            for k, t in zip(keys, b.column(at).to_pylist(), strict=True):
                if k != now:
                    now, last = k, None
                sent = last is None or t - last >= every
                last = t if sent else last
                out.append(sent)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*names, "sent"])

    return times.repartition(*key).sortWithinPartitions(*key, "at").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in times.dtypes) + ", sent boolean")


def drain(queue: DataFrame, failed: Column, priority: Column, parallel: int) -> DataFrame:
    """One pass over a queue in batches of ``parallel`` by (priority, key): done, retry, or waiting behind the first batch with a failure.

    A rank is the count of the groups before (priority and the head of the key; few rows) and the place in the own group.
    """
    group = ["priority", "head"]
    q = queue.withColumns({"priority": priority, "failed": failed, "head": F.substring("key", 1, 12)})
    sizes = q.groupBy(*group).agg(F.count("*").alias("n"))
    before = sizes.select(*group, (F.sum("n").over(Window.orderBy(*group)) - F.col("n")).alias("before"))
    ranked = q.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("key"))).join(before, group)
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place") - 1).withColumn("batch", F.floor(F.col("rank") / parallel))
    stop = ranked.agg(F.min(F.when(F.col("failed"), F.col("batch"))).alias("stop"))
    j = ranked.withColumn("stop", stop.scalar())
    late = F.coalesce(F.col("batch") > F.col("stop"), F.lit(False))
    outcome = F.when(late, "waiting").when(F.col("failed"), "retry").otherwise("done")
    return j.select(*queue.columns, "priority", F.col("rank").cast("bigint").alias("rank"), outcome.alias("outcome"), (F.col("attempts") + F.when(outcome == "retry", 1).otherwise(0)).alias("next_attempts"))
