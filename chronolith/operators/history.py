"""Versions, diffs, logs, states and restores over snapshots of keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import small, written

KEY = ["root_id", "path"]
CHANGE_CAP = 1024
FOLD_FILES = 1000


def record_status(level: str, present: str = "in_new", was: str = "in_old") -> Column:
    """A, D, M, m or null, for a full outer join of ``old`` and ``new`` records.

    ``record``: any difference is M. ``payload``: only the oid counts, other differences are m.
    ``journal``: any difference is modify, with create and delete beside it.
    """
    payload = ~F.col("new.oid").eqNullSafe(F.col("old.oid"))
    meta = ~F.struct("new.size", "new.mode").eqNullSafe(F.struct("old.size", "old.mode"))
    new, old = F.col(present).isNotNull(), F.col(was).isNotNull()
    if level == "journal":
        return F.when(~old, "create").when(~new, "delete").when(payload | meta, "modify")
    out = F.when(~old, "A").when(~new, "D")
    if level == "record":
        return out.when(payload | meta, "M")
    return out.when(payload, "M").when(meta, "m")


def diff(old: DataFrame, new: DataFrame, level: str = "record") -> DataFrame:
    """root_id, path, status of the keys that differ."""
    a = old.select(*KEY, "oid", "size", "mode", F.lit(True).alias("in_old")).alias("old")
    b = new.select(*KEY, "oid", "size", "mode", F.lit(True).alias("in_new")).alias("new")
    joined = a.join(b, KEY, "full_outer")
    return joined.select(*KEY, record_status(level).alias("status")).where("status IS NOT NULL")


def status_counts(changes: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{n}") for s, n in (("A", "added"), ("M", "modified"), ("D", "deleted"))]
    return changes.groupBy(*by).agg(F.count("*").alias("total"), *counts)


def consecutive_changes(records: DataFrame, snaps: DataFrame) -> DataFrame:
    """snapshot_id, root_id, path, status of every snapshot against its parent, by one shuffle on the key.

    A record is compared with that of the snapshot before in sequence; gaps in a key's sequence are a delete and an add.
    """
    order = small(snaps.select(F.col("id").alias("snapshot_id"), "seq"))
    r = records.join(order, "snapshot_id").withColumn("last_seq", snaps.agg(F.max("seq")).scalar())
    key = Window.partitionBy(*KEY).orderBy("seq")
    before, after = F.lag("seq").over(key), F.lead("seq").over(key)
    same = F.struct("oid", "size", "mode").eqNullSafe(F.lag(F.struct("oid", "size", "mode")).over(key))
    marked = r.select(*KEY, "seq", "last_seq", before.alias("before"), after.alias("after"), same.alias("same"))
    here = F.when(F.col("before").isNull() | (F.col("before") < F.col("seq") - 1), "A").when(~F.col("same"), "M")
    gone = F.when((F.col("after").isNull() & (F.col("seq") < F.col("last_seq"))) | (F.col("after") > F.col("seq") + 1), "D")
    both = F.filter(F.array(F.struct(F.col("seq").alias("seq"), here.alias("status")), F.struct((F.col("seq") + 1).alias("seq"), gone.alias("status"))), lambda x: x.status.isNotNull())
    each = marked.select(*KEY, F.explode(both).alias("x")).select(*KEY, "x.seq", "x.status")
    return each.join(order, "seq").select("snapshot_id", *KEY, "status")


def capped(changes: DataFrame, by: list[str], cap: int = CHANGE_CAP) -> DataFrame:
    """At most ``cap`` paths a root, in path order, and a row ``(+n more)`` with status M for the rest."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("path"))
    ranked = changes.withColumn("n", n)
    rest = changes.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > cap)
    more = rest.select(*by, F.concat(F.lit("(+"), F.col("n") - cap, F.lit(" more)")).alias("path"), F.lit("M").alias("status"))
    return ranked.where(F.col("n") <= cap).select(*by, "path", "status").unionByName(more)


def folded(changes: DataFrame, by: list[str], limit: int = FOLD_FILES) -> DataFrame:
    """Groups of more than ``limit`` changes become one row with a null path and status M; ``n`` counts."""
    size = changes.groupBy(*by).agg(F.count("*").alias("n"))
    big = size.where(F.col("n") > limit).select(*by, F.lit(None).cast("string").alias("path"), F.lit("M").alias("status"), "n")
    small = changes.join(size.where(F.col("n") <= limit), by).select(*by, "path", "status", F.lit(1).cast("bigint").alias("n"))
    return big.unionByName(small)


def as_of(probes: DataFrame, at: str, snaps: DataFrame, by: str | None = None) -> DataFrame:
    """``probes`` with snapshot_id, the latest snapshot (of the same ``by``) at or before ``at``; null where there is none.

    Every snapshot holds until the next; the stretches are laid over days, so the join is on the day.
    """
    order = Window.partitionBy(by).orderBy("created_at", "id") if by else Window.orderBy("created_at", "id")
    held = snaps.select("id", "created_at", F.lead("created_at").over(order).alias("until"), *([F.col(by).alias("of")] if by else [])).withColumn("top", probes.agg(F.to_date(F.max(at))).scalar())
    held = held.withColumn("end", F.least(F.coalesce(F.to_date("until"), F.col("top")), F.col("top"))).where(F.to_date("created_at") <= F.col("end")).withColumn("on", F.explode(F.sequence(F.to_date("created_at"), "end")))
    hit = (F.to_date(F.col(at)) == F.col("on")) & (F.col(at) >= F.col("created_at")) & (F.col("until").isNull() | (F.col(at) < F.col("until")))
    if by:
        hit = hit & (F.col(by) == F.col("of"))
    return probes.join(held.withColumnRenamed("id", "snapshot_id").drop("top", "end"), hit, "left").drop("created_at", "until", "on", "of")


def resolve(names: DataFrame, refs: DataFrame, snaps: DataFrame) -> DataFrame:
    """name, snapshot_id of references: ``first``, ``latest``, a ref, a branch, or the latest snapshot up to a day; null if nothing has it."""
    ends = snaps.agg(F.min_by("id", "seq").alias("first"), F.max_by("id", "seq").alias("latest"))
    by_ref = refs.select(F.explode(F.array("name", F.regexp_replace("name", "^branches/", ""))).alias("name"), "value").distinct()
    n = names.join(by_ref, "name", "left").withColumn("time", F.try_to_timestamp("name").cast("timestamp_ntz"))
    timed = as_of(n.where("time IS NOT NULL").select("name", "time"), "time", snaps).select(F.col("name").alias("timed_name"), F.col("snapshot_id").alias("timed"))
    found = F.when(F.col("name") == "first", ends.select("first").scalar()).when(F.col("name") == "latest", ends.select("latest").scalar()).otherwise(F.coalesce("value", "timed"))
    return n.join(timed, F.col("name") == F.col("timed_name"), "left").select("name", found.alias("snapshot_id"))


def changed_fields(old: DataFrame, new: DataFrame, fields: dict[str, str]) -> DataFrame:
    """root_id, path, fields: which of ``fields`` (name: column) differ in records that both sides have; nulls are equal."""
    a, b = (d.select(*KEY, F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias(s)) for d, s in ((old, "a"), (new, "b")))
    found = F.filter(F.array(*[F.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), F.lit(n)) for n in fields]), lambda x: x.isNotNull())
    return a.join(b, KEY).select(*KEY, found.alias("fields")).where("size(fields) > 0")


def first_snapshots(records: DataFrame, snaps: DataFrame) -> DataFrame:
    """root_id, first_snapshot."""
    seen = records.select("root_id", "snapshot_id").distinct().join(snaps, F.col("snapshot_id") == F.col("id"))
    return seen.groupBy("root_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("first_snapshot"))


def tree_ids(records: DataFrame) -> DataFrame:
    """snapshot_id, root_id, tree_id (of the sorted records), file_count, total_size.

    The order-free sum of record digests names the set, so no root's records meet in one buffer.
    """
    h = F.xxhash64("path", "oid", "size", "mode").cast("decimal(38,0)")
    return records.groupBy("snapshot_id", "root_id").agg(F.sum(h).cast("string").alias("tree_id"), F.count("*").alias("file_count"), F.sum("size").alias("total_size"))


def last_changes(records: DataFrame, snaps: DataFrame) -> DataFrame:
    """root_id, last_change: the earliest snapshot of the run of equal trees that the latest one ends."""
    t = tree_ids(records).join(small(snaps), F.col("snapshot_id") == F.col("id"))
    w = Window.partitionBy("root_id").orderBy("seq")
    marked = t.withColumn("new", ~F.col("tree_id").eqNullSafe(F.lag("tree_id").over(w)))
    return marked.where("new").groupBy("root_id").agg(F.max_by("snapshot_id", "seq").alias("last_change"))


def lineage(snaps: DataFrame, start: str) -> DataFrame:
    """id, depth of all ancestors of ``start`` by parent_id, itself first; ``depth`` 0 for itself. A parent that is unknown ends the line.

    Jumps double from round to round, so a line of n takes log2(n) joins; every round is written, so plans stay short.
    """
    known = snaps.select("id", F.col("parent_id").alias("to"))
    jump = written(known.join(snaps.select(F.col("id").alias("to")), "to").select("id", "to"), "lineage-jumps")
    found, reach = written(snaps.where(F.col("id") == start).select("id", F.lit(0).cast("bigint").alias("depth")), "lineage"), 1
    while True:
        more = found.join(jump, "id").select(F.col("to").alias("id"), (F.col("depth") + reach).alias("depth"))
        more = written(more, "lineage")
        if more.isEmpty():
            return found
        if reach > snaps.count():
            raise ValueError(f"{start} is its own ancestor")
        found = written(found.unionByName(more), "lineage")
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        jump, reach = written(jump.join(ahead, "to").select("id", F.col("beyond").alias("to")), "lineage-jumps"), 2 * reach


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each key (last writer wins; event_id breaks ties)."""
    return events.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in events.columns if c not in KEY]), F.struct("observed_at", "event_id")).alias("e")).select(*KEY, "e.*")


def overlay(base: DataFrame, events: DataFrame, after: Column, upto: Column) -> DataFrame:
    """root_id, path, oid, size, mode of ``base`` with the durable events in (after, upto] applied; tombstones delete."""
    won = latest_events(events.where((F.col("observed_at") > after) & (F.col("observed_at") <= upto)))
    kept = base.select(*KEY, "oid", "size", "mode").join(won.select(*KEY), KEY, "left_anti")
    return kept.unionByName(won.where("NOT tombstone").select(*KEY, "oid", "size", "mode"))


def state(live: DataFrame, basis: DataFrame, since: Column | None = None) -> DataFrame:
    """root_id, path, status (A, M, D, m), order_time of live records against a basis; rows before ``since`` go, null times stay."""
    a = basis.select(*KEY, "oid", "size", "mode", "modified", F.lit(True).alias("in_old")).alias("old")
    b = live.select(*KEY, "oid", "size", "mode", "modified", F.lit(True).alias("in_new")).alias("new")
    j = a.join(b, KEY, "full_outer").select(*KEY, record_status("payload").alias("status"), F.col("new.modified").alias("order_time"))
    j = j.where("status IS NOT NULL")
    return j if since is None else j.where(F.col("order_time").isNull() | (F.col("order_time") >= since))


def lifecycle_state(first: DataFrame, live: DataFrame) -> DataFrame:
    """As state, from the first snapshot of each root; a managed live path that hasn't changed is reported A."""
    a = first.select(*KEY, "oid", F.lit(True).alias("in_old")).alias("old")
    b = live.select(*KEY, "oid", F.lit(True).alias("in_new")).alias("new")
    status = F.when(F.col("in_new").isNull(), "D").when(F.col("in_old").isNotNull() & (F.col("old.oid") != F.col("new.oid")), "M").otherwise("A")
    return a.join(b, KEY, "full_outer").select(*KEY, status.alias("status"))


def restore_plan(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """root_id, path, action: restore, keep, modify for wanted records, delete for the rest of the roots that are wanted."""
    a, b = wanted.select(*KEY, "oid").alias("w"), live.select(*KEY, "oid").alias("l")
    act = F.when(F.col("l.oid").isNull(), "restore").when(F.col("l.oid") == F.col("w.oid"), "keep").otherwise("modify")
    planned = a.join(b, KEY, "left").select(*KEY, act.alias("action"))
    roots = wanted.select("root_id").distinct()
    gone = live.select(*KEY).join(small(roots), "root_id", "left_semi").join(wanted.select(*KEY), KEY, "left_anti")
    return planned.unionByName(gone.select(*KEY, F.lit("delete").alias("action")))


def delete_order(plan: DataFrame) -> DataFrame:
    """Deletes, deepest (longest) paths of a root first."""
    return plan.where("action = 'delete'").orderBy("root_id", F.length("path").desc(), "path")


def tracked_paths(events: DataFrame) -> DataFrame:
    """root_id, path, first_seen, last_seen (epoch seconds), untracked (the last event is a tombstone), n_events."""
    at = F.unix_timestamp(F.col("observed_at").cast("timestamp"))
    return events.groupBy(*KEY).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by("tombstone", F.struct("observed_at", "event_id")).alias("untracked"), F.count("*").alias("n_events"))


def tree_rollup(records: DataFrame) -> DataFrame:
    """root_id, dir, file_count, total_size of every directory with all below it; '' is the root."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return records.select("root_id", "size", F.explode(above).alias("dir")).groupBy("root_id", "dir").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))


def changed_dirs(old: DataFrame, new: DataFrame) -> DataFrame:
    """root_id, dir of directories whose content differs (Merkle diff: equal node names prune all below)."""

    def nodes(records: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        h = F.xxhash64("path", "oid", "size", "mode").cast("decimal(38,0)")
        return records.select("root_id", F.explode(above).alias("dir"), h.alias("h")).groupBy("root_id", "dir").agg(F.sum("h").alias("node"))

    a, b = nodes(old).withColumnRenamed("node", "a"), nodes(new).withColumnRenamed("node", "b")
    return a.join(b, ["root_id", "dir"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("root_id", "dir")


def id_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """The one row whose id begins with ``prefix`` (ASCII case-insensitive); none or several are an error."""
    low = rows.where(F.lower("id").startswith(prefix.lower()))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    few = low.limit(2).withColumn("n", n)
    return few.where(F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.lit(f"{prefix}: not one match")).cast("boolean"))).drop("n")
