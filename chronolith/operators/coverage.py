"""Whether events are covered already, which keys answer, and how sets of paths combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["root_id", "path"]

#: Folders, at the start of a key or inside it, whose keys are read often.
HOT_HEADS = ("metadata/", "trees/", "large/manifests/", "indexes/")
HOT_PARTS = ("/metadata/", "/refs/", "/journal/", "/ops/", "/snapshots/")


def hot_metadata(key: Column) -> Column:
    out = F.lit(False)
    for h in HOT_HEADS:
        out = out | key.startswith(h)
    for p in HOT_PARTS:
        out = out | key.contains(p)
    return out


def relevant(kind: Column, path: Column) -> Column:
    """Whether an event asks for a snapshot: no mere access, no lock file of a .git folder."""
    return (kind != "access") & ~path.rlike(r"(^|/)\.git/[^/]*\.lock(/|$)")


def live_covered(live: DataFrame, events: DataFrame, after: Column) -> DataFrame:
    """The live differences (root_id, path, oid; null oid for a key that is gone) that need no new event.

    A later event of the key covers one that waits to be uploaded anyway, is a tombstone of a key that is gone,
    or has the live payload.
    """
    e = events.where(F.col("observed_at") > after).select(*KEY, F.col("oid").alias("event_oid"), "tombstone", F.col("synced_at").isNotNull().alias("synced"))
    same = F.when(F.col("oid").isNull(), F.col("tombstone")).otherwise(F.col("event_oid").eqNullSafe(F.col("oid")))
    j = live.alias("l").join(e.alias("e"), (F.col("l.root_id") == F.col("e.root_id")) & (F.col("l.path") == F.col("e.path")) & (~F.col("synced") | same), "left_semi")
    return j


def snapshot_covered(events: DataFrame, records: DataFrame, taken: Column) -> DataFrame:
    """``events`` with ``covered``: a tombstone by a snapshot without the key, others by the same payload, keyless ones by time."""
    r = records.select(*KEY, F.col("oid").alias("in_snapshot"), F.lit(True).alias("there"))
    by_key = F.when(F.col("tombstone"), F.col("there").isNull()).otherwise(F.coalesce(F.col("in_snapshot") == F.col("oid"), F.lit(False)))
    keyless = F.col("root_id").isNull() | F.col("path").isNull()
    return events.join(r, KEY, "left").select(*events.columns, F.when(keyless, F.col("observed_at") <= taken).otherwise(by_key).alias("covered"))


def first_present(keys: DataFrame, candidates: Column, present: DataFrame) -> DataFrame:
    """key, found, size: the first of a key's ordered candidate names that ``present`` (key, size) has; null if none."""
    each = keys.select("key", F.posexplode(candidates).alias("place", "name"))
    hit = each.join(present.select(F.col("key").alias("name"), "size"), "name")
    best = hit.groupBy("key").agg(F.min_by(F.struct("name", "size"), "place").alias("best"))
    return keys.select("key").join(best, "key", "left").select("key", F.col("best.name").alias("found"), F.col("best.size").alias("size"))


def conflicts(plan: DataFrame, live: DataFrame) -> DataFrame:
    """root_id, path of planned records whose target exists and differs."""
    have = live.select(*KEY, F.col("oid").alias("have"))
    return plan.join(have, KEY).where(~F.col("oid").eqNullSafe(F.col("have"))).select(*KEY)


def known_paths(tracked: DataFrame, parent: DataFrame, untracked: DataFrame) -> DataFrame:
    """Paths that are tracked or in the parent snapshot, without those told not to be."""
    return tracked.select(*KEY).unionByName(parent.select(*KEY)).distinct().join(untracked.select(*KEY), KEY, "left_anti")


def untracked_rows(present: DataFrame, managed: DataFrame) -> DataFrame:
    """root_id, path, is_dir of what is there but not managed; a folder without a managed path below it stands for all below.

    A path's row is that of its highest folder that holds nothing managed.
    """

    def folders(d: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
        return d.select(*KEY, above.alias("above"))

    loose = folders(present.select(*KEY).join(managed.select(*KEY), KEY, "left_anti"))
    used = folders(managed.select(*KEY)).select("root_id", F.explode("above").alias("dir")).distinct()
    each = loose.select(*KEY, F.posexplode_outer("above").alias("depth", "dir"))
    free = each.join(used.withColumn("managed", F.lit(True)), ["root_id", "dir"], "left")
    top = free.groupBy(*KEY).agg(F.min_by(F.when(F.col("managed").isNull(), F.col("dir")), F.when(F.col("managed").isNull() & F.col("dir").isNotNull(), F.col("depth"))).alias("top"))
    return top.select("root_id", F.coalesce("top", "path").alias("path"), F.col("top").isNotNull().alias("is_dir")).distinct()


def compaction_order(blobs: DataFrame) -> DataFrame:
    return blobs.orderBy(F.asc_nulls_first("pack_id"), F.asc_nulls_first("pack_offset"), F.asc_nulls_first("oid"))


def in_compaction(blobs: DataFrame, current: DataFrame) -> DataFrame:
    """``blobs`` with ``history``: those of the current snapshot are packed first, then the rest; both in compaction order."""
    now = current.select("oid").distinct().withColumn("now", F.lit(True))
    return blobs.join(now, "oid", "left").withColumn("history", F.col("now").isNull()).drop("now")


def sampled(keys: DataFrame, n: int) -> DataFrame:
    """The first n keys in order, and whether there were more: the sample is the feature."""
    few = keys.orderBy("key").limit(n)
    return few.withColumn("limited", keys.agg(F.count("*") > n).scalar())


def scoped(records: DataFrame, snaps: DataFrame, since: Column, large: DataFrame, large_chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """key of every object that snapshots from ``since`` on need: what a scoped check looks at."""
    from .storage import reachable

    recent = snaps.where(F.col("created_at") >= since).select(F.col("id").alias("snapshot_id"))
    return reachable(records.join(recent, "snapshot_id", "left_semi"), large, large_chunks, blobs)


def backfill(records: DataFrame, indexed: DataFrame) -> DataFrame:
    """The edges (snapshot_id, oid) of snapshots that the edge table lacks."""
    return records.join(indexed.select("snapshot_id").distinct(), "snapshot_id", "left_anti").select("snapshot_id", "oid").distinct()
