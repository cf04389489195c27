"""Chunks, packs, reachability, sizes, retention and tiers of content-addressed objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_TIER = 131072
AUTO_PACK_COUNT = 128
RECLAIM_BYTES = 32 << 20
UTILIZATION = 70

#: First prefix that fits names the category of a key.
CATEGORIES = (("objects/", "payload"), ("large/chunks/", "chunk"), ("large/manifests/", "manifest"), ("packs/", "pack"), ("metadata/", "metadata"), ("trees/", "tree"), ("indexes/", "index"), ("refs/", "ref"))


def category(key: Column) -> Column:
    out = F.lit("other")
    for prefix, name in reversed(CATEGORIES):
        out = F.when(key.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def fixed_ranges(length: Column, size: int) -> Column:
    """Starts of ranges of ``size`` that cover ``length``; none for 0."""
    n = length.cast("bigint")
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(max(size, 1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def next_fit(items: DataFrame, groups: list[str], order: list[str], size: str, target: int, head: int = 8) -> DataFrame:
    """``items`` with pack_no (from 0 in a group), pack_offset and record_len: next-fit in order; a record over the target is a pack alone.

    Sequential by definition: a group's rows stream through one task in order, batch by batch, and only the open pack is held.
    """
    columns = [c for c in items.columns if c not in ("pack_no", "pack_offset", "record_len")]
    items = items.select(*columns)
    kinds = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", pack_no bigint, pack_offset bigint, record_len bigint"
    at, by = columns.index(size), [columns.index(c) for c in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pack, used = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in by), strict=True)) if by else [()] * batch.num_rows
            numbers, offsets, lengths = [], [], []
            for key, length in zip(keys, batch.column(at).to_pylist(), strict=True):
                need = length + head
                if key != now:
                    now, pack, used = key, 0, 0
                elif used and used + need > target:
                    pack, used = pack + 1, 0
                numbers.append(pack)
                offsets.append(used)
                lengths.append(need)
                used += need
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (numbers, offsets, lengths))], names=[*columns, "pack_no", "pack_offset", "record_len"])

    dealt = items.repartition(*groups) if groups else items.repartition(1)
    return dealt.sortWithinPartitions(*groups, *order).mapInArrow(run, schema)


def utilization(used: Column, total: Column) -> Column:
    """Whole percent, rounded down; 100 where total is 0."""
    return F.when(total == 0, F.lit(100).cast("bigint")).otherwise(F.floor(used * 100 / F.when(total == 0, 1).otherwise(total)))


def should_compact(packs: Column, reclaim: Column, all_use: Column, current_use: Column) -> Column:
    return (packs >= 2) & (reclaim >= RECLAIM_BYTES) & ~((all_use > UTILIZATION) & (current_use > UTILIZATION))


def missing(wanted: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti")


def availability(required: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """seq, key, state: local, archived (remote only) or missing, in input order by seq."""
    here, there = local.select("key", F.lit(True).alias("here")).distinct(), remote.select("key", F.lit(True).alias("there")).distinct()
    state = F.when(F.col("here"), "local").when(F.col("there"), "archived").otherwise("missing")
    return required.join(here, "key", "left").join(there, "key", "left").select("seq", "key", state.alias("state"))


def reachable(records: DataFrame, large: DataFrame, large_chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """key of every object that the records need: loose blob, or manifest and chunks. A union of fixed-depth joins."""
    used = records.select("oid").distinct()
    big = large.join(used, "oid", "left_semi")
    loose = blobs.join(used, "oid", "left_semi").join(big.select("oid"), "oid", "left_anti").select(F.col("object_key").alias("key"))
    parts = large_chunks.join(big.select(F.col("oid").alias("large_oid")), "large_oid", "left_semi").select(F.concat(F.lit("large/chunks/"), "chunk_oid").alias("key"))
    return loose.unionByName(big.select(F.col("manifest_key").alias("key"))).unionByName(parts).distinct()


def sweep(all_objects: DataFrame, live: DataFrame, queued: DataFrame) -> DataFrame:
    """key, size of objects that are neither live nor queued for upload."""
    return all_objects.join(live.select("key").unionByName(queued.select("key")).distinct(), "key", "left_anti").select("key", "size")


def upload_plan(live: DataFrame, cache: DataFrame) -> DataFrame:
    """key, reason: live keys whose fingerprint differs from the cached one, or that have none."""
    c = cache.select("key", F.col("fingerprint").alias("old"))
    j = live.join(c, "key", "left").where(~F.col("fingerprint").eqNullSafe(F.col("old")))
    return j.select("key", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("reason"))


def publish_priority(key: Column) -> Column:
    """Content 1, metadata 2, refs 3: readers never see a ref before its data."""
    return F.when(key.startswith("refs/") | key.contains("/refs/"), 3).when(key.startswith("metadata/") | key.startswith("trees/") | key.startswith("indexes/") | key.contains("/metadata/"), 2).otherwise(1).cast("bigint")


def retention(snaps: DataFrame, daily: int, monthly: int, current: str | None, protected: DataFrame | None = None) -> DataFrame:
    """id, keep, reason. Newest first, a snapshot is kept if it opens a new day while fewer than ``daily`` days are open, or a month likewise."""
    day, month = F.date_format("created_at", "yyyy-MM-dd"), F.date_format("created_at", "yyyy-MM")
    s = snaps.select("id", "created_at", day.alias("day"), month.alias("month"))

    def newest(bucket: str, n: int) -> DataFrame:
        heads = s.groupBy(bucket).agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
        return heads.orderBy(F.desc(bucket)).limit(n).select("id", F.lit(bucket).alias("why"))

    why = newest("day", daily).unionByName(newest("month", monthly))
    if current:
        why = why.unionByName(s.where(F.col("id") == current).select("id", F.lit("current").alias("why")))
    if protected is not None:
        why = why.unionByName(protected.select("id", F.lit("protected").alias("why")))
    reasons = why.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reason"))
    return s.join(reasons, "id", "left").select("id", F.col("reason").isNotNull().alias("keep"), F.coalesce("reason", F.lit("")).alias("reason"))


def size_rollup(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per root: files, client bytes, distinct payloads and their bytes."""
    files = records.groupBy("root_id").agg(F.count("*").alias("files"), F.sum("size").alias("client_bytes"))
    own = records.select("root_id", "oid").distinct().join(blobs.select("oid", F.col("size").alias("stored")), "oid", "left")
    stored = own.groupBy("root_id").agg(F.count("*").alias("payloads"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored_bytes"), F.count_if(F.col("stored").isNull()).alias("missing"))
    return files.join(stored, "root_id")


def retained_history(records: DataFrame, current: str, top: int) -> DataFrame:
    """The ``top`` payloads by bytes that only older snapshots hold."""
    now = records.where(F.col("snapshot_id") == current).select("oid").distinct()
    old = records.join(now, "oid", "left_anti")
    agg = old.groupBy("oid").agg(F.max("size").alias("bytes"), F.count_distinct("snapshot_id").alias("snapshots"), F.min("snapshot_id").alias("first_seen"), F.max("snapshot_id").alias("last_seen"), F.min("path").alias("first_path"))
    return agg.orderBy(F.desc("bytes"), "oid").limit(top)


def set_preview(items: Column, k: int) -> Column:
    """The first k of the sorted distinct items, ``+n`` for the rest."""
    s = F.array_sort(F.array_distinct(items))
    return F.concat(F.array_join(F.slice(s, 1, k), ","), F.when(F.size(s) > k, F.concat(F.lit("+"), F.size(s) - k)).otherwise(F.lit("")))


def tier_of(key: Column, age_days: Column, rules: list[tuple[str, int, str]]) -> Column:
    """The class of the rule with the longest wait that the age reaches, among rules whose prefix fits; else STANDARD."""
    out = F.lit("STANDARD")
    for prefix, days, name in sorted(rules, key=lambda r: r[1]):
        out = F.when(key.startswith(prefix) & (age_days >= days), F.lit(name)).otherwise(out)
    return out


def compression_gain(original: Column, stored: Column) -> Column:
    return F.when(original > 0, 1 - stored / F.greatest(original, F.lit(1))).otherwise(F.lit(0.0))
