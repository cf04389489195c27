"""Integrity checks: every one gives rows (check, severity, key, detail); an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"info": 0, "warning": 1, "error": 2}


def issues(rows: DataFrame, check: str, key: Column | str, detail: Column | str | None = None, severity: str = "error") -> DataFrame:
    text = F.lit("") if detail is None else detail
    k = F.col(key) if isinstance(key, str) else key
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), k.cast("string").alias("key"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("detail"))


def report(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def orphans(rows: DataFrame, key: str, owners: DataFrame, owner_key: str, check: str) -> DataFrame:
    """Rows whose key no owner has; null keys are not orphans."""
    known = owners.select(F.col(owner_key).alias(key)).distinct()
    return issues(rows.where(F.col(key).isNotNull()).join(known, key, "left_anti"), check, key)


def duplicates(rows: DataFrame, key: str, check: str) -> DataFrame:
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return issues(many, check, key, F.col("n"))


def two_way(left: DataFrame, right: DataFrame, key: str, check: str) -> DataFrame:
    """Keys that one side lacks: ``-missing`` (only left) and ``-unexpected`` (only right)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return issues(a.join(b, key, "left_anti"), f"{check}-missing", key).unionByName(issues(b.join(a, key, "left_anti"), f"{check}-unexpected", key))


def drift(left: DataFrame, right: DataFrame, key: str, fields: list[str], check: str) -> DataFrame:
    """Only-left, only-right and mismatched rows of two tables with one row a key, in one full outer join."""
    a = left.select(key, F.struct(*fields).alias("a"))
    b = right.select(key, F.struct(*fields).alias("b"))
    kind = F.when(F.col("a").isNull(), "only-right").when(F.col("b").isNull(), "only-left").when(~F.col("a").eqNullSafe(F.col("b")), "mismatch")
    return issues(a.join(b, key, "full_outer").withColumn("kind", kind).where("kind IS NOT NULL"), check, key, "kind")


def history_graph(ops: DataFrame, parent: str, known_snapshots: DataFrame) -> DataFrame:
    """Operations that are their own parent, whose parent is gone, or whose snapshot is gone; a missing parent snapshot is legal."""
    own = issues(ops.where(F.col(parent) == F.col("id")), "self-parent", "id")
    gone = orphans(ops.select(F.col(parent).alias("p")), "p", ops, "id", "missing-parent-op")
    lost = orphans(ops.select(F.col("after_snapshot").alias("s")), "s", known_snapshots, "id", "missing-snapshot")
    return report(own, gone, lost)


def pack_index(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries (oid, offset, len) against blob metadata (oid, pack_offset, pack_len), in one full outer join."""
    j = index.join(blobs, "oid", "full_outer")
    kind = (
        F.when(F.col("pack_offset").isNull() & F.col("pack_len").isNull(), "EntryWithoutBlobMetadata")
        .when(F.col("offset").isNull(), "MissingBlobEntry")
        .when((F.col("offset") != F.col("pack_offset")) | (F.col("len") != F.col("pack_len")), "EntryOffsetMismatch")
    )
    return issues(j.withColumn("kind", kind).where("kind IS NOT NULL"), "pack-index", "oid", "kind")


def pack_bounds(blobs: DataFrame, packs: DataFrame) -> DataFrame:
    """Blob ranges against the size of their pack; packs that have no metadata once each."""
    j = blobs.join(packs, "pack_id", "left")
    kind = F.when(F.col("pack_offset").isNull(), "MissingBlobOffset").when(F.col("pack_len").isNull(), "MissingBlobLength").when(F.col("pack_offset") + F.col("pack_len") > F.col("size"), "BlobRangeOutOfBounds")
    ranged = issues(j.where(F.col("size").isNotNull()).withColumn("kind", kind).where("kind IS NOT NULL"), "pack-bounds", "oid", "kind")
    return ranged.unionByName(orphans(blobs, "pack_id", packs, "pack_id", "missing-pack-metadata").distinct())


def manifests(large: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk count and size of each large object against its chunk list."""
    got = chunks.groupBy(F.col("large_oid").alias("oid")).agg(F.count("*").alias("n"), F.sum("len").alias("bytes"), F.max(F.col("start") + F.col("len")).alias("end"))
    j = large.join(got, "oid", "left")
    kind = F.when(F.col("n").isNull(), "no-chunks").when(F.col("n") != F.col("chunk_count"), "chunk-count").when(F.col("bytes") != F.col("size"), "size").when(F.col("end") != F.col("size"), "gap")
    return issues(j.withColumn("kind", kind).where("kind IS NOT NULL"), "large-manifest", "oid", "kind")


def refs(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Local refs: duplicates, unknown names, snapshots that are gone, last-synced values that are no time."""
    points = F.col("name").isin("current") | F.col("name").startswith("branches/")
    known = points | F.col("name").isin("last-synced", "current-branch")
    lost = rows.where(points).join(snapshots.select(F.col("id").alias("value")), "value", "left_anti")
    return report(
        duplicates(rows, "name", "duplicate-ref"),
        issues(lost, "missing-snapshot-ref", "name", "value"),
        issues(rows.where((F.col("name") == "last-synced") & F.try_to_timestamp("value").isNull()), "invalid-last-synced", "name", "value"),
        issues(rows.where(~known), "unknown-ref", "name", "value", "warning"),
    )


def row_rules(rows: DataFrame, key: str, rules: dict[str, Column], check: str) -> DataFrame:
    """A row for each rule (name: condition that is wrong) that a row breaks."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return issues(rows.select(F.col(key).alias("k"), F.explode(broken).alias("rule")), check, "k", "rule")


def severity_fold(found: DataFrame) -> DataFrame:
    """state (protected, degraded, unprotected) and counts."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    a = found.agg(F.count("*").alias("issues"), F.coalesce(F.max(rank), F.lit(0)).alias("worst"))
    return a.select("issues", F.when(F.col("worst") == 2, "unprotected").when(F.col("worst") == 1, "degraded").otherwise("protected").alias("state"))


def tree_manifests(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Tree manifests (snapshot_id, root_id, tree_id, file_count) against the roots that snapshots name."""
    by = ["snapshot_id", "root_id"]
    a = snapshots.select(*by, F.struct("tree_id", "file_count").alias("want"))
    j = a.join(manifests.select(*by, F.struct("tree_id", "file_count").alias("have")), by, "left")
    wrong = F.array(
        F.when(F.col("have").isNull(), "RootIdMismatch"),
        F.when(F.col("have.tree_id") != F.col("want.tree_id"), "TreeIdMismatch"),
        F.when(F.col("have.file_count") != F.col("want.file_count"), "FileCountMismatch"),
    )
    found = j.select(F.concat_ws("/", *by).alias("key"), F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("kind"))
    return issues(found, "tree-manifest", "key", "kind")


def chunk_index(index: DataFrame, expected: DataFrame) -> DataFrame:
    """A chunk index (oid, size) against the chunks: duplicate, unexpected, mismatched and missing entries."""
    got = index.groupBy("oid").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    j = got.join(expected.select("oid", F.col("size").alias("want"), F.lit(True).alias("known")), "oid", "full_outer")
    wrong = F.array(
        F.when(F.col("known").isNull(), "UnexpectedEntry"),
        F.when(F.col("known") & (F.col("n") > 1), "DuplicateEntry"),
        F.when(F.col("known") & ((F.col("lo") != F.col("want")) | (F.col("hi") != F.col("want"))), "EntryMismatch"),
        F.when(F.col("n").isNull(), "MissingEntry"),
    )
    return issues(j.select("oid", F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("kind")), "chunk-index", "oid", "kind")


def gc_mark(mark: DataFrame, keys: DataFrame, live: DataFrame, host: str, current: str) -> DataFrame:
    """A garbage-collection mark (one row of version, host_id, current_snapshot) with its keys against what is live."""
    rules = {"UnsupportedVersion": F.col("version") != 1, "HostMismatch": F.col("host_id") != host, "CurrentSnapshotMismatch": ~F.col("current_snapshot").eqNullSafe(F.lit(current))}
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return report(
        row_rules(mark, "host_id", rules, "gc-mark"),
        issues(many, "gc-mark", "key", F.lit("DuplicateObjectKeys")),
        issues(live.select("key").join(keys, "key", "left_anti"), "gc-mark", "key", F.lit("MissingLiveObject")),
        issues(keys.select("key").distinct().join(live, "key", "left_anti"), "gc-mark", "key", F.lit("UnexpectedObjectKey")),
    )


def gc_tombstones(rows: DataFrame, host: str) -> DataFrame:
    bad_key = (F.col("key") == "") | F.col("key").startswith("/") | F.col("key").contains("..")
    return row_rules(rows, "key", {"UnsupportedVersion": F.col("version") != 1, "HostMismatch": F.col("host_id") != host, "InvalidDeletedKey": bad_key}, "gc-tombstone")


ACK = "snapshot_id string, tree_id string, file_count bigint, synced_at string"


def remote_refs(rows: DataFrame, host: str, snapshots: DataFrame) -> DataFrame:
    """Cached remote refs (remote, name, value, observed_at): names hosts/<host>/refs/<ref> and hosts/<host>/roots/<root>/ack."""
    ref = F.regexp_extract("name", r"^hosts/([^/]+)/refs/([^/]+)$", 1)
    ack = F.regexp_extract("name", r"^hosts/([^/]+)/roots/([^/]+)/ack$", 1)
    r = rows.select("*", F.nullif(ref, F.lit("")).alias("ref_host"), F.nullif(ack, F.lit("")).alias("ack_host"), F.regexp_extract("name", r"^hosts/[^/]+/refs/([^/]+)$", 1).alias("ref"))
    r = r.select("*", F.coalesce("ref_host", "ack_host").alias("of_host"), F.from_json("value", ACK).alias("ack"))
    points = F.when(F.col("ack_host").isNotNull(), F.col("ack.snapshot_id")).when(F.col("ref") == "current", F.col("value"))
    r = r.withColumn("points", points).join(snapshots.select(F.col("id").alias("points"), F.lit(True).alias("there")).distinct(), "points", "left")
    rules = {
        "EmptyRemote": F.trim("remote") == "",
        "InvalidObservedAt": F.col("observed_at").isNotNull() & F.try_to_timestamp("observed_at").isNull(),
        "UnsupportedName": F.col("of_host").isNull(),
        "HostMismatch": F.col("of_host") != host,
        "InvalidAck": F.col("ack_host").isNotNull() & F.col("ack.snapshot_id").isNull(),
        "MissingSnapshot": F.col("points").isNotNull() & F.col("there").isNull(),
        "InvalidLastSynced": (F.col("ref") == "last-synced") & F.try_to_timestamp("value").isNull(),
        "UnsupportedRefName": F.col("ref_host").isNotNull() & ~F.col("ref").isin("current", "last-synced"),
    }
    return row_rules(r, "name", rules, "remote-ref")


def large_pins(pins: DataFrame, large: DataFrame) -> DataFrame:
    lost = pins.join(large.select("oid"), "oid", "left_anti")
    return report(issues(lost, "large-pin", "oid", F.lit("Dangling")), issues(pins.where(F.try_to_timestamp("pinned_at").isNull()), "large-pin", "oid", F.lit("InvalidTimestamp")))


def host_files(files: DataFrame, config: DataFrame) -> DataFrame:
    """Host files (key, host_id, host_name) against the configuration's (key, config_id, config_name)."""
    j = files.join(config, "key")
    return row_rules(j, "key", {"IdMismatch": ~F.col("host_id").eqNullSafe(F.col("config_id")), "NameMismatch": ~F.col("host_name").eqNullSafe(F.col("config_name"))}, "host-file")


def root_acks(acks: DataFrame, roots: DataFrame) -> DataFrame:
    """What the remote acknowledged for each root (root_id, tree_id, file_count) against the roots of the head."""
    return drift(acks, roots, "root_id", ["tree_id", "file_count"], "root-ack")


def only_expected(keys: DataFrame, expected: DataFrame, prefixes: list[str], check: str) -> DataFrame:
    """Keys under prefixes that nothing expects, and expected ones that are gone."""
    under = F.lit(False)
    for p in prefixes:
        under = under | F.col("key").startswith(p)
    return two_way(expected.where(under), keys.where(under), "key", check)


def lifecycle_rules(configured: DataFrame, applied: DataFrame) -> DataFrame:
    """Tier rules (prefix, days, class) that the store applies against those configured."""
    rule = F.concat_ws(":", "prefix", "days", "class").alias("rule")
    return two_way(configured.select(rule), applied.select(rule), "rule", "lifecycle")


def raise_first(found: DataFrame) -> None:
    """Stops at the first issue by check and key, as a clone does."""
    if row := found.where("severity = 'error'").orderBy("check", "key", "detail").first():
        raise ValueError(f"{row.check}: {row.key} {row.detail}".strip())


def repair_list(expected: DataFrame, present: DataFrame, local: DataFrame, after: str = "", n: int | None = None) -> DataFrame:
    """key, action of expected keys that the remote lacks, from the cursor ``after`` on: reupload where there is a local copy, else lost.

    ``n`` bounds one pass of a scan that goes on at its last key.
    """
    gone = expected.select("key").where(F.col("key") > after).distinct().join(present.select("key"), "key", "left_anti")
    here = local.select("key", F.lit(True).alias("here")).distinct()
    found = gone.join(here, "key", "left").select("key", F.when(F.col("here"), "reupload").otherwise("lost").alias("action"))
    return found if n is None else found.orderBy("key").limit(n)
