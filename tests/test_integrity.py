from chronolith.operators import integrity as I


def pairs(found):
    return {(r.check, r.key, r.detail) for r in found.collect()}


def test_local_refs(spark):
    refs = spark.createDataFrame([("current", "missing-snap"), ("last-synced", "not-time"), ("last-synced", "also-not-time"), ("legacy", "value")], "name string, value string")
    snaps = spark.createDataFrame([("snap-1",)], "id string")
    assert pairs(I.refs(refs, snaps)) == {
        ("missing-snapshot-ref", "current", "missing-snap"), ("invalid-last-synced", "last-synced", "not-time"), ("invalid-last-synced", "last-synced", "also-not-time"),
        ("duplicate-ref", "last-synced", "2"), ("unknown-ref", "legacy", "value"),
    }


def test_pack_index(spark):
    index = spark.createDataFrame([("a", 0, 4), ("b", 4, 5), ("extra", 9, 1)], "oid string, offset bigint, len bigint")
    blobs = spark.createDataFrame([("a", 0, 4), ("b", 4, 4), ("missing", 8, 4)], "oid string, pack_offset bigint, pack_len bigint")
    assert {(k, d) for _, k, d in pairs(I.pack_index(index, blobs))} == {("b", "EntryOffsetMismatch"), ("extra", "EntryWithoutBlobMetadata"), ("missing", "MissingBlobEntry")}


def test_missing_pack_metadata_once(spark):
    blobs = spark.createDataFrame([("1", "pack-a", 0, 1), ("2", "pack-a", 0, 1), ("3", "pack-b", 0, 1)], "oid string, pack_id string, pack_offset bigint, pack_len bigint")
    packs = spark.createDataFrame([("pack-b", 8)], "pack_id string, size bigint")
    assert [r.key for r in I.pack_bounds(blobs, packs).collect()] == ["pack-a"]


def test_severity_fold(spark):
    none = spark.createDataFrame([], "check string, severity string, key string, detail string")
    assert I.severity_fold(none).first().state == "protected"
    warn = spark.createDataFrame([("c", "warning", "k", "")], none.schema)
    assert I.severity_fold(warn).first().state == "degraded"
    assert I.severity_fold(warn.unionByName(spark.createDataFrame([("c", "error", "k", "")], none.schema))).first().state == "unprotected"
