import time
from datetime import datetime, timedelta

import pytest

from chronolith.streaming import journal as J

T0 = datetime(2026, 1, 1)
SCHEMA = "event_id bigint, kind string, observed_at timestamp, synced_at timestamp"


def rows(spark, *kinds, synced=None):
    return spark.createDataFrame([(i, k, T0 + timedelta(seconds=10 * (i + 1)), synced) for i, k in enumerate(kinds)], SCHEMA)


@pytest.mark.parametrize(
    ("kinds", "n"), [(["fs-event"], 1), (["fs-event", "snapshot-finish"], 0), (["snapshot-finish", "periodic-rescan"], 1), (["event-journal-replay"], 0), (["fs-event", "snapshot-finish", "fs-event"], 1)]
)
def test_pending(spark, kinds, n):
    assert J.pending(rows(spark, *kinds)).count() == n


def test_synced_triggers_are_not_pending(spark):
    assert J.pending(rows(spark, "snapshot-finish", "fs-event", synced=T0), synced=True).count() == 0


def test_compaction_keeps_from_the_cutoffs(spark):
    got = J.compacted(rows(spark, "note", "fs-event", "snapshot-finish", "note", "fs-event", "snapshot-finish", "fs-event"))
    assert sorted(r.event_id for r in got.collect()) == [2, 3, 5, 6]


def test_gap_buffer_reasons():
    done, state = J.GapBuffer(250, 10**6, 100).feed(None, [0, 50, 400])
    assert done == [(0, 2, 50, "quiet")]
    assert state == (400, 400, 1)
    assert J.GapBuffer(1000, 10**6, 2).feed(None, [0, 1])[0] == [(0, 2, 1, "max-events")]
    done, _ = J.GapBuffer(50, 70, 100).feed(None, list(range(0, 150, 15)))
    assert done[0][3] == "max-latency" and done[0][1] > 1


def test_capped_batches_walk_each_key(spark):
    times = {"a": [0, 10, 20, 5000, 5010], "b": [0, 1, 2, 3, 4, 5, 6]}
    data = [(k, i, T0 + timedelta(milliseconds=t)) for k, ts in times.items() for i, t in enumerate(ts)]
    d = spark.createDataFrame(data, "path string, event_id bigint, observed_at timestamp")
    buffer = J.GapBuffer(1000, 10**6, 3)
    got = sorted((r.key, r.events, r.reason) for r in J.capped_batches(d, "path", buffer).collect())
    assert got == [("a", 2, "quiet"), ("a", 3, "max-events"), ("b", 1, "quiet"), ("b", 3, "max-events"), ("b", 3, "max-events")]


def test_stream_counts_late_rows_apart(spark, tmp_path):
    d = spark.createDataFrame([("p", False, T0), ("p", True, T0 + timedelta(seconds=1)), ("p", False, T0 + timedelta(hours=9))], "path string, tombstone boolean, observed_at timestamp")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = J.windowed(stream, "path", "10 seconds").writeStream.outputMode("append").format("memory").queryName("late_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.events, r.deletes) for r in spark.table("late_rows").collect()] == [(2, 1)]


def test_capped_batches_keep_null_keys(spark):
    d = spark.createDataFrame([(None, 1, T0), (None, 2, T0 + timedelta(seconds=1)), ("a", 3, T0)], "path string, event_id bigint, observed_at timestamp")
    got = {(r.key, r.events) for r in J.capped_batches(d, "path", J.GapBuffer(2000, 10**6, 100)).collect()}
    assert got == {(None, 2), ("a", 1)}


def test_capped_stream_closes_batches_by_count(spark, tmp_path):
    d = spark.createDataFrame([("a", i, T0 + timedelta(milliseconds=i)) for i in range(7)], "path string, event_id bigint, observed_at timestamp")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = J.capped_stream(stream, "path", J.GapBuffer(10**6, 10**7, 3)).writeStream.outputMode("append").format("memory").queryName("capped_rows").trigger(processingTime="200 milliseconds").start()
    deadline = time.time() + 60
    while spark.table("capped_rows").count() < 2 and time.time() < deadline:
        time.sleep(0.2)
    q.stop()
    assert [(r.key, r.events, r.reason) for r in spark.table("capped_rows").collect()] == [("a", 3, "max-events")] * 2


def test_a_live_difference_is_sent_once(spark, tmp_path):
    from chronolith.streaming import watch as W

    d = spark.createDataFrame([("r", "p", "o1", T0), ("r", "p", "o1", T0 + timedelta(seconds=5)), ("r", "p", "o2", T0)], "root_id string, path string, oid string, observed_at timestamp")
    d.write.parquet(str(tmp_path / "in"))
    q = W.once(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("once_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.oid for r in spark.table("once_rows").collect()} == {"o1", "o2"} and spark.table("once_rows").count() == 2


def test_periodic_events_come_from_a_rate(spark):
    from chronolith.streaming import watch as W

    p = W.periodic(spark, 5, value="r0")
    assert p.isStreaming and p.columns == ["event_id", "root_id", "kind", "observed_at"]
