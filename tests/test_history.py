from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolith.operators import history as H
from chronolith.operators import storage as T

REC = "root_id string, path string, oid string, size bigint, mode bigint"


def test_operation_diff(spark):
    old = spark.createDataFrame([("r", "alpha.txt", "v1", 1, 0), ("r", "gamma.txt", "g", 1, 0), ("r", "same", "s", 1, 0)], REC)
    new = spark.createDataFrame([("r", "alpha.txt", "v2", 1, 0), ("r", "beta.txt", "b", 1, 0), ("r", "same", "s", 1, 0)], REC)
    assert {(r.path, r.status) for r in H.diff(old, new).collect()} == {("alpha.txt", "M"), ("beta.txt", "A"), ("gamma.txt", "D")}


@pytest.mark.parametrize(("level", "want"), [("record", {"M"}), ("payload", {"m"}), ("journal", {"modify"})])
def test_levels_of_equality(spark, level, want):
    old, new = spark.createDataFrame([("r", "p", "o", 1, 0)], REC), spark.createDataFrame([("r", "p", "o", 1, 7)], REC)
    assert {r.status for r in H.diff(old, new, level).collect()} == want


def test_retention_daily_and_monthly(spark):
    day = lambda m, d: datetime(2026, m, d, 12)
    s = spark.createDataFrame([("snap-4", day(6, 7)), ("snap-3", day(6, 6)), ("snap-2", day(5, 30)), ("snap-1", day(5, 1))], "id string, created_at timestamp")
    kept = {r.id for r in T.retention(s, 2, 1, "snap-1").collect() if r.keep}
    assert kept == {"snap-1", "snap-3", "snap-4"}
    assert {r.id for r in T.retention(s.where("id IN ('snap-1', 'snap-2')"), 0, 0, "snap-1").collect() if r.keep} == {"snap-1"}


def test_restore_counts(spark):
    wanted = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3"), ("r", "d", "4")], "root_id string, path string, oid string")
    live = spark.createDataFrame([("r", "b", "2"), ("r", "c", "x"), ("r", "d", "y"), ("r", "e", "5"), ("r", "longer", "6"), ("r", "f", "7"), ("other", "z", "8")], "root_id string, path string, oid string")
    plan = H.restore_plan(wanted, live)
    assert {r.action: r["count"] for r in plan.groupBy("action").count().collect()} == {"restore": 1, "keep": 1, "modify": 2, "delete": 3}
    assert [r.path for r in H.delete_order(plan).collect()] == ["longer", "e", "f"]


def test_availability_keeps_order(spark):
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    required = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "seq int, key string")
    got = T.availability(required, key("a"), key("b")).orderBy("seq").collect()
    assert [(r.key, r.state) for r in got] == [("a", "local"), ("b", "archived"), ("c", "missing")]


def test_next_fit_opens_a_pack_when_full(spark):
    items = spark.createDataFrame([("g", "a", 10), ("g", "b", 10), ("g", "c", 100), ("g", "d", 1)], "g string, oid string, size bigint")
    got = {r.oid: (r.pack_no, r.pack_offset, r.record_len) for r in T.next_fit(items, ["g"], ["oid"], "size", 40).collect()}
    assert got == {"a": (0, 0, 18), "b": (0, 18, 18), "c": (1, 0, 108), "d": (2, 0, 9)}


def test_utilization_rounds_down(spark):
    d = spark.createDataFrame([(0, 0), (1, 3), (2, 2)], "u bigint, t bigint")
    assert [r[0] for r in d.select(T.utilization(F.col("u"), F.col("t"))).collect()] == [100, 33, 100]


def test_id_prefix_wants_one_match(spark):
    rows = spark.createDataFrame([("snap-1",), ("snap-2",)], "id string")
    assert H.id_prefix(rows, "SNAP-1").count() == 1
    with pytest.raises(Exception, match="not one match"):
        H.id_prefix(rows, "snap-").collect()


def test_consecutive_changes_reports_gaps(spark):
    snaps = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "id string, seq int")
    rec = spark.createDataFrame([("s1", "r", "p", "o", 1, 0), ("s3", "r", "p", "o", 1, 0)], "snapshot_id string, " + REC)
    got = {(r.snapshot_id, r.status) for r in H.consecutive_changes(rec, snaps).collect()}
    assert got == {("s1", "A"), ("s2", "D"), ("s3", "A")}


def test_whole_queries_cover_every_snapshot_and_root(spark):
    from chronolith.api import QUERIES
    from chronolith.plans import views as V

    d = "/root/testdata/sf0.001"
    headers = QUERIES["snapshot_headers"](spark, d)
    assert headers.count() == V.snapshots(spark, d).count() > 1
    plan = QUERIES["restore_plan_all_roots"](spark, d)
    assert {r.root_id for r in plan.select("root_id").distinct().collect()} == {"r0", "r1", "r2", "r3"}
    scoped = QUERIES["restore_plan"](spark, d)
    assert sorted(map(tuple, scoped.collect())) == sorted(map(tuple, plan.where("root_id IN ('r0', 'r2')").select(*scoped.columns).collect()))


def test_lineage_of_thousands_and_of_gaps(spark):
    n = 2000
    snaps = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None) for i in range(n)], "id string, parent_id string")
    got = {r.id: r.depth for r in H.lineage(snaps, f"s{n - 1}").collect()}
    assert got == {f"s{i}": n - 1 - i for i in range(n)}
    assert [(r.id, r.depth) for r in H.lineage(snaps.where("id <> 's5'"), "s7").orderBy("depth").collect()] == [("s7", 0), ("s6", 1)]
    assert H.lineage(snaps, "none").count() == 0
    with pytest.raises(ValueError):
        H.lineage(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string"), "a")


def test_next_fit_over_many_records_of_a_group(spark):
    sizes = [(i * 7919) % 300 for i in range(5000)]
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)] + [("h", 0, 5000)], "g string, i bigint, size bigint")
    got = {(r.g, r.i): (r.pack_no, r.pack_offset, r.record_len) for r in T.next_fit(rows, ["g"], ["i"], "size", 1000).collect()}
    pack, used, want = 0, 0, {("h", 0): (0, 0, 5008)}
    for i, s in enumerate(sizes):
        if used and used + s + 8 > 1000:
            pack, used = pack + 1, 0
        want["g", i] = (pack, used, s + 8)
        used += s + 8
    assert got == want


def test_branch_changes_that_the_refs_forbid(spark):
    from chronolith.operators import control as C

    r = spark.createDataFrame([("current", "s2"), (C.ACTIVE, "main"), ("branches/main", "s2"), ("branches/old", "s1")], "name string, value string")
    as_dict = lambda d: {x.name: x.value for x in d.collect()}
    for change in (lambda: C.create_branch(r, "old", "s2"), lambda: C.set_head(r, "none", "s1"), lambda: C.switch_branch(r, "none"), lambda: C.rename_branch(r, "old", "old"), lambda: C.rename_branch(r, "old", "main"), lambda: C.delete_branch(r, "main")):
        with pytest.raises(C.BranchError):
            change()
    assert as_dict(C.delete_branch(r, "main", force=True)) == {"current": "s1", C.ACTIVE: "old", "branches/old": "s1"}
    assert as_dict(C.rename_branch(r, "old", "main", force=True)) == {"current": "s1", C.ACTIVE: "main", "branches/main": "s1"}
    assert as_dict(C.create_branch(r, "main", "s9", force=True))["current"] == "s9"


def test_restore_jobs_go_from_prepared_to_done(spark):
    from chronolith.operators import control as C

    need = spark.createDataFrame([(1, "a", "local"), (1, "b", "archived"), (1, "c", "archived"), (2, "d", "missing"), (3, "e", "local")], "job bigint, key string, state string")
    jobs = C.restore_jobs(need, "job")
    status = lambda d: {r.job: r.status for r in d.collect()}
    asked = C.request_archives(jobs, lambda k: k == "b")
    assert status(asked) == {1: "archive-requested", 2: "prepared", 3: "prepared"}
    assert {r.job: r.requested for r in asked.collect()}[1] == ["b"]
    half, whole = (C.hydrate(asked, lambda k, up=up: k.isin(*up)) for up in (["b"], ["b", "c"]))
    assert status(half)[1] == "archive-requested" and {r.job: (r.archived, r.requested) for r in half.collect()}[1] == (["c"], [])
    assert status(C.finish(whole)) == {1: "done", 2: "ready", 3: "done"}
    assert {r.job: r.blocked for r in C.finish(half).collect()} == {1: "archived objects pending: 1", 2: "missing objects: 1", 3: None}
