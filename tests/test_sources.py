import random
import zlib

from pyspark.sql import functions as F

from chronolith.sources import content as K
from chronolith.sources import io


def test_listing_and_contents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"hello")
    (tmp_path / "y.txt").write_bytes(b"1")
    (tmp_path / "a" / "none.txt").write_bytes(b"")
    folder = f"file://{tmp_path}"
    want = {("a/x.txt", 5), ("y.txt", 1), ("a/none.txt", 0)}
    assert {(r.key, r["size"]) for r in io.listing(spark, folder).collect()} == want
    assert {(r.key, r["size"]) for r in io.contents(spark, folder).collect()} == want
    assert {r.key for r in io.listing(spark, folder, "x*").collect()} == {"a/x.txt"}
    row = io.contents(spark, folder).where("key = 'a/x.txt'").select(io.byte_range(F.col("content"), 1, 3).alias("c")).first()
    assert bytes(row.c) == b"ell"


def test_queue_drops_and_counts_bad_documents(spark, tmp_path):
    for name, text in (("b", '{"id": 2, "at": "t2"}'), ("a", '{"id": 1, "at": "t1"}'), ("bad", "{nope")):
        (tmp_path / f"{name}.json").write_text(text)
    schema = "id bigint, at string"
    assert [r.id for r in io.json_queue(spark, str(tmp_path), schema, ["at"]).where("id IS NOT NULL").collect()] == [1, 2]
    assert io.rejected_documents(spark, str(tmp_path), schema) == 1


def test_put_if_absent_is_idempotent(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v bigint")
    folder = f"{tmp_path}/t"
    assert io.put_if_absent(d, folder, "key") == 2
    assert io.put_if_absent(d.unionByName(spark.createDataFrame([("c", 3)], d.schema)), folder, "key") == 1


def test_commit_skips_equal_versions(spark, tmp_path):
    rec = spark.createDataFrame([("r", "p", "o", 1, 0)], "root_id string, path string, oid string, size bigint, mode bigint")
    assert io.commit(rec, None, f"{tmp_path}/s", "snap-1")
    assert not io.commit(rec, rec, f"{tmp_path}/s", "snap-2")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 1
    assert not io.commit(rec, None, f"{tmp_path}/s", "snap-1")  # a retry
    assert io.commit(rec.withColumn("mode", F.lit(7).cast("bigint")), rec, f"{tmp_path}/s", "snap-2")
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("snapshot_id").count().count() == 2


def test_live_scan_hashes_changed_files_only(spark):
    listed = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], "key string, size bigint, modified bigint")
    old = spark.createDataFrame([("a", "oa", 1, 10), ("b", "ob", 2, 19)], "key string, oid string, size bigint, modified bigint")
    fresh = spark.createDataFrame([("b", "nb"), ("c", "nc")], "key string, oid string")
    assert {(r.key, r.oid) for r in io.live_scan(listed, old, fresh).collect()} == {("a", "oa"), ("b", "nb"), ("c", "nc")}


def test_carried_forward_and_cached_listing_and_audit(spark, tmp_path):
    schema = "root_id string, path string"
    now, old = spark.createDataFrame([("r1", "n")], schema), spark.createDataFrame([("r1", "o"), ("r2", "o"), ("r3", "o")], schema)
    assert {tuple(r) for r in io.carried_forward(now, old, ["r2", "r3"], ["r3"]).collect()} == {("r1", "n"), ("r2", "o")}
    saved = spark.createDataFrame([("k", 100), ("l", 30)], "key string, fetched_at bigint")
    assert {(r.key, r.exact) for r in io.cached_listing(saved, 150).collect()} == {("k", True), ("l", False)}
    io.append_audit(now, str(tmp_path / "log"))
    io.append_audit(old, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_export_import_and_hosts(spark, tmp_path):
    d = spark.createDataFrame([(1, "x")], "id bigint, big string")
    io.export_tables({"t": d}, str(tmp_path / "e"), {"t": ["big"]})
    back = io.import_tables(spark, str(tmp_path / "e"), ["t"])["t"]
    assert back.columns == ["id"]
    assert {(r.host, r.big) for r in io.union_hosts({"h1": d, "h2": back}).collect()} == {("h1", "x"), ("h2", None)}


def test_exposition(spark):
    d = spark.createDataFrame([('a"b', 2)], "root string, n bigint")
    assert io.exposition(io.metrics(("files", d))).first()[0] == 'files{root="a\\"b"} 2.0'


def plain_cuts(data, target):
    """Byte by byte."""
    target = max(target, 1024)
    least, most = min(max(target // 4, 1024), target), 4 * target
    mask = 1
    while mask < target:
        mask *= 2
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        turned = ((h << 1) & (2**64 - 1)) + (h >> 63)
        h = (turned + b) % 2**64 * 0x9E3779B185EBCA87 % 2**64
        if (i + 1 - start >= least and h % mask == 0) or i + 1 - start == most:
            out.append((start, i + 1))
            start = i + 1
    return out + ([(start, len(data))] if start < len(data) else [])


def test_content_chunks_are_those_of_a_plain_loop():
    rng = random.Random(1)
    datas = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 3, 46, 47, 48, 59, 1023, 1024, 1025, 5000, 60_000, *range(100, 2000, 130))]
    datas += [b"a" * 20_000, b"\0" * 9000, b"ab" * 3000]
    for target in (10, 1024, 2048, 3000, 4096, 5000):
        assert K.cut_points(datas, target) == [plain_cuts(d, target) for d in datas]
    assert K.cut_points([b""], 2048) == [[]]


def test_content_chunks_of_short_and_null_texts(spark):
    d = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "x" * 46)], "doc_id bigint, text string")
    assert {(r.doc_id, r.idx, r["len"]) for r in K.cdc_chunks(d, "doc_id", "text", 4096).collect()} == {(1, 0, 3), (4, 0, 46)}


def test_gain_is_that_of_the_whole_after_the_sample(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    random_bytes = bytes(rng.randrange(256) for _ in range(100_000))
    plain = lambda b: 1 - len(zlib.compress(b, 6)) / len(b) if b else 0.0
    texts = ["a" * 65536 + noise(100_000), noise(70_000) + "b" * 100_000, "ab " * 10, "q7", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {r.id: r.g for r in d.select("id", K.sampled_gain("t").alias("g")).collect()}
    assert got == {i: plain((t or "").encode()) for i, t in enumerate(texts)}
    assert got[3] < 0
    gated = {r.id: r.g for r in d.select("id", K.sampled_gain("t", 0.5).alias("g")).collect()}
    assert gated == got | {1: plain(texts[1][:65536].encode())} and got[1] > 0.5
    b = spark.createDataFrame([(0, random_bytes), (1, random_bytes[:65536] + bytes(10**6))], "id bigint, t binary")
    assert {r.id: r.g for r in b.select("id", K.sampled_gain("t").alias("g")).collect()} == dict.fromkeys((0, 1), plain(random_bytes[:65536]))  # the sample has no gain: no more is compressed


def test_line_diff(spark):
    d = spark.createDataFrame([("a\nb", "a\nc"), ("a\0", "b")], "o string, n string")
    got = [r[0] for r in d.select(K.line_diff("o", "n")).collect()]
    assert "-b" in got[0] and "+c" in got[0] and got[1] is None


def test_hooks_run_around_a_scan_even_if_it_fails(spark, tmp_path):
    from chronolith.sources import plugins as G

    (tmp_path / "live").mkdir()
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy" / "f").write_bytes(b"abc")
    said = []
    note = lambda what: lambda values: said.append((what, values["ROOT_ID"]))
    root = G.Root("r1", f"file://{tmp_path}/live", f"file://{tmp_path}/copy", [note("before")], [note("after")], lambda phase, v: said.append((phase, v["ROOT_ID"])))
    assert [(r.key, r["size"], r.root_id) for r in G.scan(spark, root).collect()] == [("f", 3, "r1")]
    assert [x for x, _ in said] == ["before", "begin", "end", "after"]
    try:
        with G.captured(root):
            raise OSError
    except OSError:
        pass
    assert [x for x, _ in said[4:]] == ["before", "begin", "end", "after"]
    mark = tmp_path / "mark"
    G.command(f'echo "$ROOT_ID" > {mark}')({"ROOT_ID": "r7"})
    assert mark.read_text() == "r7\n"


def test_folder_store(spark, tmp_path):
    import pytest

    from chronolith.sources import plugins as G

    store = G.FolderStore(spark, f"file://{tmp_path}")
    store.put("a/b", b"one")
    store.put("a/b", b"two")
    store.put("c", b"")
    assert store.get("a/b") == b"two" and store.exists("c") and not store.exists("d")
    assert {r.key for r in store.keys("a/").collect()} == {"a/b"}
    store.delete("a/b")
    assert not store.exists("a/b")
    for bad in ("", "/x", "a/../b", "a//b"):
        with pytest.raises(ValueError):
            store.put(bad, b"")


def test_notices_and_steps_of_a_batch(spark):
    from chronolith.sources import plugins as G
    from chronolith.streaming import watch as W

    got, seen = [], []
    W.after_each_batch(G.notices(got.append), lambda batch, epoch: seen.append((batch.count(), epoch)))(spark.createDataFrame([(1, None)], "n bigint, why string"), 4)
    assert got == [{"N": "1", "WHY": ""}] and seen == [(1, 4)]
    assert W.within_memory(2048) and not W.within_memory(2049) and W.within_memory(9999, 0)


def test_report_lines_as_json(spark):
    from chronolith.sources import plugins as G

    assert G.as_lines(spark.createDataFrame([(1, None)], "n bigint, why string"), "json").first()[0] == '{"n":1,"why":null}'


def test_one_writer_at_a_time(spark, tmp_path):
    import threading

    import pytest

    folder = f"file://{tmp_path}/t"
    (tmp_path / "t").mkdir()
    with io.locked(spark, folder), pytest.raises(TimeoutError), io.locked(spark, folder, wait=0.3):
        pass
    d = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v bigint")
    added = []
    threads = [threading.Thread(target=lambda: added.append(io.put_if_absent(d, folder, "key"))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(added) == [0, 0, 2] and spark.read.parquet(folder).count() == 2


def test_torn_lines_of_a_log_raise(spark):
    import pytest

    ops = spark.createDataFrame([("o1", "gc", None, "s1")], io.OPERATION)
    line = io.encode_operations(ops).first()[0]
    assert io.decode_operations(spark.createDataFrame([(line,)], "line string")).first() == ops.first()
    with pytest.raises(Exception, match="not an operation"):
        io.decode_operations(spark.createDataFrame([(line[:-3],)], "line string")).collect()
