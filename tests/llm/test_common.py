from pyspark.sql import functions as F

from chronolith.llm import common as C


def test_words_split_at_ascii_space_only(spark):
    d = spark.createDataFrame([(" a\tb\x0bc\x0c\r\nd e ",), (None,), ("",), (" \n",)], "x string")
    assert [r[0] for r in d.select(C.words(F.col("x"))).collect()] == [["a", "b", "c", "d e"], [], [], []]


def test_lower_ascii_leaves_other_letters(spark):
    d = spark.createDataFrame([("ABC Éé",), ("XYZ",)], "x string")
    assert [r[0] for r in d.select(C.lower_ascii(F.col("x"))).collect()] == ["abc Éé", "xyz"]


def test_materialize_keeps_rows_and_restores_settings(spark):
    before = {k: spark.conf.get(k, None) for k in C.CLEANUP}
    assert C.materialize(spark.range(10).repartition(3), "t").count() == 10
    assert before == {k: spark.conf.get(k, None) for k in C.CLEANUP}


def test_the_shared_folder_is_the_session_s_where_it_names_one():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "file:///shared/" if key == "spark.checkpoint.dir" else default)

    assert C.shared_dir(Session) == "file:///shared"


def test_join_side_broadcasts_only_small_tables(spark):
    d = spark.range(100)
    assert "ResolvedHint" in C.join_side(d)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in C.join_side(d, 50)._jdf.queryExecution().analyzed().toString()


def test_a_wide_side_is_not_broadcast(spark):
    d = spark.range(100).select(F.expr("repeat('x', 1000)").alias("t"), F.array(F.lit("y")).alias("a"))
    before, C.BROADCAST_BYTES = C.BROADCAST_BYTES, 50_000
    try:
        assert "ResolvedHint" not in C.join_side(d)._jdf.queryExecution().analyzed().toString()
    finally:
        C.BROADCAST_BYTES = before
    assert "ResolvedHint" in C.join_side(d)._jdf.queryExecution().analyzed().toString()


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1000]"

    with pytest.raises(RuntimeError):
        C.shared_dir(Session)
