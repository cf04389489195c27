import pytest
from pyspark.sql import functions as F

from chronolith.functions import paths as P
from chronolith.functions import scalars as S


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("10m", 600), ("2h", 7200), ("10 minutes ago", 600), ("1 day ago", 86400), ("yesterday", None)])
def test_relative_time(spark, text, want):
    assert one(spark, S.relative_seconds, text) == want


def test_absolute_time(spark):
    shown = one(spark, lambda c: F.date_format(S.absolute_time(c), "yyyy-MM-dd HH:mm:ss"), "2031-02-28T23:30:15-02:30")
    assert shown == "2031-03-01 02:00:15"


@pytest.mark.parametrize(("text", "want"), [("1.5GiB", 1610612736), ("20 mb", 20_000_000), ("512", 512), ("1k", 1000), ("x", None)])
def test_byte_size(spark, text, want):
    assert one(spark, S.byte_size, text) == want


@pytest.mark.parametrize(("text", "want"), [("250", 250), ("2s", 2000), ("3m", 180000), ("1h", 3600000), ("1d", 86400000)])
def test_duration(spark, text, want):
    assert one(spark, S.duration_ms, text) == want


@pytest.mark.parametrize(("n", "want"), [(0, 5), (1, 5), (2, 10), (7, 300), (50, 300)])
def test_backoff(spark, n, want):
    assert spark.range(1).select(S.backoff_seconds(F.lit(n))).first()[0] == want


@pytest.mark.parametrize(("path", "spec", "want"), [("a/b", "a", True), ("ab", "a", False), ("a", "./a/", True), ("x", "", True)])
def test_pathspec_by_component(spark, path, spec, want):
    assert one(spark, lambda c: P.under(c, spec), path) is want


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("**", "a/b", True), ("*.txt", "a/B.TXT", True), ("dir/**", "dir", True), ("dir/**", "dir/x/y", True), ("dir/**", "dirx", False), ("**/x/**", "a/x/b", True), ("**/x/**", "ax/b", False), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/b/c", False), ("a", "a/b", True)],
)
def test_glob(spark, pattern, path, want):
    assert one(spark, lambda c: P.matches_globs(c, [pattern]), path) is want


def test_exclude_expansion():
    assert {".git", "/.git", "**/.git"} <= set(P.expand_exclude("**/.git/**"))


@pytest.mark.parametrize(
    ("path", "rules", "want"),
    [
        ("build/out/report.csv", {"include": ["**"], "exclude": ["build/**"], "track": ["build/out/report.csv"]}, True),
        ("build/out/log.csv", {"include": ["**"], "exclude": ["build/**"], "track": ["build/out/report.csv"]}, False),
        ("vendor/lib/table.csv", {"include": ["*.csv"], "exclude": ["vendor/**"]}, False),
        ("lib/table.csv", {"include": ["*.csv"], "exclude": ["vendor/**"]}, True),
        ("x", {"include": ["**"], "exclude": [], "track": ["x"], "untrack": ["x"]}, False),
    ],
)
def test_managed_precedence(spark, path, rules, want):
    assert one(spark, lambda c: P.managed(c, **rules), path) is want


@pytest.mark.parametrize(("key", "want"), [("a/b", True), ("", False), ("/a", False), ("a//b", False), ("a/../b", False), ("a\\b", False), (None, False)])
def test_key_validity(spark, key, want):
    assert one(spark, P.valid_key, key) is want


@pytest.mark.parametrize(("name", "want"), [("My Host!", "My-Host"), ("..", "unknown-host"), (None, "unknown-host")])
def test_host_label(spark, name, want):
    assert one(spark, S.host_label, name) == want


@pytest.mark.parametrize(("text", "want"), [("09:30", "2031-05-04 09:30:00"), ("14:00:01", "2031-05-03 14:00:01"), ("14:00", "2031-05-04 14:00:00"), ("24:00", None), ("noon", None)])
def test_clock_time_is_the_latest_one(spark, text, want):
    now = F.to_timestamp(F.lit("2031-05-04 14:00:00"))
    assert one(spark, lambda c: F.date_format(S.clock_time(c, now), "yyyy-MM-dd HH:mm:ss"), text) == want


def test_uri_escape(spark):
    assert one(spark, S.uri_escape, "a b/é*+~_.-") == "a%20b%2F%C3%A9%2A%2B~_.-"
    assert one(spark, lambda c: S.uri_escape(c, keep_slash=True), "a/b c") == "a/b%20c"
