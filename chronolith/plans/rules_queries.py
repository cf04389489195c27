"""Path rules, filters and table mutations applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..operators import mutation as M
from ..registry import query
from . import views as V


def _paths(spark, d):
    size, n = F.col("p_size"), F.replace("p_name", F.lit(" "), F.lit("/"))
    ext = F.element_at(F.array(*map(F.lit, (".JSON", ".txt", "/tmp/x", ".md"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", F.concat(n, ext).alias("path"), size.alias("size"))


PATHS_SQL = "paths AS (SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_partkey % 4 WHEN 0 THEN '.JSON' WHEN 1 THEN '.txt' WHEN 2 THEN '/tmp/x' ELSE '.md' END AS path, p_size AS size FROM part)"


@query(
    f""", {PATHS_SQL} SELECT p_partkey, path, CASE WHEN path LIKE 'blue/%' THEN false WHEN path LIKE 'green/%/tmp/x' THEN true
    WHEN NOT (path LIKE '%.txt' OR lower(path) LIKE '%.json' OR path LIKE 'red/%') THEN false
    WHEN path LIKE '%/tmp/%' OR path LIKE '%/tmp' THEN path LIKE 'red/%' ELSE true END AS managed FROM paths"""
)
def managed_paths(spark, d):
    rule = P.managed(F.col("path"), ["*.txt", "*.json", "red/**"], ["**/tmp/**"], ["green/*/tmp/x"], ["blue"])
    return _paths(spark, d).select("p_partkey", "path", rule.alias("managed"))


@query(f", {PATHS_SQL} SELECT p_partkey, CASE WHEN starts_with(path, 'red/bolt/') THEN 'red/bolt' WHEN starts_with(path, 'red/') THEN 'red' WHEN starts_with(path, 'blue/') THEN 'blue' END AS root FROM paths")
def deepest_root(spark, d):
    return _paths(spark, d).select("p_partkey", P.deepest_root(["red", "blue", "red/bolt"], F.col("path")).alias("root"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN false WHEN lang = 'fr' THEN true ELSE n_chars >= 6000 OR (source = 'src1' AND n_chars >= 100) END AS is_large FROM documents")
def large_classifier(spark, d):
    rule = S.pick_large(F.col("n_chars"), F.col("source") == "src1", 6000, 100, F.col("lang") == "fr", F.col("lang") == "de")
    return V.table(spark, d, "documents").select("doc_id", F.coalesce(rule, F.lit(False)).alias("is_large"))


@query("SELECT event_id, coalesce(CASE WHEN root_id = 'r1' THEN 1000 WHEN root_id = 'r2' THEN 5000 END, 131072) AS limit_bytes, size >= coalesce(CASE WHEN root_id = 'r1' THEN 1000 WHEN root_id = 'r2' THEN 5000 END, 131072) AS is_large FROM journal")
def config_overlay(spark, d):
    """Per-root settings over the global one, by a broadcast of the (configured, hence few) roots."""
    own = spark.createDataFrame([("r1", 1000), ("r2", 5000)], "root_id string, own bigint")
    limit = F.coalesce("own", F.lit(131072).cast("bigint"))
    return V.journal(spark, d).join(own, "root_id", "left").select("event_id", limit.alias("limit_bytes"), (F.col("size") >= limit).alias("is_large"))


@query("SELECT root_id, path, CASE WHEN n > 3 THEN 'skipped' ELSE 'tracked' END AS verdict FROM (SELECT root_id, path, count(*) OVER (PARTITION BY root_id) AS n FROM (SELECT DISTINCT root_id, path FROM journal WHERE event_id >= 500) WHERE (root_id, path) NOT IN (SELECT (root_id, path) FROM journal WHERE event_id < 500))")
def unknown_path_guard(spark, d):
    """Paths that appear first after event 500; a root with more than three of them has them all skipped."""
    j = V.journal(spark, d)
    new = j.where("event_id >= 500").select("root_id", "path").distinct().join(j.where("event_id < 500").select("root_id", "path").distinct(), ["root_id", "path"], "left_anti")
    many = new.groupBy("root_id").agg(F.count("*").alias("n"))
    return new.join(many, "root_id").select("root_id", "path", F.when(F.col("n") > 3, "skipped").otherwise("tracked").alias("verdict"))


UPSERT_SQL = ", t AS (SELECT event_id AS id, size AS v FROM journal WHERE event_id % 3 <> 0), u AS (SELECT event_id AS id, size + 1 AS v FROM journal WHERE event_id % 2 = 0)"


def _upsert_sides(spark, d):
    j = V.journal(spark, d)
    return j.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("size").alias("v")), j.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("size") + 1).alias("v"))


@query(f"{UPSERT_SQL} SELECT coalesce(u.id, t.id) AS id, coalesce(u.v, t.v) AS v FROM t FULL OUTER JOIN u ON t.id = u.id")
def upsert_last_wins(spark, d):
    return M.upsert(*_upsert_sides(spark, d), ["id"])


@query(f"{UPSERT_SQL} SELECT coalesce(t.id, u.id) AS id, coalesce(t.v, u.v) AS v FROM t FULL OUTER JOIN u ON t.id = u.id")
def insert_or_ignore(spark, d):
    return M.insert_or_ignore(*_upsert_sides(spark, d), ["id"])


@query(", t AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'explicit' ELSE 'snapshot' END AS source FROM journal WHERE event_id % 3 <> 0), u AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'journal' ELSE 'snapshot' END AS source FROM journal WHERE event_id % 2 = 0) SELECT coalesce(t.id, u.id) AS id, CASE WHEN t.id IS NULL THEN u.source WHEN u.id IS NULL OR t.source = 'explicit' OR u.source = 'snapshot' THEN t.source ELSE u.source END AS source FROM t FULL OUTER JOIN u ON t.id = u.id")
def track_sources(spark, d):
    """The explicit source stays, and snapshot never overwrites another source."""
    j = V.journal(spark, d)
    t = j.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "explicit").otherwise("snapshot").alias("source"))
    u = j.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "journal").otherwise("snapshot").alias("source"))
    return M.merge_sources(t, u, "id")


@query("SELECT id, key, attempts FROM (SELECT id, key, attempts FROM upload_queue WHERE attempts <> 2 UNION ALL SELECT id, key || '.new', 0 FROM upload_queue WHERE attempts = 2)")
def enqueue_keeps_retries(spark, d):
    """Queue items with attempts other than 2 are enqueued anew and keep their attempts; the others come new under a new key."""
    q = V.upload_queue(spark, d).select("id", "key", "attempts")
    had = q.where("attempts <> 2")
    again = q.select("id", F.when(F.col("attempts") == 2, F.concat("key", F.lit(".new"))).otherwise(F.col("key")).alias("key"))
    return M.enqueue(had, again, "key")
