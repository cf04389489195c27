"""Content operators applied to documents; no SQL, tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import content as K
from . import views as V


@query()
def content_chunks(spark, d):
    """Content-defined chunks of all documents, target 4096 bytes."""
    return K.cdc_chunks(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 4096)


@query()
def document_line_diff(spark, d):
    """Line diff of each document against the one before it of the same source and language."""
    docs = V.table(spark, d, "documents")
    # only ids go through the window; the texts meet by id
    before = docs.select("doc_id", F.lag("doc_id").over(Window.partitionBy("source", "lang").orderBy("doc_id")).alias("old_id")).where("old_id IS NOT NULL")
    pairs = before.join(docs.select("doc_id", "text"), "doc_id").join(docs.select(F.col("doc_id").alias("old_id"), F.col("text").alias("old")), "old_id").where("old IS NOT NULL")
    return pairs.select("doc_id", F.sha2(F.coalesce(K.line_diff(F.col("old"), F.col("text")), F.lit("")), 256).alias("diff_sha256"))


@query()
def compression_gain(spark, d):
    """What compressing each document saves, in whole percent, and whether that is anything."""
    gain = K.sampled_gain(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", gain.alias("gain")).select("doc_id", F.floor(F.col("gain") * 100).cast("bigint").alias("percent"), (F.col("gain") > 0).alias("gains"))


@query("SELECT 'objects{category=\"' || category || '\"} ' || n || '.0' AS line FROM (SELECT CASE WHEN starts_with(key, 'objects/') THEN 'payload' WHEN starts_with(key, 'large/chunks/') THEN 'chunk' ELSE 'manifest' END AS category, count(*) AS n FROM remote_objects GROUP BY 1)")
def metrics_text(spark, d):
    from ..operators.storage import category
    from ..sources import io

    per = V.remote_objects(spark, d).groupBy(category(F.col("key")).alias("category")).agg(F.count("*").alias("n"))
    return io.exposition(io.metrics(("objects", per)))
