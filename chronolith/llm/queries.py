"""The queries of this subpackage: thin digests over the operators, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontam, line_dedup, near_dup, pii, quality, secrets, spm, substring_dedup, token_counts, url_filter

MODEL = "piece_bpe_32k.model"
MAX_TOKENS = 4096


def _tokenizer(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda m: m.k == kind)).cast("long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that every call counts the whole table."""
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer(), C.new_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer(), token_ids=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [_of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda m: m.k < 3)
    counts = [_of_kind("spans", k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def url_lists(pages: DataFrame) -> DataFrame:
    """Dated entries of three lists, made from the hosts of ``pages`` by the digits of their MD5 (the tables hold no lists)."""
    site = url_filter.host(F.col("url"))
    hosts = pages.select(site.alias("host")).where("host <> ''").distinct()
    digit = lambda i: F.conv(F.substring(F.md5("host"), i, 2), 16, 10).cast("int")
    h = hosts.select("host", digit(1).alias("a"), digit(3).alias("b"), digit(5).alias("c"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp")
    key = F.when(F.col("c") % 3 == 0, F.concat("host", F.lit("/en"))).otherwise(F.col("host"))
    name = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), F.col("b") % 3 + 1)
    add = h.where("a % 4 < 2").select(name.alias("list"), key.alias("key"), F.lit("add").alias("action"), day(F.col("b")).alias("dated_at"))
    drop = h.where("a % 4 = 1").select(name.alias("list"), key.alias("key"), F.lit("remove").alias("action"), day(F.col("b") + 20 + F.col("c") % 60).alias("dated_at"))
    again = h.where("a % 8 = 1").select(name.alias("list"), key.alias("key"), F.lit("add").alias("action"), day(F.col("b") + 100 + F.col("c") % 50).alias("dated_at"))
    return add.unionByName(drop).unionByName(again)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of ``pages`` at times made from page_id, as the table holds none."""
    pages = _table(spark, sf_dir, "pages")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 366 * 86400 + (F.col("page_id") * 104729) % 86400)
    judged = url_filter.evaluate(pages.select("page_id", "url", at.alias("fetched_at")), url_lists(pages))
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m.list, m.key)), ",")
    return judged.select("page_id", "host", F.size("matches").cast("long").alias("n_matches"), listed.alias("matches"), (F.size("matches") > 0).alias("blocked"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
}
