"""Token counts through a digest cache.

Counts are kept in a table under ``cache_path``, a folder for each tokenizer version, keyed by the
digest of the normalised content. Normalising must not change a count, so it only turns null into
the empty text. Distinct contents that the cache lacks are encoded and appended; then every
document gets its count by a join on the digest.

Counting a miss: the tokenizer's pieces never have a space marker after another character, nor a
line feed beside another one, so merges never cross the start of a word or a line; the words of a
batch are encoded once each by the library and their counts are added up.

Defined cases: null and empty texts have 0 tokens; texts of any length are taken whole, a stretch at a
time; repeated rows give repeated results, rows without doc_id (of any type) too; an empty table gives
an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .spm import MARK, KnownWords, stretches

def tokenizer_digest(path: str) -> str:
    """Of the model file and the library's version."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def count_words(model, texts: list[str], known: KnownWords) -> list[int]:
    """Tokens of each text; ``known`` gains short words."""
    totals = [0] * len(texts)
    for group in stretches(texts):
        every = set().union(*(units for _, units in group))
        new = list(every - known.of.keys())
        # the library puts a marker in front of what it is given; a word that begins with one gives it up for that
        plain = [u[1:] if u[0] == MARK else None for u in new]
        coded = iter(model.encode([p for p in plain if p], num_threads=1))
        fresh = {u: len(next(coded)) if p else 1 if p == "" else _bare(model, u) for u, p in zip(new, plain, strict=True)}
        now = known.taken(every, fresh)
        for k, units in group:
            totals[k] += sum([now[u] for u in units])
    return totals


def _bare(model, unit: str) -> int:
    """Tokens of what follows a line feed, where no marker stands in front."""
    return len(model.encode("\n" + unit)) - len(model.encode("\n"))


def _encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of digest, text."""
    with open(path, "rb") as f:
        shared = misses.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, known = sentencepiece.SentencePieceProcessor(model_proto=shared.value), KnownWords()
        for batch in batches:
            counts = count_words(model, batch.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


@C.scoped
def token_counts(docs: DataFrame, path: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, content_digest (hex) for each row of ``docs``; the cache gains what it lacked."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    folder = f"{cache_path}/tokenizer={tokenizer_digest(path)}"
    schema = "digest binary, n_tokens bigint"
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)  # so that it exists
    cached = spark.read.schema(schema).parquet(folder).dropDuplicates(["digest"])
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    _encode_misses(distinct.join(cached, "digest", "left_anti"), path).write.mode("append").parquet(folder)
    # written without repeats, so that the join's sides are plain shuffles, which adaptive execution splits at a hot digest
    cached = C.materialize(spark.read.schema(schema).parquet(folder).dropDuplicates(["digest"]), "token-counts")
    narrow = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return narrow.join(cached, "digest", "left").select("doc_id", "n_bytes", "n_tokens", F.lower(F.hex("digest")).alias("content_digest"))
