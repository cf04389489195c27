"""Benchmark decontamination by winnowing (DataFrame functions only).

Hashes of 5-word grams are thinned by winnowing: of the six grams in a window of ten words the
least hash is kept, on both sides by the same rule. Two texts that share ten words in a row
therefore share the fingerprint of that window, so none is missed. Only documents with a fingerprint
of the benchmark go on: their windows are compared by the hash of all their words.

An item of fewer than ten words is one window of its own length; documents are then also
fingerprinted by every gram of that length (a winnowing window of one gram).

Defined cases: null texts have no words; rows are judged one by one, so rows that repeat a doc_id
(null included) each have a result of their own, and a document goes from ``drop_contaminated`` if any
of its rows is hit; null item_ids hit, but are not reported; empty tables give documents without hits,
or no rows; other columns, of any name, are not read and pass through ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
GRAM = 5
STEP = WINDOW - GRAM + 1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hashed(table: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, n (words) and h (word hashes)."""
    text = C.lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    d = table.select(*keys, F.array_remove(F.split(text, NOT_WORD), "").alias("w"))
    return d.select(*[c for c in d.columns if c != "w"], F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def _with_fours(d: DataFrame) -> DataFrame:
    c = F.col
    d = d.select("*", C.fold_pairs(c("h"), c("h"), 1, c("n") - 1).alias("h2"))
    return d.select("*", C.fold_pairs(c("h2"), c("h2"), 2, c("n") - 3).alias("h4"))


def fingerprints(d: DataFrame) -> DataFrame:
    """``d`` (n, h) with f, the fingerprint of each window of ten words."""
    c, kept = F.col, d.columns

    def least(a: str, b: str, gap: int, size: Column) -> Column:
        return F.zip_with(C.part(c(a), 0, size), C.part(c(b), gap, size), lambda a, b: F.least(a, b))

    d = _with_fours(d).select(*kept, C.fold_pairs(c("h4"), c("h"), 4, c("n") - 4).alias("h5"))
    d = d.select(*kept, least("h5", "h5", 1, c("n") - 5).alias("m2"))
    d = d.select(*kept, "m2", least("m2", "m2", 2, c("n") - 7).alias("m4"))
    return d.select(*kept, least("m4", "m2", 4, c("n") - 9).alias("f"))


def whole_windows(d: DataFrame) -> DataFrame:
    """``d`` (n, h) with g, the hash of each window of ten words."""
    c, kept = F.col, d.columns
    d = _with_fours(d).select(*kept, "h2", C.fold_pairs(c("h4"), c("h4"), 4, c("n") - 7).alias("h8"))
    return d.select(*kept, C.fold_pairs(c("h8"), c("h2"), 8, c("n") - 9).alias("g"))


def short_grams(h: Column, n: Column, size: int) -> Column:
    """Hashes of all grams of ``size`` words."""
    out = C.part(h, 0, n - size + 1)
    for i in range(1, size):
        out = F.zip_with(out, C.part(h, i, n - size + 1), lambda a, b: F.xxhash64(a, b))
    return out


def windows(benchmark: DataFrame) -> DataFrame:
    """item, size, f (fingerprint) and g (hash) of the distinct windows of each item."""
    d = whole_windows(fingerprints(hashed(benchmark, F.col("item_id").cast("string").alias("item")))).where("n > 0")
    whole = F.aggregate(C.part(F.col("h"), 1, F.col("n") - 1), F.element_at(F.col("h"), 1), lambda a, b: F.xxhash64(a, b))
    long_ones = F.arrays_zip(F.col("f").alias("f"), F.col("g").alias("g"))
    one = F.array(F.struct(whole.alias("f"), whole.alias("g")))
    d = d.select("item", F.least("n", F.lit(WINDOW)).alias("size"), F.explode(F.when(F.col("n") < WINDOW, one).otherwise(long_ones)).alias("x"))
    return d.select("item", "size", "x.f", "x.g").distinct()


@C.scoped
def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of strings, sorted), spans (array of word ranges), for each row."""
    c = F.col
    bench = C.materialize(windows(benchmark), "benchmark-windows")
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect() if r[0] < WINDOW)  # at most nine values
    key = F.xxhash64("text").alias("key")
    marker = F.struct(F.lit(0).alias("size"), F.xxhash64("doc_id").alias("f"))

    def places(size: int, grams: Column) -> Column:
        return F.transform(grams, lambda g: F.struct(F.lit(size).alias("size"), g.alias("f")))

    # a row of its own for each row of docs, beside its distinct fingerprints; equal rows are counted
    d = fingerprints(hashed(docs, "doc_id", key))
    each = [F.array(marker), places(WINDOW, F.array_distinct("f")), *(places(k, F.array_distinct(short_grams(c("h"), c("n"), k))) for k in sizes)]
    d = d.select("doc_id", "key", "n", F.explode(F.concat(*each)).alias("x")).select("doc_id", "key", "n", "x.*")
    prints = C.join_side(C.materialize(bench.select(c("size").alias("b_size"), c("f").alias("b_f")).distinct(), "benchmark-prints"))
    d = d.join(prints, (c("size") == c("b_size")) & (c("f") == c("b_f")), "left").where("size = 0 OR b_f IS NOT NULL")
    rows = d.groupBy("doc_id", "key").agg(F.max("n").alias("n"), F.count_if(c("size") == 0).alias("copies"), F.bool_or(c("size") > 0).alias("asked"))
    rows = C.materialize(rows, "contamination-rows")

    asked = C.join_side(C.materialize(rows.where("asked").select(c("doc_id").alias("of_id"), c("key").alias("of_key")), "contamination-asked"))
    near = docs.select("doc_id", "text", key).join(asked, c("doc_id").eqNullSafe(c("of_id")) & (c("key") == c("of_key")), "left_semi")
    w = whole_windows(hashed(near, "doc_id", "key"))

    def placed(size: int, grams: Column) -> Column:
        return F.transform(grams, lambda g, i: F.struct(F.lit(size).alias("size"), g.alias("g"), i.alias("at")))

    all_grams = [placed(WINDOW, c("g")), *(placed(k, short_grams(c("h"), c("n"), k)) for k in sizes)]
    w = w.select("doc_id", "key", F.explode(F.concat(*all_grams)).alias("x")).select("doc_id", "key", "x.*")
    known = C.join_side(C.materialize(bench.select(c("size").alias("b_size"), c("g").alias("b_g")).distinct(), "benchmark-grams"))
    found = w.join(known, (c("size") == c("b_size")) & (c("g") == c("b_g")), "left_semi").distinct()
    found = C.materialize(found, "contamination-found")
    span = F.struct(c("at").cast("long").alias("s"), (c("at") + c("size")).cast("long").alias("e"))
    spans = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    # the items of a window come last, and one by one: a window of many items meets each window of a document once
    of_item = bench.where("item IS NOT NULL").select(c("size").alias("b_size"), c("g").alias("b_g"), "item")
    items = found.select("doc_id", "key", "size", "g").distinct().join(C.join_side(of_item), (c("size") == c("b_size")) & (c("g") == c("b_g")))
    items = items.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(items, spans.doc_id.eqNullSafe(items.doc_id) & spans.key.eqNullSafe(items.key), "left").select(spans.doc_id.alias("of_id"), spans.key.alias("of_key"), "spans", "items")
    found = C.materialize(found, "contamination-spans")
    d = rows.join(found, c("doc_id").eqNullSafe(c("of_id")) & (c("key") == c("of_key")), "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    d = d.select("doc_id", c("n").cast("long").alias("n_words"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"), F.explode(F.sequence(F.lit(1), c("copies").cast("int"))).alias("copy"))
    zero = F.lit(0).cast("long")
    swept = F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("to")), lambda a, s: F.struct((a.n + F.greatest(zero, s.e - F.greatest(a.to, s.s))).alias("n"), F.greatest(a.to, s.e).alias("to")))
    return d.select("doc_id", "n_words", swept.n.alias("n_hit"), "items", "spans")


@C.scoped
def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document shares no window with the benchmark."""
    (bad_id,) = C.fresh(docs, "bad_id")
    bad = C.materialize(hits(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias(bad_id)).distinct(), "contaminated")
    return docs.join(C.join_side(bad), F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti")
