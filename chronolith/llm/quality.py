"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document gets four counts, each out of a number of units: symbols by word, repeated lines by
line, repeated stretches by word, characters by word. KLL sketches of the rates, built per language
and source and mergeable across tasks, give each group a low, a middle and a high quantile; sketches
merge into those of the language and of all documents. A group's quantiles are drawn towards its
language's, and these towards all documents', by the weight docs / (docs + WEIGHT), so that no size
of a group switches anything. Its fences lie SPREAD times as far from the middle as the high (low)
quantile. A document is outside where its count differs from what the fence leads one to expect by
more than Z standard deviations of a count (square-root scale, Anscombe), so short documents get the
room that their size calls for. Nothing else is fixed: all limits follow the sketches.

Sketches hold the distinct texts of a group that pass the base rules, so that copies and what these
rules reject don't move the fences. A document is kept if it passes the base rules and no measure
is outside.

Defined cases: null or blank text has no words (base rule fails, not kept); null language or
source is a group of its own; repeated rows are judged one by one; an empty table gives an
empty result; columns of ``docs`` other than doc_id, text, lang and source, of any name, are not read,
and pass through ``keep_good`` untouched; rows without doc_id are one document there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Items that a sketch keeps at most in its top level; up to so many rows quantiles are exact.
SKETCH_K = 4096
LOW, MIDDLE, HIGH = 0.25, 0.5, 0.75
#: How many times as far as the low and high quantile the fences lie from the middle.
SPREAD = 4.0
#: Documents at which a group counts as much as what it is drawn towards.
WEIGHT = 100
#: Standard deviations of a count that may lie beyond a fence.
Z = 4.0
#: Words that one repeat of a three-word window covers at least.
REPEAT = 6
#: measure: (count, units, has a lower fence)
MEASURES = {
    "symbol_rate": ("n_symbols", "n_words", False),
    "dup_line_rate": ("n_dup_lines", "n_lines", False),
    "repeat_rate": (f"n_repeat_words / {REPEAT}", "n_words", False),
    "word_len": ("word_chars", "n_words", True),
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_key, the counts and ``base_failed``, a row for each row of ``docs``."""
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(C.SPACE)) != "")
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select("*", C.words(F.col("t")).alias("w"), lines.alias("l"))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64("t").alias("text_key"),
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    kept = ["doc_id", "lang", "source", "text_key", "n", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    n3 = F.col("n") - 2
    three = F.zip_with(C.fold_pairs(F.col("h"), F.col("h"), 1, n3), C.part(F.col("h"), 2, n3), lambda a, b: F.xxhash64(a, b))
    d = d.select(*kept, F.sort_array(F.transform(three, lambda h, i: F.struct(h.alias("h"), i.alias("p")))).alias("s"))
    # equal windows are neighbours now; their places, in order, give the words that they cover
    m = F.size("s") - 1
    pair = F.zip_with(C.part(F.col("s"), 0, m), C.part(F.col("s"), 1, m), lambda a, b: F.when(a.h == b.h, F.struct(a.p.alias("a"), b.p.alias("b"))))
    d = d.select(*kept, F.filter(pair, lambda x: x.isNotNull()).alias("e"))
    d = d.select(*kept, F.sort_array(F.array_distinct(F.concat(F.col("e.a"), F.col("e.b")))).alias("p"))
    k = F.size("p") - 1
    gaps = F.zip_with(C.part(F.col("p"), 0, k), C.part(F.col("p"), 1, k), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y) + F.when(F.size("p") > 0, 3).otherwise(0)
    d = d.select(*kept, covered.cast("long").alias("n_repeat_words"))

    return d.select(
        "doc_id",
        "lang",
        "source",
        "text_key",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("n_lines").cast("long").alias("n_lines"),
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n"))).alias("base_failed"),
    )


def _drawn(n: Column, own: Column, to: Column) -> Column:
    """``own`` of ``n`` documents drawn towards ``to``."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, to).otherwise((n * own + WEIGHT * to) / (n + WEIGHT))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and, for each measure, the fences ``<measure>_lo`` and ``<measure>_hi`` of that group."""
    passed = measured.where(~F.col("base_failed")).dropDuplicates(["lang", "source", "text_key"])
    # a document can't show a rate below one event: its own size limits what it says
    rates = [((F.expr(count) + 1) / F.greatest(F.col(units), F.lit(1))).alias(m) for m, (count, units, _) in MEASURES.items()]
    sketch = [F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    merge = [F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    groups = passed.select("lang", "source", *rates).groupBy("lang", "source").agg(F.count("*").alias("docs"), *sketch)
    groups = C.materialize(groups, "quality-sketches")
    langs = groups.groupBy("lang").agg(F.sum("docs").alias("docs"), *merge)
    every = groups.groupBy(F.lit(0).alias("all")).agg(*merge)  # no row where there are no groups

    def quantiles(d: DataFrame, prefix: str, *keys: str) -> DataFrame:
        found = [F.kll_sketch_get_quantile_double(m, F.lit(q)).alias(f"{prefix}{m}_{n}") for m in MEASURES for n, q in (("low", LOW), ("mid", MIDDLE), ("high", HIGH))]
        return d.select(*keys, *found)

    g = quantiles(groups, "g_", "lang", "source", F.col("docs").alias("g_docs"))
    l_ = quantiles(langs, "l_", F.col("lang").alias("l_lang"), F.col("docs").alias("l_docs"))
    both = g.join(l_, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    a = quantiles(every, "a_").first()  # one row of twelve numbers
    whole = {f"{m}_{n}": F.lit(a[f"a_{m}_{n}"] if a else None).cast("double") for m in MEASURES for n in ("low", "mid", "high")}
    drawn = [_drawn(F.col("g_docs"), F.col(f"g_{m}_{n}"), _drawn(F.col("l_docs"), F.col(f"l_{m}_{n}"), whole[f"{m}_{n}"])).alias(f"{m}_{n}") for m in MEASURES for n in ("low", "mid", "high")]
    out = ["lang", "source"]
    for m, (_, _, low) in MEASURES.items():
        low_q, mid, high_q = (F.col(f"{m}_{n}") for n in ("low", "mid", "high"))
        out.append((F.greatest(mid - SPREAD * (mid - low_q), F.lit(0.0)) if low else F.lit(0.0)).alias(f"{m}_lo"))
        out.append((mid + SPREAD * (high_q - mid)).alias(f"{m}_hi"))
    return both.select("lang", "source", *drawn).select(*out)


def _score(count: Column, expected: Column) -> Column:
    """Standard deviations between a count and what was expected, on the square-root scale."""
    return 2 * (F.sqrt(count + 0.375) - F.sqrt(expected + 0.375))


@C.scoped
def judge(docs: DataFrame) -> DataFrame:
    """The counts of every row with ``base_failed`` and the verdict ``kept``."""
    measured = C.materialize(measures(docs), "quality-measures")
    limits = C.materialize(thresholds(measured), "quality-limits")
    limits = C.join_side(limits).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    within = F.lit(True)
    for m, (count, units, low) in MEASURES.items():
        k, n = F.expr(count).cast("double"), F.col(units)
        within = within & (_score(k, F.col(f"{m}_hi") * n) <= Z)
        if low:
            within = within & (_score(k, F.col(f"{m}_lo") * n) >= -Z)
    return joined.select(*measured.columns, (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


@C.scoped
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    A rejected doc_id takes all rows that repeat it along, unless another of them is kept.
    """
    (bad_id,) = C.fresh(docs, "bad_id")
    verdict = judge(docs).groupBy(F.col("doc_id").alias(bad_id)).agg(F.bool_or("kept").alias("any"))
    bad = C.join_side(C.materialize(verdict.where("NOT any").select(bad_id), "quality-rejected"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti")
