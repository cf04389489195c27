"""Secret scans (DataFrame functions only).

Base patterns find assignments, access keys and long hex strings. A battery of randomness tests
adds other tokens that look drawn at random: for the alphabet of the inferred encoding, a
chi-squared test of uniformity, a runs test about the alphabet's middle and a test of the lag-1
serial correlation. A token is held random unless the tests reject that; rejections are chosen by
Benjamini-Hochberg among the distinct tokens of like length, so long and short tokens get limits of
their own and at most the share FDR of the rejected is random in truth. The ranks come from a
histogram of p-values (bounded by length classes times PLACES), not from a sort of all tokens.

The tests see every token of TOKEN; those added must carry MIN_BITS. No digits or letters are asked
for: random tokens may have none, so long words that no test rejects are added as well. Tokens that
touch a base span are not added.

Places of matches are running sums over arrays by doubling, so a text of many matches costs n log n.

Defined cases: null text is empty; texts are scanned whole; repeated rows give repeated results, rows
without doc_id (of any type) too; an empty table gives an empty result; other columns, of any name,
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of these have the length asked for exactly where the plain run has, as a run never starts inside another.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_GROUP = 6
MIN_BITS = 80
FDR = 0.05
#: Classes of p-values, 20 to a power of ten.
PLACES = 6000

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("", UPPER + LOWER + DIGITS + "+/"),
)


def spans(text: Column, pattern: str, extra: Column | None = None) -> Column:
    """s, e (code points, end exclusive) and t of all matches; x is the element of ``extra`` with the same place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,t:string,x:string>>")

    def placed(x: Column) -> Column:
        # a match ends after all gaps and matches up to it
        own = F.zip_with(F.slice(x.gaps, F.lit(1), F.size(x.found)), x.found, lambda g, t: (F.length(g) + F.length(t)).cast("bigint"))
        each = F.arrays_zip(C.running(own, lambda a, b: a + b).alias("e"), x.found.alias("t"), x.extra.alias("x"))
        return F.transform(each, lambda m: F.struct((m.e - F.length(m.t)).cast("bigint").alias("s"), m.e.alias("e"), m.t.alias("t"), m.x.alias("x")))

    parts = F.struct(F.split(text, pattern).alias("gaps"), found.alias("found"), (found if extra is None else extra).alias("extra"))
    return F.when(text.rlike(pattern), C.let(parts, placed)).otherwise(empty)


def untouched(more: Column, base: Column) -> Column:
    """The spans of ``more`` (s, e, t; in order, apart) that no span of ``base`` (s, k, e; in any order) overlaps."""
    asked = F.transform(more, lambda m: F.struct(m.e.alias("key"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("to"), m.s.alias("s"), m.t.alias("t")))
    there = F.transform(base, lambda b: F.struct(b.s.alias("key"), F.lit(1).alias("kind"), b.e.alias("to"), b.s.alias("s"), F.lit("").alias("t")))

    def free(x: Column) -> Column:
        # the farthest end of the base spans that start before a span's end
        upto = C.running(F.transform(x, lambda y: y.to), lambda a, b: F.greatest(a, b))
        known = F.filter(F.arrays_zip(x.alias("y"), upto.alias("upto")), lambda z: (z.y.kind == 0) & (z.upto <= z.y.s))
        return F.transform(known, lambda z: F.struct(z.y.s.alias("s"), z.y.key.alias("e"), z.y.t.alias("t")))

    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(C.let(F.array_sort(F.concat(asked, there)), free))


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution; to 1e-7, then by the asymptotic form."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    near = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, near).otherwise(1 - near)


def tested(tokens: DataFrame) -> DataFrame:
    """t, bits, n and p (the least p-value of the three tests, corrected for three) of distinct tokens ``t``."""
    encoding = F.lit(None).cast("string")
    for pattern, alphabet in reversed(ENCODINGS):
        encoding = F.when(F.col("b").rlike(pattern), F.lit(alphabet)).otherwise(encoding)
    d = tokens.select("t", F.translate(F.regexp_replace("t", "=+$", ""), "-_=", "+//").alias("b")).where("length(b) >= 2")
    d = d.withColumn("alphabet", encoding).withColumn("k", F.length("alphabet")).withColumn("n", F.length("b"))
    d = d.withColumn("v", F.transform(F.split("b", ""), lambda c: F.instr(F.col("alphabet"), c) - 1))
    of = F.transform(F.split("alphabet", ""), lambda c: F.length("b") - F.length(F.replace(F.col("b"), c, F.lit(""))))
    squares = F.aggregate(of, F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    chi = squares * F.col("k") / F.col("n") - F.col("n")
    df = (F.col("k") - 1).cast("double")
    z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.transform("v", lambda x: x * 2 >= F.col("k"))
    m = F.col("n") - 1
    pairs_high = F.zip_with(C.part(F.col("high"), 0, m), C.part(F.col("high"), 1, m), lambda a, b: a != b)
    d = d.select("t", "n", "k", "v", z_chi.alias("z1"), high.alias("high"))
    d = d.select("*", (1 + F.size(F.filter(pairs_high, lambda x: x))).alias("runs"), F.size(F.filter("high", lambda x: x)).cast("double").alias("n1"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("sum"))
    d = d.withColumn("n2", F.col("n") - F.col("n1")).withColumn("mean", F.col("sum") / F.col("n"))
    expect = 2 * F.col("n1") * F.col("n2") / F.col("n") + 1
    var = (expect - 1) * (expect - 2) / F.greatest(F.col("n") - 1, F.lit(1))
    z2 = F.when(var > 0, (F.col("runs") - expect) / F.sqrt(var)).otherwise(F.lit(9.0))
    dev = F.transform("v", lambda x: x - F.col("mean"))
    d = d.select("t", "n", "k", "z1", z2.alias("z2"), dev.alias("dev"))
    products = F.zip_with(C.part(F.col("dev"), 0, m), C.part(F.col("dev"), 1, m), lambda a, b: a * b)
    add = lambda a, x: a + x
    d = d.select("t", "n", "k", "z1", "z2", F.aggregate(products, F.lit(0.0), add).alias("cov"), F.aggregate(F.transform("dev", lambda x: x * x), F.lit(0.0), add).alias("var"))
    z3 = F.when(F.col("var") > 0, F.sqrt(F.col("n").cast("double")) * F.col("cov") / F.col("var") + 1 / F.sqrt(F.col("n").cast("double"))).otherwise(F.lit(9.0))
    p = F.least(_tail(F.col("z1")), 2 * _tail(F.abs("z2")), 2 * _tail(F.abs(z3)))
    return d.select("t", "n", (F.col("n") * F.log2(F.col("k").cast("double"))).alias("bits"), F.greatest(F.least(3 * p, F.lit(1.0)), F.lit(1e-299)).alias("p"))


def random_tokens(found: DataFrame) -> DataFrame:
    """The tokens ``t`` among the distinct ones of ``found`` whose randomness isn't rejected."""
    scored = tested(found.select("t").distinct()).withColumn("class", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    scored = C.materialize(scored.withColumn("place", F.least(F.floor(-20 * F.log10("p")), F.lit(PLACES)).cast("int")), "secret-scores")
    counts = scored.groupBy("class", "place").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("class").orderBy(F.desc("place"))
    ranked = counts.select("class", "place", F.sum("c").over(upto).alias("rank"), F.sum("c").over(Window.partitionBy("class")).alias("m"))
    # the highest p of a place is 10^(-place / 20); a place is rejected if that is within FDR * rank / m
    limit = ranked.where(F.pow(F.lit(10.0), -F.col("place") / 20) <= FDR * F.col("rank") / F.col("m")).groupBy("class").agg(F.min("place").alias("from_place"))
    limit = C.join_side(C.materialize(limit, "secret-limits"))
    kept = scored.join(limit, "class", "left").where((F.col("bits") >= MIN_BITS) & (F.col("from_place").isNull() | (F.col("place") < F.col("from_place"))))
    return kept.select("t")


@C.scoped
def find(docs: DataFrame) -> DataFrame:
    """row (a number for each row), doc_id, spans: array of (s, e, kind, base) by start then kind, kinds in the order assign, access, hex, random."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("t"))
    group = F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))

    def kind(found: Column, rank: int) -> Column:
        return F.transform(found, lambda m: F.struct(m.s.alias("s"), F.lit(rank).alias("k"), m.e.alias("e")))

    assign = F.filter(spans(F.col("t"), ASSIGN, group), lambda m: F.length(m.x) >= MIN_GROUP)
    base = F.concat(kind(assign, 0), kind(spans(F.col("t"), ACCESS), 1), kind(spans(F.col("t"), HEX), 2))
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), F.transform(spans(F.col("t"), TOKEN), lambda m: F.struct(m.s.alias("s"), m.e.alias("e"), m.t.alias("t"))).alias("more"))
    d = C.materialize(d, "secret-found")
    tokens = d.where("size(more) > 0").select("row", F.explode(untouched(F.col("more"), F.col("base"))).alias("m")).select("row", "m.*")
    chosen = C.materialize(random_tokens(tokens).select(F.md5("t").alias("key")), "secret-tokens")
    added = tokens.withColumn("key", F.md5("t")).join(C.join_side(chosen), "key", "left_semi")
    added = added.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("s", F.lit(3).alias("k"), "e")).alias("added"))
    joined = d.join(added, F.col("row") == F.col("of"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"))))
    return joined.select("row", "doc_id", every.alias("spans"))


KINDS = ("assign", "access", "hex", "random")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m.k + 1), m.s, m.e)), ",")
