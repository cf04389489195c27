"""Personal data: base patterns and bootstrapped contextual extraction.

The base patterns find e-mail addresses, IPv4 addresses, card and phone numbers. They are the seeds.
Seeds, other tokens with digits or an at sign and digit groups joined by spaces are instances; the words around an instance give
its lexical patterns (the word before, the two before, the words on both sides; digits as #). Spark
scores the graph of patterns and instances in rounds: a pattern is as sure as the mean of its
instances, an instance as the noisy-or of its patterns; seeds stay at 1. Instances that sure
patterns of a kind discover, and that have a shape of that kind, become spans of it.

Defined cases: null text is empty; texts are scanned whole, and words of a pattern are taken whole at
any length; repeated rows give repeated results, rows without doc_id (of any type) too; an empty table
gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]\S*")
#: Digit groups with spaces between some of them, and what may else join digits in a card or phone number.
GROUPED = re.compile(r"(?<!\S)[+(]{0,2}[0-9](?:[().-]*[0-9])*(?:[().-]*\x20[\x20().-]*[0-9](?:[().-]*[0-9])*)+(?!\w)")
AFTER = re.compile(r"\s+(\S+)")
#: Longer patterns are written by their digest, which tells them apart as well.
WRITTEN = 200
ROUNDS = 3
#: Least score of patterns and instances, and least distinct seeds of a pattern.
SURE = 0.8
SEEDS = 5
#: Kinds whose identifiers may hold spaces, as their base patterns do.
SPACED = ("card", "phone")
#: What an instance of a kind must look like beyond the base pattern: share of digits, least length, an at sign.
SHAPES = {"email": (0.0, 6, True), "ip": (0.5, 7, False), "card": (0.6, 12, False), "phone": (0.6, 7, False)}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind (its place in KINDS), end; sorted."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class _Span:
    def __init__(self, start: int, end: int):
        self._at = start, end

    def start(self) -> int:
        return self._at[0]

    def end(self) -> int:
        return self._at[1]


def _emails(text: str) -> Iterator[_Span]:
    """The matches of EMAIL, from one at sign to the next: a match has one, so it starts where the run before it starts."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield _Span(start, m.end())
            free = m.end()
        at = text.find("@", max(free, at + 1))


def _word_before(text: str, end: int) -> tuple[int, int] | None:
    """Where the word stands that is parted from ``end`` by white space alone."""
    stop = end
    while stop and text[stop - 1].isspace():
        stop -= 1
    if stop in (0, end):
        return None
    start = stop
    while start and not text[start - 1].isspace():
        start -= 1
    return start, stop


def _shape(word: str) -> str:
    return re.sub("[0-9]", "#", word.lower())


def patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns of the instance ``text[start:end]``: none if no word stands before it."""
    if (near := _word_before(text, start)) is None:
        return []
    one = _shape(text[slice(*near)])
    out = [f"1 {one}"]
    if far := _word_before(text, near[0]):
        out.append(f"2 {_shape(text[slice(*far)])} {one}")
    if right := AFTER.match(text, end):
        out.append(f"3 {one} _ {_shape(right[1])}")
    return [p if len(p) <= WRITTEN else f"{p[0]} digest {hashlib.md5(p.encode('utf-8', 'replace')).hexdigest()}" for p in out]


def _apart(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts of the base spans, in order, and the farthest end up to each."""
    ends, far = [], 0
    for _, _, e in base:
        far = max(far, e)
        ends.append(far)
    return [s for s, _, _ in base], ends


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """start, kind, end of the seeds (``base``, sorted) and, with kind -1, of other tokens with a digit or an at sign and of spaced digit groups."""
    out, free = list(base), 0
    starts, ends = _apart(base)

    def add(start: int, end: int) -> None:
        k = bisect_left(starts, end)
        if end - start >= 6 and not (k and ends[k - 1] > start):
            out.append((start, -1, end))

    for m in MARKED.finditer(text):
        start, end = m.span()
        while start > free and not text[start - 1].isspace():
            start -= 1
        free = end
        while end > start and text[end - 1] in ".,;:!?)\"'":
            end -= 1
        add(start, end)
    for m in GROUPED.finditer(text):
        add(*m.span())
    return sorted(out)


SCHEMA = "doc_id {}, base array<struct<s:bigint,k:int,e:bigint>>, seen array<struct<s:bigint,k:int,e:bigint,t:string,p:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = [("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]
    for batch in batches:
        base, seen = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = base_spans(text)
            base.append([{"s": s, "k": k, "e": e} for s, k, e in found])
            seen.append([{"s": s, "k": k, "e": e, "t": text[s:e], "p": patterns(text, s, e)} for s, k, e in instances(text, found)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(seen, pa.list_(pa.struct([*span, ("t", pa.string()), ("p", pa.list_(pa.string()))])))], names=["doc_id", "base", "seen"])


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of (pattern, kind) and of (instance, kind), from distinct edges (p, t, k), k being -1 or the kind of a seed."""
    kinds = edges.where("k >= 0").select("p", "k", "t").groupBy("p", "k").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SEEDS)
    size = edges.groupBy("p").agg(F.count_distinct("t").alias("size"))
    heads = C.materialize(kinds.join(size, "p"), "pii-patterns")  # patterns with seeds enough, and the kinds they may stand for
    graph = C.materialize(edges.select("p", "t", F.col("k").alias("own")).join(heads.select("p", "k"), "p"), "pii-graph")
    trust = graph.select("t", "k", (F.col("own") == F.col("k")).cast("double").alias("c")).groupBy("t", "k").agg(F.max("c").alias("c"))
    for _ in range(rounds):
        trust = C.materialize(trust, "pii-instances")
        sure = graph.join(trust, ["t", "k"]).groupBy("p", "k").agg(F.sum("c").alias("c")).join(heads, ["p", "k"]).select("p", "k", (F.col("c") / F.col("size")).alias("score"))
        sure = C.materialize(sure, "pii-scores")
        miss = F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))))
        trust = graph.join(sure, ["p", "k"]).groupBy("t", "k").agg(F.greatest(1 - miss, F.max((F.col("own") == F.col("k")).cast("double"))).alias("c"))
    return sure, C.materialize(trust, "pii-instances")


@C.scoped
def find(docs: DataFrame) -> DataFrame:
    """row (a number for each row), doc_id, base and spans: arrays of (s, k, e) by start, then kind."""
    C.bounded_batches(docs.sparkSession)
    scanned = docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA.format(dict(docs.dtypes)["doc_id"]))
    scanned = C.materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    seen = scanned.where("size(seen) > 0").select("row", F.explode("seen").alias("m")).select("row", "m.*")
    edges = seen.select(F.explode("p").alias("p"), F.md5("t").alias("t"), "k").distinct()
    edges = C.materialize(edges, "pii-edges")
    by_pattern, by_instance = score(edges)
    sure = C.join_side(C.materialize(by_pattern.where(F.col("score") >= SURE).select("p", F.col("k").alias("kind")), "pii-sure"))
    likely = C.join_side(C.materialize(by_instance.where(F.col("c") >= SURE).select(F.col("t").alias("it"), F.col("k").alias("kind")), "pii-likely"))
    digits = F.length(F.regexp_replace("t", "[^0-9]", "")) / F.length("t")
    shaped = F.lit(False)
    for k, name in enumerate(KINDS):
        share, least, at_sign = SHAPES[name]
        fits = (F.col("kind") == k) & (digits >= share) & (F.length("t") >= least)
        if name not in SPACED:
            fits = fits & ~F.col("t").contains(" ")
        shaped = shaped | (fits & F.col("t").contains("@") if at_sign else fits)
    new = seen.where("k = -1").select("row", "s", "e", "t", F.explode("p").alias("p")).join(sure, "p").where(shaped)
    new = new.withColumn("it", F.md5("t")).join(likely, ["it", "kind"], "left_semi").select("row", F.struct("s", F.col("kind").alias("k"), "e").alias("span"))
    added = new.groupBy(F.col("row").alias("of")).agg(F.collect_set("span").alias("added"))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    every = F.array_sort(F.concat("base", F.coalesce("added", none)))
    return scanned.join(added, F.col("row") == F.col("of"), "left").select("row", "doc_id", "base", every.alias("spans"))


def listed(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m.k + 1), m.s, m.e)), ",")
