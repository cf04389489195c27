"""Substring dedup by recompression.

Words get 64-bit names. The first round replaces each run of one name by a name for the run, every
further round pairs: names are dealt into a left and a right class by a hash of name and round, and a
left name followed by a right one becomes the name of the pair. Names are functions of what they
replace, so they are the same in every task, and equal substrings are cut alike except at their ends.
Each symbol carries its context: the words that decided that it came to be. A window of words that
stands in two places holds, in both, all symbols whose contexts lie inside it.

1. Spark counts the high-level names; those seen once can't lie in a repeated window.
2. The places of repeated names go back to their documents.
3. Windows without a lone symbol inside are candidates; their 96-bit hashes are counted. In each
   batch a window seen twice is settled there, so a hot window sends one row per batch, not one per
   document.
4. Words covered by a repeated window leave, at all places.

A collision of names can only add candidates. Defined cases: null and blank texts have no words;
texts shorter than the window keep all words; repeated rows are places of their own, so a repeated
text loses all words of its windows; rows without doc_id and ids of any type too; an empty table gives
an empty result; texts are taken whole; other columns, of any name, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 35
PAIR_ROUNDS = 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FAR = 1 << 40
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def compress(h: np.ndarray, doc: np.ndarray, rounds: int = PAIR_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round, the documents they are in and the words [left, right) that are their context.

    ``doc`` is ascending. What lies at a document's edge has a context beyond it, as a window can't tell it.
    """
    n = len(h)
    if not n:
        return h, doc, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.ones(n, bool)
    starts[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, n))
    s = np.where(size > 1, mix(h[first] * _N + size.astype(np.uint64)), h[first])
    d = doc[first]
    begins = np.ones(len(s), bool)
    begins[1:] = d[1:] != d[:-1]
    ends = np.append(begins[1:], True)
    # that a run ends is decided by the word beyond it
    left, right = np.where(begins, -FAR, first - 1), np.where(ends, FAR, first + size + 1)
    for r in range(rounds):
        m = len(s)
        begins = np.ones(m, bool)
        begins[1:] = d[1:] != d[:-1]
        ends = np.append(begins[1:], True)
        is_left = mix(s ^ (_N * np.arange(r + 1, r + 2, dtype=np.uint64))) & np.uint64(1) == 1
        pair = np.zeros(m, bool)
        pair[:-1] = is_left[:-1] & ~is_left[1:] & ~ends[:-1]
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        after_l, after_r = np.append(left[1:], FAR), np.append(right[1:], FAR)
        before_l = np.concatenate([[-FAR], left[:-1]])
        before_r = np.concatenate([[-FAR], right[:-1]])
        # a pair is decided by its two; a lone left one by the next, a lone right one by the one before
        look_on = pair | is_left
        new_left = np.where(look_on, np.where(ends, left, np.minimum(left, after_l)), np.where(begins, -FAR, np.minimum(left, before_l)))
        new_right = np.where(look_on, np.where(ends, FAR, np.maximum(right, after_r)), np.where(begins, right, np.maximum(right, before_r)))
        s[:-1] = np.where(pair[:-1], mix(s[:-1] * _M + mix(s[1:])), s[:-1])
        keep = ~second
        s, d, left, right = s[keep], d[keep], new_left[keep], new_right[keep]
    return s, d, left, right


def _words_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch, the document (place in the batch) of each, and where documents begin (and the last ends)."""
    at = column.offsets.to_numpy().astype(np.int64)
    h = column.values.to_numpy(zero_copy_only=False).astype(np.uint64)[at[0] : at[-1]]
    return h, np.repeat(np.arange(len(at) - 1), np.diff(at)), at - at[0]


def _symbols(column: pa.ListArray, window: int):
    """Of the symbols whose context fits a window: name, document, context relative to the batch."""
    h, doc, at = _words_of(column)
    s, d, left, right = compress(h, doc)
    fits = right - left <= window
    return s[fits], d[fits], left[fits], right[fits], h, doc, at


def _names(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = np.unique(_symbols(batch.column(1), window)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["name", "n"])

    return run


def _places(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, d, left, *_, at = _symbols(batch.column(1), window)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), batch.column(0).take(pa.array(d)), pa.array((left - at[d]).astype(np.int32))], names=["name", "row", "at"])

    return run


def window_hashes(h: np.ndarray, window: int, by: np.uint64) -> np.ndarray:
    """Of every ``window`` words in a row, by doubling."""
    out, size, power, width = None, 0, h, 1
    left = window
    while left:
        if left & 1:
            if out is None:
                out, size = power, width
            else:
                k = len(h) - size - width + 1
                out, size = mix(out[:k] * by + power[size : size + k]), size + width
        left >>= 1
        if left:
            k = len(power) - width
            power, width = mix(power[:k] * by + power[width : width + k]), 2 * width
    return out


def _candidates(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, d, left, right, h, doc, at = _symbols(batch.column(1), window)
            k = len(h) - window + 1
            if k <= 0:
                continue
            # places (document, word) of symbols that are seen more than once
            lists = batch.column(2)
            offs = lists.offsets.to_numpy().astype(np.int64)
            seen_at = lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.int64) if offs[-1] > offs[0] else np.zeros(0, np.int64)
            known = np.zeros(len(h) + 1, bool)
            known[seen_at + at[np.repeat(np.arange(len(offs) - 1), np.diff(offs))]] = True
            lone = ~known[left]
            out = np.bincount(np.maximum(right[lone] - window, 0), minlength=len(h) + 2) - np.bincount(left[lone] + 1, minlength=len(h) + 2)
            open_ = (np.cumsum(out)[:k] == 0) & (doc[:k] == doc[window - 1 :])
            p = np.flatnonzero(open_)
            if not len(p):
                continue
            h1, h2 = window_hashes(h, window, _M)[p], (window_hashes(h, window, _N)[p] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            order = np.lexsort((p, h2, h1))
            a, b = h1[order], h2[order]
            new = np.ones(len(p), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            twice = count[group] > 1
            once, heads = order[~twice], order[new & twice]
            here = np.sort(order[twice])  # settled in this batch: stretches of neighbours
            if len(here):
                cut = np.ones(len(here), bool)
                cut[1:] = (np.diff(here) != 1) | (p[here[1:]] - p[here[:-1]] != 1) | (doc[p[here[1:]]] != doc[p[here[:-1]]])
                lead = np.flatnonzero(cut)
                span = np.diff(np.append(lead, len(here)))
                lead = p[here[lead]]
            else:
                lead = span = np.zeros(0, np.int64)
            first = np.concatenate([p[once], np.zeros(len(heads), np.int64), lead])
            rows = batch.column(0).take(pa.array(np.concatenate([doc[p[once]], np.zeros(len(heads), np.int64), doc[lead]])))
            sizes = np.concatenate([np.ones(len(once), np.int32), np.zeros(len(heads), np.int32), span.astype(np.int32)])
            settled = np.concatenate([np.zeros(len(once) + len(heads), bool), np.ones(len(lead), bool)])
            n1 = np.concatenate([h1[once], h1[heads], mix(lead.astype(np.uint64) * _M + doc[lead].astype(np.uint64))])
            n2 = np.concatenate([h2[once], h2[heads], np.zeros(len(lead), np.int32)])
            starts = np.where(sizes > 0, first - at[doc[first]], 0).astype(np.int32)
            n = np.where(np.concatenate([np.zeros(len(once), bool), np.ones(len(heads) + len(lead), bool)]), 2, 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(n1.view(np.int64)), pa.array(n2), pa.array(settled), rows, pa.array(starts), pa.array(sizes), pa.array(n)], names=["h1", "h2", "settled", "row", "at", "size", "n"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            spans = batch.column(2)
            offs = spans.offsets.to_numpy()
            at, size = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for text, a, z in zip(batch.column(1).to_pylist(), offs[:-1], offs[1:], strict=True):
                words = WORD.findall(text or "")
                n_words.append(len(words))
                if z > a:
                    n = len(words) + 1
                    edge = np.bincount(at[a:z], minlength=n) - np.bincount(at[a:z] + size[a:z] + window - 1, minlength=n)
                    gone = np.cumsum(edge)[:-1] > 0
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text; row tells rows apart: an integer doc_id where it does, else a number in a written copy."""
    d = docs.select("doc_id", "text")
    if isinstance(d.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and d.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL").isEmpty():
        return d.select(F.col("doc_id").cast("bigint").alias("row"), "doc_id", "text")
    return C.materialize(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "substring-docs")


@C.scoped
def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) for each row of ``docs``."""
    C.bounded_batches(docs.sparkSession)
    docs = numbered(docs)
    hashed = docs.select("row", F.transform(C.words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    shared = hashed.mapInArrow(_names(window), "name bigint, n int").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("name").alias("shared"))
    shared = C.materialize(shared, "substring-names")
    places = hashed.mapInArrow(_places(window), "name bigint, row bigint, at int").join(C.join_side(shared), F.col("name") == F.col("shared"), "left_semi")
    places = C.materialize(places.groupBy(F.col("row").alias("of")).agg(F.collect_list("at").alias("places")), "substring-places")
    met = docs.join(places, F.col("row") == F.col("of"), "left").select("row", F.transform(C.words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    found = met.mapInArrow(_candidates(window), "h1 bigint, h2 int, settled boolean, row bigint, at int, size int, n int")
    found = C.materialize(found, "substring-candidates")
    # counts by partial aggregation, then a plain join, so that a hot window gathers nowhere
    open_ = found.where("NOT settled")
    often = open_.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    often = C.join_side(C.materialize(often, "substring-often"))
    met = open_.where("size > 0").join(often, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")
    twice = met.select("row", "at", "size").unionByName(found.where("settled").select("row", "at", "size"))
    spans = C.materialize(twice.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("at", "size")).alias("spans")), "substring-spans")
    return docs.join(spans, F.col("row") == F.col("of"), "left").select("doc_id", "text", "spans").mapInArrow(_remove(window), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_text string")
