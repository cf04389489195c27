"""Content-defined chunks and line diffs: what column expressions can't do, over Arrow batches."""

from __future__ import annotations

import difflib
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DIFF = 1 << 20
CONTEXT = 3
#: Bytes that are compressed first.
SAMPLE = 1 << 16


#: Fixed value: the multiplier of the rolling hash.
MULTIPLIER = 0x9E3779B185EBCA87
#: Texts that are hashed side by side at least; fewer are hashed one by one.
ABREAST = 12


def bounds(target: int) -> tuple[int, int, int]:
    """Least and greatest chunk, and the mask whose bits are clear at a cut."""
    target = max(target, 1024)
    return 1024 if target < 4096 else target // 4, 4 * target, (1 << (target - 1).bit_length()) - 1


def _candidates(datas: list[bytes], mask: int) -> list[list[int]]:
    """For each text the lengths of its heads whose hash has the mask's bits clear.

    A step turns the hash left by one bit, adds the byte and multiplies, all in 64 bits. The hash runs on
    through cuts, so it depends on the text alone and all texts can be stepped together.
    """
    found: list[list[int]] = [[] for _ in datas]
    order = sorted(range(len(datas)), key=lambda k: -len(datas[k]))
    sizes = np.array([len(datas[k]) for k in order], np.int64)
    flat = np.frombuffer(b"".join(datas[k] for k in order), np.uint8)
    begin = np.cumsum(sizes) - sizes
    h, low, live, at = np.zeros(len(order), np.uint64), np.uint64(mask), len(order), 0
    one, top, by = np.uint64(1), np.uint64(63), np.uint64(MULTIPLIER)
    while True:
        while live and sizes[live - 1] <= at:
            live -= 1
        if live < ABREAST:
            break
        x = h[:live]
        h[:live] = ((x << one | x >> top) + flat[begin[:live] + at]) * by
        at += 1
        for k in np.flatnonzero(h[:live] & low == 0).tolist():
            found[order[k]].append(at)
    for k in range(live):
        x = int(h[k])
        for i, byte in enumerate(datas[order[k]][at:], at + 1):
            x = ((x << 1 | x >> 63) + byte) * MULTIPLIER & 0xFFFFFFFFFFFFFFFF
            if not x & mask:
                found[order[k]].append(i)
    return found


def cut_points(datas: list[bytes], target: int) -> list[list[tuple[int, int]]]:
    """(start, end) of the chunks of each text: cut at the first candidate from the least size on, else at the greatest size."""
    least, most, mask = bounds(target)
    out = []
    for data, good in zip(datas, _candidates(datas, mask), strict=True):
        start, cuts = 0, []
        while start < len(data):
            k = bisect_left(good, start + least)
            end = min(start + most, len(data), good[k] if k < len(good) else len(data))
            cuts.append((start, end))
            start = end
        out.append(cuts)
    return out


def cdc_chunks(rows: DataFrame, key: str, text: str, target: int) -> DataFrame:
    """key, idx, start, len, chunk_oid of content-defined chunks of a text's UTF-8 bytes; null and empty texts have none."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            datas = [(t or "").encode() for t in batch.column(1).to_pylist()]
            cuts = cut_points(datas, target)
            owner = pa.array([k for k, c in enumerate(cuts) for _ in c], pa.int64())
            each = [(i, a, z - a, hashlib.sha256(datas[k][a:z]).hexdigest()) for k, c in enumerate(cuts) for i, (a, z) in enumerate(c)]
            idx, start, length, oid = zip(*each, strict=True) if each else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *(pa.array(x, pa.int64()) for x in (idx, start, length)), pa.array(oid, pa.string())], names=[key, "idx", "start", "len", "chunk_oid"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, idx bigint, start bigint, len bigint, chunk_oid string")


def line_diff(old: Column | str, new: Column | str) -> Column:
    """Unified diff with three lines of context; null for binaries and texts over MAX_DIFF."""

    def one(a, b):
        a, b = a or "", b or ""
        if max(len(a), len(b)) > MAX_DIFF or "\0" in a[:8192] or "\0" in b[:8192]:
            return None
        return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "old", "new", n=CONTEXT, lineterm=""))

    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(diff, "string")(old, new)


def sampled_gain(content: Column | str, least: float = 0.0) -> Column:
    """1 - compressed/original of the whole; of the first 64 KiB alone where that is under ``least``, as the rest is not compressed then."""

    def one(t):
        data = t if isinstance(t, bytes) else (t or "").encode()
        gain = 0.0
        for part in (data[:SAMPLE], data) if len(data) > SAMPLE else (data,):
            gain = 1 - len(zlib.compress(part, 6)) / len(part) if part else 0.0
            if gain < least:
                break
        return gain

    def gain(c: pd.Series) -> pd.Series:
        return c.map(one)

    return F.pandas_udf(gain, "double")(content)
