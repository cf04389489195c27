"""MinHash near-dedup.

A document's set is that of its distinct 5-word shingles (A-Z lower-cased; the whole sequence where
it has fewer words). Two documents are linked if their sets' Jaccard similarity is 0.75 or more.

1. 128 universal hash minima of every set, in 32 bands of four; equal sets become one class, whose
   least doc_id stands for it.
2. Classes that share a band are candidates. In each bucket every member is paired with the least
   member; the signatures estimate the similarity, and pairs far below the limit go.
3. Links are confirmed on the full sets, for each class first on its most similar partner; then
   connected components by alternating large-star and small-star.
4. Pairs whose ends are already connected can add nothing. Buckets that still hold several
   components are compared in blocks, all outside the bucket's largest component against all: first
   by signature, which leaves the members of pairs that may be similar, then these by full sets. A
   block gives one link for each two components, which is all that components need.
5. A bucket with more than WIDE members outside its largest component holds texts that share a part but
   are not copies. The members of all such buckets are joined exactly instead, by prefixes of their sets, whatever
   bands they share. Shingles are ordered by how often they occur, rare ones first; the first shingle that two
   similar sets share then stands so early in both that what follows can still reach the limit. Members meet under
   their early shingles, with sizes and places that allow the limit only. A part that all share comes late in the
   order and brings together only texts with little else, which are similar as a rule; so blocks mostly grow with the
   links, and with the square only for texts made of several frequent parts, which are compared all the same.

No bucket is brought into one task: blocks have at most BLOCK members a side. A pair at the limit
escapes all bands with probability (1 - 0.75^4)^32, about 5 in a million, whether its buckets are wide or not. The
signature filter, five standard errors below the limit, loses less (wide buckets: eight, 1 in 10^13).

Defined cases: null and blank texts have an empty set and are linked with nothing; rows without
doc_id are linked with nothing, have no component_id and are kept; rows that repeat a doc_id, with
whatever texts, are one document with the links of all its rows and one component, a result row
each, and one row of it stays in ``keep_one`` (the least by text); ids of other types than integers are
numbered in their order; an empty table gives an empty result; other columns, of any name, are not read
and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .workers import lean

SHINGLE = 5
SIMILAR = 75  # percent
ROWS, BANDS = 4, 32
MINIMA = ROWS * BANDS
#: Least estimate of a pair that is confirmed on full sets.
LEAST = SIMILAR / 100 - 5 * (SIMILAR / 100 * (1 - SIMILAR / 100) / MINIMA) ** 0.5
#: The same for the members of wide buckets, of which many pairs are compared.
LOWEST = SIMILAR / 100 - 8 * (SIMILAR / 100 * (1 - SIMILAR / 100) / MINIMA) ** 0.5
BLOCK = 256
#: Members outside the largest component beyond which a bucket is joined by prefixes.
WIDE = 2048
#: Counters of shingles; those that share one are ordered by their hash.
SLOTS = 2**20
#: Least sizes of the classes in which sets meet.
EDGES = np.unique((1.05 ** np.arange(600)).astype(np.int64))

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, MINIMA, np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, h: the 64-bit hash of every word."""
    return docs.select("doc_id", F.transform(C.words(C.lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("h"))


def shingle_sets(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all documents, one after the other, and how many each has."""
    at = column.offsets.to_numpy().astype(np.int64)
    h = column.values.to_numpy(zero_copy_only=False).astype(np.uint64)[at[0] : at[-1]] if len(column.values) else np.zeros(0, np.uint64)
    at = at - at[0]
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    k = max(0, len(h) - SHINGLE + 1)
    s = h[:k].copy()
    for i in range(1, SHINGLE):
        s = mix(s * _M + h[i : i + k])
    whole = doc[:k] == doc[SHINGLE - 1 : SHINGLE - 1 + k]
    sets, owner = [s[whole]], [doc[:k][whole]]
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        x = np.array([n[d]], np.uint64)
        for w in h[at[d] : at[d + 1]]:
            x = mix(x * _M + w)
        sets.append(x), owner.append(np.array([d]))
    s, doc = np.concatenate(sets), np.concatenate(owner)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(n))


def signatures(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minima, a row for each set."""
    out = np.empty((len(starts), MINIMA), np.uint64)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(s * _A[k] + _B[k], starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            x = mix(x * _M + sig[:, b * ROWS + r])
        out[:, b] = x
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, n = shingle_sets(batch.column(1))
        full = np.flatnonzero(n)
        d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        keys = np.zeros((0, BANDS), np.uint64)
        if len(full):
            starts = (np.cumsum(n) - n)[full]
            d1[full], d2[full] = np.add.reduceat(mix(s), starts), np.add.reduceat(mix(s ^ _M), starts)
            keys = band_keys(signatures(s, starts))
        ends = np.cumsum(np.concatenate([[0], np.where(n > 0, BANDS, 0)])).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), bands], names=["doc_id", "n", "d1", "d2", "bands"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, n = shingle_sets(batch.column(1))
        full = np.flatnonzero(n)
        if not len(full):
            continue
        ends = np.cumsum(n)
        minima = signatures(s, (ends - n)[full])
        sig, bands = (minima * _M >> np.uint64(48)).astype(np.uint16), band_keys(minima)
        sets = [s[a:b].tobytes() for a, b in zip((ends - n)[full], ends[full], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in bands], pa.binary()), pa.array(sets, pa.binary())], names=["id", "sig", "bands", "full"])


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, MINIMA) for i in (2, 3))
        est = (a == b).mean(axis=1)
        keep = est >= LEAST
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)] + [pa.array(est[keep])], names=["a", "b", "est"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])


KIND = "key bigint, i int, j int, side int, id bigint, comp bigint"
MEMBER = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("comp", pa.int64())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _by_block(compare, schema: pa.Schema):
    """Runs ``compare`` on the rows of each block (first three columns); the rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in block], axis=0)) + 1
            if held and any(held[-1].column(i)[held[-1].num_rows - 1].as_py() != batch.column(i)[0].as_py() for i in (0, 1, 2)):
                yield compare(pa.Table.from_batches(held).combine_chunks(), schema)
                held = []
            begin = 0
            for end in cut:
                yield compare(pa.Table.from_batches([*held, batch.slice(begin, end - begin)]).combine_chunks(), schema)
                held, begin = [], end
            held.append(batch.slice(begin))
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks(), schema)

    return run


def _suspects(t: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """The members of a block that are in a pair of two components that may be similar by signature.

    A pair that shares several bands counts in the first of them only; if that is a wide bucket's, both ends are joined by prefixes.
    A doc_id with several texts has a row for each, of which some may not have the block's band.
    """
    key = np.uint64(t.column(0)[0].as_py() % 2**64)
    side, comp = t.column(3).to_numpy(), t.column(5).to_numpy()
    sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(-1, MINIMA)
    bands = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(-1, BANDS)
    band = int(np.nonzero(bands == key)[1][0])
    u, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    wanted = np.zeros(len(side), bool)
    for a in range(0, len(u) if len(v) else 0, 32):
        some = u[a : a + 32]
        est = (sig[some][:, None, :] == sig[v][None, :, :]).mean(axis=2)
        x, y = np.nonzero((est >= LEAST) & (comp[some][:, None] != comp[v][None, :]))
        first = ~(bands[some[x], :band] == bands[v[y], :band]).any(axis=1)
        wanted[some[x[first]]] = True
        wanted[v[y[first]]] = True
    rows = pa.array(np.flatnonzero(wanted))
    return pa.RecordBatch.from_arrays([t.column(i).combine_chunks().take(rows) for i in range(6)], schema=schema)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the sets fall into each slot."""
    n = np.zeros(SLOTS, np.int64)
    for batch in batches:
        n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) % np.uint64(SLOTS), minlength=SLOTS)
    for part in np.array_split(np.flatnonzero(n), 32):
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["slot", "n"])


def _early(counts):
    """The shingles of each set that can be the first one shared with a similar set, rare ones first.

    After the ``i`` shingles before it, n - i are left to share; so a similar set has ``most`` shingles at most.
    ``low`` to ``high`` are the size classes of such sets that are not larger than this one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            full = batch.column(2).to_pylist()
            size = np.array([len(x) // 8 for x in full], np.int64)
            s, doc = np.frombuffer(b"".join(full), np.uint64), np.repeat(np.arange(len(size)), size)
            k = often[s % np.uint64(SLOTS)]
            order = np.lexsort((s, k, doc))
            s, k, n = s[order], k[order], size[doc]
            i = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
            most, least = (100 + SIMILAR) * (n - i) // SIMILAR - n, -(-SIMILAR * n // 100)
            good = np.flatnonzero((most >= least) & (k > 1))  # one that occurs once is not shared
            n, most, least, doc = n[good], most[good], least[good], pa.array(doc[good])
            low, high = (np.searchsorted(EDGES, x, side="right").astype(np.int32) for x in (least, np.minimum(most, n)))
            yield pa.RecordBatch.from_arrays([pa.array(s[good].view(np.int64)), batch.column(0).take(doc), batch.column(1).take(doc), pa.array(n), pa.array(most), pa.array(low), pa.array(high)], names=["shingle", "id", "comp", "n", "most", "low", "high"])

    return run


def _early_suspects(t: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """The members of a block of early shingles that are in a pair of two components that may be similar by size, place and signature."""
    side, ids, comp, n, most = (t.column(i).to_numpy() for i in (3, 4, 5, 6, 7))
    sig = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint16).reshape(-1, MINIMA)
    u, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    wanted = np.zeros(len(side), bool)
    for k in u if len(v) else []:
        x = v[(comp[v] != comp[k]) & (n[v] <= most[k]) & (n[k] <= most[v]) & ((n[k] < n[v]) | ((n[k] == n[v]) & (ids[k] < ids[v])))]
        x = x[(sig[x] == sig[k]).mean(axis=1) >= LOWEST] if len(x) else x
        wanted[x] = True
        wanted[k] = len(x) > 0
    rows = pa.array(np.flatnonzero(wanted))
    return pa.RecordBatch.from_arrays([t.column(i).combine_chunks().take(rows) for i in range(6)], schema=schema)


def _links(t: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """Between the sides of a block one similar pair for each two components that have any, by full sets."""
    side, ids, comp = (t.column(i).to_numpy() for i in (3, 4, 5))
    full = [np.frombuffer(x, np.uint64) for x in t.column(6).to_pylist()]
    u, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b, joined = [], [], set()
    if len(u) and len(v):
        sizes = np.array([len(full[k]) for k in v])
        every = np.concatenate([full[k] for k in v])
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(v)), sizes)[order]
        words, start = np.unique(every[order], return_index=True)
        start = np.append(start, len(every))
        for k in u:
            at = np.searchsorted(words, full[k])
            at[at == len(words)] = 0
            at = at[words[at] == full[k]]
            n = start[at + 1] - start[at]
            hits = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[hits], minlength=len(v))
            good = np.flatnonzero((100 * both >= SIMILAR * (len(full[k]) + sizes - both)) & (comp[v] != comp[k]))
            _, one = np.unique(comp[v[good]], return_index=True)
            for w in v[good[one]]:
                if (two := (comp[k], comp[w])) not in joined:
                    joined.add(two)
                    a.append(ids[k])
                    b.append(ids[w])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def components(links: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of all ids in links (a, b): alternating large-star and small-star.

    The least neighbours are written before edges meet them: a hub's edges are then one side of a
    plain join, which a broadcast or adaptive execution spreads, and never gather in one task.
    """
    edges = C.materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        least = C.join_side(C.materialize(least, "stars-least"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = C.materialize(large, "stars-large")
        low = C.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars-low")
        met = large.join(C.join_side(low.withColumnRenamed("u", "k")), F.col("u") == F.col("k"))
        small = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = C.materialize(small.distinct(), "stars")
        # done when every id hangs on one other that hangs on none
        twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        deep = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
        if twice.unionByName(deep).isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _confirm(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    few = C.join_side(pairs)
    left = few.join(nodes.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")
    wanted = C.join_side(C.materialize(pairs.select(F.col("b").alias("id")).distinct(), "near-wanted"))
    right = nodes.join(wanted, "id", "left_semi").select(F.col("id").alias("b"), F.col("full").alias("fb"))
    return C.materialize(left.join(right, "b").select("a", "b", "fa", "fb").mapInArrow(lean(_confirmed), "a bigint, b bigint").distinct(), "near-links")


@C.scoped
def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    docs, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _classes(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))).withColumns({c: F.col(c).cast(kind) for c in ("doc_id", "component_id")})
    # numbers in the order of the ids, so that the least of a component is the same; the sort is by ranges
    ids = docs.select("doc_id").dropna().distinct().orderBy("doc_id").select(F.col("doc_id").alias("of_id"), F.monotonically_increasing_id().alias("number"))
    ids = C.materialize(ids, "near-ids")
    numbered = docs.join(ids, F.col("doc_id") == F.col("of_id"), "left").select(F.col("number").alias("doc_id"), "text")
    found = C.materialize(_classes(numbered), "near-numbered")
    names = C.join_side(ids)
    found = found.join(names, F.col("doc_id") == F.col("number"), "left").select(F.col("of_id").alias("doc_id"), "n_shingles", "component_id", "kept")
    return found.join(names.select(F.col("number").alias("of_number"), F.col("of_id").alias("component")), F.col("component_id") == F.col("of_number"), "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def _mixed_groups(label: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of ``label`` (key, rep, comp) the groups of several components, and the members (id, comp) of those that are wide, if any.

    Groups have the columns key, rep, comp, main, rest, all: ``main`` is a group's largest component, ``rest`` and ``all``
    are its blocks outside of it and in all. Every member of a group is in the first table or in the second.
    """
    c = F.col
    size = label.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy(c("key").alias("k")).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    size = C.materialize(size.where("comps > 1").select("k", "main", "n", (c("n") - c("top")).alias("apart")), "near-mixed")
    blocks = size.where(c("apart") <= WIDE).select("k", "main", F.ceil(c("apart") / BLOCK).cast("int").alias("rest"), F.ceil(c("n") / BLOCK).cast("int").alias("all"))
    groups = label.join(C.join_side(blocks), c("key") == c("k")).select("key", "rep", "comp", "main", "rest", "all")
    wide = size.where(c("apart") > WIDE).select("k")
    if wide.isEmpty():
        return groups, None
    found = label.join(C.join_side(wide), c("key") == c("k"), "left_semi").select(c("rep").alias("id"), "comp").distinct()
    return groups, C.materialize(found, "near-wide")


def _linked(suspects: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links (a, b) between the sides of the blocks of ``suspects``."""
    blocks = suspects.join(nodes.select("id", "full"), "id").select("key", "i", "j", "side", "id", "comp", "full").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return C.materialize(blocks.mapInArrow(lean(_by_block(_links, PAIR)), "a bigint, b bigint").distinct(), "near-links")


def _prefix_links(wide: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all components of ``wide`` (id, comp) that have a similar pair, by early shingles.

    A pair meets in the size class of its smaller set (side 0), which the larger one (side 1) visits.
    """
    c = F.col
    sets = nodes.join(C.join_side(wide), "id").select("id", "comp", "full")
    counted = sets.select("full").mapInArrow(lean(_counts), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    often = wide.sparkSession.sparkContext.broadcast(often)
    early = C.materialize(sets.mapInArrow(lean(_early(often)), "shingle bigint, id bigint, comp bigint, n bigint, most bigint, low int, high int"), "near-early")
    often.destroy()
    mixed = early.groupBy(c("shingle").alias("s")).agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("s")
    early = early.join(C.join_side(C.materialize(mixed, "near-mixed")), c("shingle") == c("s"), "left_semi")
    met = early.withColumn("at", F.explode(F.sequence("low", "high"))).withColumn("side", F.lit(1))
    met = met.unionByName(early.where("most >= n").withColumn("at", c("high")).withColumn("side", F.lit(0)))
    met = C.materialize(met.select("shingle", "at", "side", "id", "comp", "n", "most"), "near-met")

    size = met.groupBy(c("shingle").alias("s"), c("at").alias("t"), "comp").agg(F.count_if(c("side") == 0).alias("u"), F.count_if(c("side") == 1).alias("v"))
    size = size.groupBy("s", "t").agg(F.sum("u").alias("u"), F.sum("v").alias("v"), F.count("*").alias("comps"), F.max_by(F.struct("comp", "u", "v"), F.struct(c("u") + c("v"), "comp")).alias("top")).where("comps > 1 AND u > 0 AND v > 0")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    # in part 0 those outside the largest component meet all, in part 1 those in it meet those outside
    parts = [F.struct(blocks(c("u") - c("top.u")).alias("rest"), blocks(c("v")).alias("all")), F.struct(blocks(c("top.u")).alias("rest"), blocks(c("v") - c("top.v")).alias("all"))]
    size = C.materialize(size.select("s", "t", c("top.comp").alias("main"), F.array(*parts).alias("parts")), "near-mixed")
    outside = c("comp") != c("main")
    mine = F.when(c("side") == 0, F.when(outside, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))).when(outside, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    at = met.join(C.join_side(size), (c("shingle") == c("s")) & (c("at") == c("t"))).withColumn("part", F.explode(mine))
    at = at.withColumn("blocks", F.element_at("parts", c("part") + 1)).select(F.xxhash64("shingle", "at", "part").alias("key"), "side", "id", "comp", "n", "most", c("blocks.rest").alias("rest"), c("blocks.all").alias("all")).where("rest > 0 AND all > 0")
    spot = F.pmod(F.xxhash64("id", "key"), F.lit(2**31))
    u = at.where("side = 0").withColumn("i", (spot % c("rest")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), c("all") - 1)))
    v = at.where("side = 1").withColumn("j", (spot % c("all")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), c("rest") - 1)))
    names = ["key", "i", "j", "side", "id", "comp", "n", "most"]
    laid = u.select(*names).unionByName(v.select(*names)).join(nodes.select("id", "sig"), "id").select(*names, "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    suspects = C.materialize(laid.mapInArrow(lean(_by_block(_early_suspects, MEMBER)), KIND), "near-suspects")
    return _linked(suspects, nodes)


def _classes(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    C.bounded_batches(spark)
    c = F.col
    sketched = C.materialize(word_hashes(docs).mapInArrow(lean(_sketch), "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"), "near-sketches")
    same = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy(c("d1").alias("c1"), c("d2").alias("c2")).agg(F.min("doc_id").alias("rep"))
    same = C.join_side(C.materialize(same, "near-classes"))
    is_rep = (c("d1") == c("c1")) & (c("d2") == c("c2")) & (c("doc_id") == c("rep"))
    banded = sketched.join(same, is_rep).select("rep", F.explode("bands").alias("key"))
    shared = C.materialize(banded.groupBy(c("key").alias("k")).agg(F.count("*").alias("c"), F.min("rep").alias("hub")).where("c > 1"), "near-buckets")
    members = C.materialize(banded.join(C.join_side(shared.select("k")), c("key") == c("k"), "left_semi"), "near-members")
    wanted = C.join_side(C.materialize(members.select("rep").distinct(), "near-nodes"))
    nodes = word_hashes(docs.join(wanted, c("doc_id") == c("rep"), "left_semi"))
    nodes = C.materialize(nodes.mapInArrow(lean(_full), "id bigint, sig binary, bands binary, full binary").distinct(), "near-sets")

    hubs = members.join(shared, c("key") == c("k")).where("rep <> hub").select(c("hub").alias("b"), c("rep").alias("a")).distinct()
    sig_a, sig_b = nodes.select(c("id").alias("a"), c("sig").alias("sa")), nodes.select(c("id").alias("b"), c("sig").alias("sb"))
    hubs = C.materialize(hubs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sa", "sb").mapInArrow(lean(_estimates), "a bigint, b bigint, est double"), "near-hubs")
    first = hubs.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    asked = C.materialize(first, "near-asked")
    # a doc_id with several texts links their classes
    narrow = sketched.select("doc_id", "n", "d1", "d2").join(same, (c("d1") == c("c1")) & (c("d2") == c("c2")) & (c("n") > 0) & c("doc_id").isNotNull(), "left")
    narrow = C.materialize(narrow.select("doc_id", "n", "rep"), "near-reps")
    several = narrow.where("doc_id IS NOT NULL").groupBy(c("doc_id").alias("of_id")).agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("c"), F.count("rep").alias("full"))
    several = C.join_side(C.materialize(several.where("least <> most OR full BETWEEN 1 AND c - 1").select("of_id", "least"), "near-repeated"))
    repeated = narrow.join(several, c("doc_id") == c("of_id")).where("rep <> least").select(c("rep").alias("a"), c("least").alias("b"))
    stars = components(_confirm(asked, nodes).unionByName(repeated))

    label = members.join(C.join_side(stars), c("rep") == c("id"), "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    groups, wide = _mixed_groups(label)
    at = groups.join(nodes.select(c("id").alias("rep"), "sig", "bands"), "rep")
    spot = F.pmod(F.xxhash64("rep", "key"), F.lit(2**31))
    u = at.where("comp <> main").withColumn("i", (spot % c("rest")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), c("all") - 1)).alias("j"), F.lit(0).alias("side"))
    v = at.withColumn("j", (spot % c("all")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), c("rest") - 1)).alias("i"), F.lit(1).alias("side"))
    names = ["key", "i", "j", "side", c("rep").alias("id"), "comp", "sig", "bands"]
    blocks = u.select(*names).unionByName(v.select(*names)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = _linked(C.materialize(blocks.mapInArrow(lean(_by_block(_suspects, MEMBER)), KIND), "near-suspects"), nodes)
    if wide is not None:
        found = found.unionByName(_prefix_links(wide, nodes))
    if not found.isEmpty():
        stars = components(stars.select(c("id").alias("a"), c("comp").alias("b")).unionByName(found))

    # rows without words take the class of their doc_id's other rows
    narrow = narrow.join(several, c("doc_id") == c("of_id"), "left").select("doc_id", "n", F.coalesce("rep", "least").alias("rep"))
    done = narrow.join(C.join_side(stars), c("rep") == c("id"), "left")
    done = done.select("doc_id", c("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))
    return done.withColumn("kept", c("doc_id").eqNullSafe(c("component_id")))


@C.scoped
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group: the one with the least doc_id, in one row."""
    gone_id, again_id, row = C.fresh(docs, "gone_id", "again_id", "row")
    found = C.materialize(classes(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "near-verdicts")
    gone = C.join_side(found.where("NOT kept").select(F.col("doc_id").alias(gone_id)))
    rest = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    again = found.where("kept").select(F.col("doc_id").alias(again_id))
    if again.isEmpty():
        return rest
    again = C.join_side(again)
    once = rest.join(again, F.col("doc_id") == F.col(again_id), "left_anti")
    several = rest.join(again, F.col("doc_id") == F.col(again_id), "left_semi").select(F.col("doc_id").alias(again_id), F.struct(*[C.col(x) for x in docs.columns]).alias(row))
    text = F.col(row).getField("text")
    one = several.groupBy(again_id).agg(F.min_by(row, F.struct(text.isNull(), text, F.to_json(row))).alias(row))
    return once.unionByName(one.select(*[F.col(row).getField(x).alias(x) for x in docs.columns]))
