"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Of all ways to cut a text into pieces the one with the greatest sum of scores is taken. White
space is written as U+2581, one of which is put in front of the text; characters that no piece
covers become byte pieces. Decoding joins the pieces, turns byte pieces into their bytes and the
markers into spaces and drops the one in front.

No piece has a marker after another character, and none has a line feed beside another one (``load``
makes sure of both), so no piece crosses the start of a word or of a line: words are cut on their own, distinct words of a batch together in numpy, and the best cut of a text is the
concatenation. A store of bounded bytes keeps words already cut while a task runs; dropping it changes
no result.

Defined cases: null and empty texts have no pieces and decode to the empty text; a marker
character inside a text decodes to a space; texts are taken whole at any length, a stretch of whole
words at a time, and a word of any length costs one byte a byte beside itself; rows without doc_id (of
any type) and repeated rows have results of their own; an empty table gives an empty result; other
columns of ``docs``, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .workers import lean

MARK = "▁"
UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Added to the least score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Bytes, about, of the words that a task remembers, and the longest of them in bytes.
REMEMBERED = 16 << 20
SHORT = 48
#: Characters that are cut together, and words that are in one table of the recurrence.
STRETCH = 1 << 20
TOGETHER = 1 << 13


def build_trie(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array (base, check, value) of the keys; node 0 is the root, value is a key's place or -1."""
    tree: list[dict[int, int]] = [{}]
    ends = {}
    for k, key in enumerate(keys):
        node = 0
        for b in key:
            nxt = tree[node].get(b)
            if nxt is None:
                nxt = tree[node][b] = len(tree)
                tree.append({})
            node = nxt
        ends[node] = k
    size = 2 * len(tree) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = bytearray(b"\x01") * size
    free[0] = 0
    at, queue, low = {0: 0}, [0], 1
    for node in queue:
        kids, here = tree[node], at[node]
        if not kids:
            continue
        codes = sorted(kids)
        slot = free.find(1, max(low, codes[0] + 1))
        while not all(free[slot - codes[0] + c] for c in codes):
            slot = free.find(1, slot + 1)
        if len(codes) > 8:
            low = max(low, slot - 256)
        base[here] = slot - codes[0]
        for c in codes:
            to = base[here] + c
            free[to], check[to], at[kids[c]] = 0, here, to
            queue.append(kids[c])
    for node, k in ends.items():
        value[at[node]] = k
    return base, check, value


@dataclass
class Pieces:
    """A vocabulary: trie, score and id of each piece, ids of the 256 bytes and what each id decodes to."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray
    spelled: list[bytes]
    unknown: float
    longest: int


@dataclass
class KnownWords:
    """What short words give, up to REMEMBERED bytes; starts anew when these are used up."""

    of: dict = field(default_factory=dict)
    size: int = 0

    def taken(self, every: set[str], new: dict) -> dict:
        """What each word of ``every`` gives, by ``new`` for those not known."""
        short = {u: x for u, x in new.items() if len(u) <= SHORT}
        more = sum(map(len, short)) + sum(len(x) for x in short.values() if isinstance(x, bytes)) + 200 * len(short)
        if self.size + more > REMEMBERED:
            new = new | {u: self.of[u] for u in every & self.of.keys()}
            self.of, self.size = {}, 0
            if more > REMEMBERED:
                return new
            self.of, self.size = short, more
            return new
        self.of.update(short)
        self.size += more
        return self.of if len(short) == len(new) else self.of | new


def load(path: str) -> Pieces:
    """Pieces, scores and byte ids of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    keys = [model.id_to_piece(i).encode() for i in normal]
    if odd := [k for k in keys if re.search(f"[^{MARK}]{MARK}|\n.|.\n", k.decode(), re.S)]:
        raise ValueError(f"{len(odd)} pieces cross the start of a word or line, such as {odd[0]!r}")
    score = np.array([model.get_score(i) for i in normal], np.float64)
    spelled = [b""] * n
    byte_ids = np.zeros(256, np.int32)
    for i in range(n):
        if model.is_byte(i):
            b = int(model.id_to_piece(i)[3:-1], 16)
            byte_ids[b], spelled[i] = i, bytes([b])
    for i, key in zip(normal, keys, strict=True):
        spelled[i] = key.replace(MARK.encode(), b" ")
    return Pieces(*build_trie(keys), score, np.array(normal, np.int32), byte_ids, spelled, score.min() - UNKNOWN_PENALTY, max(map(len, keys)))


def _piece_at(p: Pieces, raw: bytes, a: int, b: int) -> int:
    """The place of the piece that is spelled like ``raw[a:b]``, or -1."""
    node = 0
    for k in range(a, b):
        to = p.base[node] + raw[k]
        if p.check[to] != node:
            return -1
        node = to
    return int(p.value[node])


def _cut_long(p: Pieces, raw: bytes) -> bytes:
    """One text by the plain recurrence; any length. Keeps the width of the last piece up to each place, and scores as far as a piece reaches."""
    n, ring = len(raw), p.longest + 4
    width_to = array("H", bytes(2 * (n + 1)))
    best = [float("-inf")] * ring
    best[0] = 0.0
    base, check, value = p.base, p.check, p.value
    for i in range(n):
        here = best[i % ring]
        best[i % ring] = float("-inf")  # the place is that of i + ring from now on
        if raw[i] & 0xC0 == 0x80:
            continue
        width = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        node, single = 0, False
        for j in range(i, min(n, i + p.longest)):
            to = base[node] + raw[j]
            if check[to] != node:
                break
            node = to
            if (k := value[node]) >= 0:
                single |= j + 1 - i == width
                if (s := here + p.score[k]) > best[(j + 1) % ring]:
                    best[(j + 1) % ring], width_to[j + 1] = s, j + 1 - i
        if not single and here + p.unknown > best[(i + width) % ring]:
            best[(i + width) % ring], width_to[i + width] = here + p.unknown, width
    out, at = array("i"), n
    while at:
        start = at - width_to[at]
        if (k := _piece_at(p, raw, start, at)) >= 0:
            out.append(int(p.ids[k]))
        else:
            out.extend(int(p.byte_ids[b]) for b in reversed(raw[start:at]))
        at = start
    return out[::-1].tobytes()


def _cut_short(p: Pieces, raws: list[bytes]) -> list[bytes]:
    """Texts of up to SHORT bytes together; they are filled up with a byte that no text has."""
    size = len(raws)
    length = np.fromiter(map(len, raws), np.int32, size)
    n = int(length.max())
    text = np.frombuffer(b"".join(r.ljust(n, b"\xff") for r in raws), np.uint8).reshape(size, n).T.astype(np.int32)
    best = np.full((n + 1, size), -np.inf)
    best[0] = 0
    start, piece = np.zeros((n + 1, size), np.int32), np.full((n + 1, size), -1, np.int32)
    lead = (text & 0xC0 != 0x80) & (text != 0xFF)
    width = np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)
    for i in range(n):
        rows = np.flatnonzero(lead[i])
        single = np.zeros(size, bool)
        node = np.zeros(len(rows), np.int32)
        live = rows
        for j in range(i, min(n, i + p.longest)):
            to = p.base[node] + text[j, live]
            ok = p.check[to] == node
            live, node = live[ok], to[ok]
            if not len(live):
                break
            k = p.value[node]
            hit = k >= 0
            at, k = live[hit], k[hit]
            single[at[width[i, at] == j + 1 - i]] = True
            s = best[i, at] + p.score[k]
            up = s > best[j + 1, at]
            at = at[up]
            best[j + 1, at], start[j + 1, at], piece[j + 1, at] = s[up], i, k[up]
        bare = rows[~single[rows]]
        if len(bare):
            to = i + width[i, bare]
            s = best[i, bare] + p.unknown
            up = s > best[to, bare]
            to, bare = to[up], bare[up]
            best[to, bare], start[to, bare], piece[to, bare] = s[up], i, -1
    # walk back all together; what no piece covers is marked for its bytes
    at, live, steps = length.copy(), np.flatnonzero(length), []
    while len(live):
        here = at[live]
        k, s = piece[here, live], start[here, live]
        steps.append((np.where(k >= 0, p.ids[k], -1 - (s * 64 + here)), live))
        at[live] = s
        live = live[s > 0]
    owner = np.concatenate([o for _, o in steps[::-1]])
    ids = np.concatenate([x for x, _ in steps[::-1]])
    order = np.argsort(owner, kind="stable")
    ids = ids[order].astype(np.int32)
    ends = np.cumsum(np.bincount(owner, minlength=size)) * 4
    bare = set(owner[order][ids < 0].tolist())
    flat, out, a = ids.tobytes(), [], 0
    for r, b in enumerate(ends.tolist()):
        own = flat[a:b]
        if r in bare:
            wide: list[int] = []
            for i in np.frombuffer(own, np.int32).tolist():
                wide.extend([i] if i >= 0 else p.byte_ids[list(raws[r][(-1 - i) // 64 : (-1 - i) % 64])].tolist())
            own = np.array(wide, np.int32).tobytes()
        out.append(own)
        a = b
    return out


def _cut(p: Pieces, units: list[str]) -> dict[str, bytes]:
    raws = [u.encode("utf-8", "replace") for u in units]
    # by length, as a table is as wide as its longest word
    short = sorted((k for k, r in enumerate(raws) if len(r) <= SHORT), key=lambda k: len(raws[k]))
    out = {u: _cut_long(p, r) for u, r in zip(units, raws, strict=True) if len(r) > SHORT}
    for a in range(0, len(short), TOGETHER):
        some = short[a : a + TOGETHER]
        out.update(zip((units[k] for k in some), _cut_short(p, [raws[k] for k in some]), strict=True))
    return out


def units_of(text: str) -> list[str]:
    return UNIT.findall((MARK + text).replace(" ", MARK)) if text else []


START = re.compile(f"(?<!{MARK}){MARK}")


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that begin where words do."""
    s, at = (MARK + text).replace(" ", MARK), 0
    while len(s) - at > STRETCH and (m := START.search(s, at + STRETCH)):
        yield s[at : m.start()]
        at = m.start()
    yield s[at:]


def stretches(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of (place of the text, words) with about STRETCH characters at most, a longer word apart; in order."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        for units in [units_of(t)] if len(t) <= STRETCH else map(UNIT.findall, _parts(t)):
            group.append((k, units))
            size += sum(map(len, units))
            if size >= STRETCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def encode(p: Pieces, texts: list[str | None], known: KnownWords | None = None) -> list[bytes]:
    """For each text its ids, as the bytes of int32s."""
    known = known or KnownWords()
    out: list[list[bytes]] = [[] for _ in texts]
    for group in stretches(texts):
        every = set().union(*(units for _, units in group))
        now = known.taken(every, _cut(p, list(every - known.of.keys())))
        for k, units in group:
            out[k].append(b"".join([now[u] for u in units]))
    return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def decode(p: Pieces, ids: bytes) -> str:
    """The text of ids given as the bytes of int32s."""
    raw = b"".join(map(p.spelled.__getitem__, np.frombuffer(ids, np.int32).tolist()))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, token_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_byte_pieces, ids_sha256 (of little-endian int32s), decoded_sha256, round_trip and, if asked, token_ids.

    ``path`` is the model file on the driver; its trie, bounded by the vocabulary, goes to the workers.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load(path))
    tail = ", token_ids array<int>" if token_ids else ""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, n_byte_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean{tail}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known = shared.value, KnownWords()
        is_byte = np.zeros(len(p.spelled), bool)
        is_byte[p.byte_ids] = True
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            coded = encode(p, texts, known)
            plain = [decode(p, ids) for ids in coded]
            flat = np.frombuffer(b"".join(coded), np.int32)
            ends = np.cumsum([0, *(len(ids) // 4 for ids in coded)])
            byte_sum = np.concatenate([[0], np.cumsum(is_byte[flat])])
            raws = [t.encode("utf-8", "replace") for t in texts]
            out = [
                batch.column(0),
                pa.array([len(r) for r in raws], pa.int64()),
                pa.array(np.diff(ends), pa.int64()),
                pa.array(byte_sum[ends[1:]] - byte_sum[ends[:-1]], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids in coded]),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in plain]),
                pa.array([a == b for a, b in zip(plain, texts, strict=True)], pa.bool_()),
            ]
            if token_ids:
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(out, names=[s.split()[0] for s in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
