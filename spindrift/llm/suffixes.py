"""Removal of byte strings that an earlier document holds, by a distributed sparse suffix array.

A string of ``length`` bytes repeats exactly if two suffixes share it as their beginning.
Not every suffix is sorted: within each window of ``length`` bytes the block of BLOCK bytes with
the least hash is its anchor, so equal windows have equal anchors at the same place, and
it is enough to sort the suffixes at anchors and to compare around them.

1. Documents are packed in chunks, a table in the shared folder.
2. Each chunk sends the distinct leading tokens (the hash of the first BLOCK bytes) of
   its anchors' suffixes to range partitions with sampled splitters, and learns
   which of them other documents hold. All others can't repeat and go no further.
3. The suffixes that are left go, each with the bytes around its anchor and once for each chunk,
   to range partitions by leading bytes, again with sampled splitters. Each partition sorts its suffixes by
   multikey quicksort, joins equal runs, and finds for each window around an anchor whether an earlier
   document holds it. Splitters cut between leading bytes, so equal runs never cross a boundary.
   Leading bytes so frequent that several splitters fall on them would fill one partition; the windows around
   their anchors are sent alone, once for each chunk, to partitions by their hash: a passage in
   a third of all documents then costs a row per chunk, and what differs around it spreads.
4. The answers go back to the chunks, which cut their documents.

Hashes only propose: windows are compared byte by byte with the one that they are said to equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import bucketed_table, kept_table, table_bytes

BLOCK = 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_OUT = 0xFF  # no byte of UTF-8: stands for what is beyond a document's ends
_PIECE = 1 << 19


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def block_hashes(x: np.ndarray, n: int = BLOCK) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes at each place of ``x``, by doubling."""
    h, have, b = x.astype(np.uint64) + np.uint64(1), 1, _B
    out, out_n = None, 0
    power = b
    powers = {1: b}
    with np.errstate(over="ignore"):
        while True:
            if n & have:
                if out is None:
                    out, out_n = h, have
                else:
                    m = len(h) - out_n
                    out = out[:m] * powers[have] + h[out_n : out_n + m]
                    out_n += have
            if have * 2 > n:
                break
            h = h[: len(h) - have] * power + h[have:]
            power = power * power
            have *= 2
            powers[have] = power
        return _mix(out[: max(0, len(x) - n + 1)])


def _sliding(f, a: np.ndarray, n: int) -> np.ndarray:
    """f (minimum or maximum) over each ``n`` neighbours."""
    have = 1
    while have * 2 <= n:
        a = f(a[:-have], a[have:])
        have *= 2
    return f(a[: len(a) - (n - have)], a[n - have :]) if n > have else a


def anchors(x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows of ``length`` bytes within documents (ending at ``ends``), and their blocks' hashes."""
    w = length - BLOCK + 1
    starts = np.concatenate(([0], ends[:-1]))
    places, hashes = [], []
    for at in range(0, len(x) - length + 1, _PIECE):
        part = x[at : at + _PIECE + length - 1]
        h = block_hashes(part)
        low = _sliding(np.minimum, h, w)  # of the window at each place
        good = np.zeros(len(low) + 1, np.int32)
        a, z = np.clip(starts - at, 0, len(low)), np.clip(ends - length + 1 - at, 0, len(low))
        use = z > a
        np.add.at(good, a[use], 1)
        np.add.at(good, z[use], -1)
        low[np.cumsum(good[:-1]) == 0] = 0
        high = _sliding(np.maximum, np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64))), w)
        found = np.nonzero((high == h) & (h != 0))[0]
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def contexts(x: np.ndarray, ends: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    """The bytes from length - BLOCK before to length after each place, those beyond the document marked."""
    left = length - BLOCK
    doc = np.searchsorted(ends, p, side="right")
    lo, hi = np.concatenate(([0], ends[:-1]))[doc], ends[doc]
    out = np.empty((len(p), left + length), np.uint8)
    for a in range(0, len(p), 65536):
        at = p[a : a + 65536, None] + np.arange(-left, length)
        inside = (at >= lo[a : a + 65536, None]) & (at < hi[a : a + 65536, None])
        out[a : a + 65536] = np.where(inside, x[np.clip(at, 0, len(x) - 1)], _OUT)
    return out


def multikey_order(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the rows of bytes ``c``, and in it the number of each run of equal rows.

    Multikey quicksort with keys of eight bytes: rows are sorted by a key, and only runs that are
    equal so far are sorted by the next.
    """
    n, width = c.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = c
    keys = padded.view(">u8").astype(np.uint64)
    order, run = np.arange(n), np.zeros(n, np.int64)
    active = np.arange(n)  # places in ``order`` whose runs are longer than one
    for k in range(keys.shape[1]):
        if not len(active):
            break
        rows = order[active]
        key = keys[rows, k]
        by = np.lexsort((key, run[active]))
        order[active] = rows[by]
        key, old = key[by], run[active]  # runs are contiguous, so they stay in place
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])))
        run[active] = active[np.nonzero(new)[0]][np.cumsum(new) - 1]
        sizes = np.diff(np.append(np.nonzero(new)[0], len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
    return order, run


def earlier_windows(c: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each suffix a bit per window around its anchor: whether a suffix of an earlier document has it."""
    left = length - BLOCK
    suffix_first = np.concatenate((c[:, left:], c[:, :left]), axis=1)
    order, run = multikey_order(suffix_first)
    c, docs = c[order], docs[order]
    new = np.concatenate(([True], run[1:] != run[:-1]))
    heads = np.nonzero(new)[0]
    first_doc = np.minimum.reduceat(docs, heads)
    number = np.cumsum(new) - 1
    u = c[heads]  # distinct contexts, each of its earliest document
    block = u[:, left : left + BLOCK]
    same = np.concatenate(([False], (block[1:] == block[:-1]).all(axis=1)))
    several = same | np.concatenate((same[1:], [False]))  # other contexts have the same block
    full = np.uint32((1 << (left + 1)) - 1)
    bits = np.zeros(len(u), np.uint32)
    rows = np.nonzero(several)[0]
    for a in _slabs(same, rows):
        v, d = u[a], first_doc[a]
        sums = np.zeros((len(v), v.shape[1] + 1), np.uint64)
        power = np.ones(length + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(v.shape[1]):
                sums[:, i + 1] = sums[:, i] * _B + v[:, i] + np.uint64(1)
            for i in range(length):
                power[i + 1] = power[i] * _B
            for j in range(left + 1):
                h = _mix(sums[:, j + length] - sums[:, j] * power[length])
                by = np.lexsort((d, h))
                hs, starts = h[by], None
                starts = np.concatenate(([True], hs[1:] != hs[:-1]))
                head = by[np.nonzero(starts)[0][np.cumsum(starts) - 1]]
                hit = d[head] < d[by]
                x, y = by[hit], head[hit]
                x = x[(v[x, j : j + length] == v[y, j : j + length]).all(axis=1) & (v[x, j : j + length] != _OUT).all(axis=1)]
                bits[a[x]] |= np.uint32(1 << j)
    out = np.empty(len(c), np.uint32)
    out[order] = np.where(first_doc[number] < docs, full, bits[number])
    return out


def earlier_equal(c: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each window 1 if an earlier document has it, else 0."""
    order, run = multikey_order(c)
    heads = np.nonzero(np.concatenate(([True], run[1:] != run[:-1])))[0]
    first = np.repeat(np.minimum.reduceat(docs[order], heads), np.diff(np.append(heads, len(order))))
    out = np.empty(len(c), np.uint32)
    out[order] = first < docs[order]
    return out


def _slabs(same: np.ndarray, rows: np.ndarray, most: int = 40_000) -> Iterator[np.ndarray]:
    """``rows`` in pieces of about ``most`` that end between blocks."""
    at = 0
    while at < len(rows):
        to = min(len(rows), at + most)
        while to < len(rows) and same[rows[to]]:
            to += 1
        yield rows[at:to]
        at = to


# ---------------------------------------------------------------- on DataFrames
_CHUNK = "chunk long, ids binary, sizes binary, packed binary"


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped, task, seq = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            raw = b"".join(texts)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(list(map(len, texts)), np.int64).tobytes()], pa.binary()), pa.array([zipped.compress(raw)], pa.binary())], ["chunk", "ids", "sizes", "packed"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8")
                if ids and size + len(raw) > chunk_bytes:
                    yield out()
                    ids, texts, size, seq = [], [], 0, seq + 1
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, _CHUNK)


class _Chunk:
    def __init__(self, ids: bytes, sizes: bytes, packed: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.cumsum(np.frombuffer(sizes, np.int64))
        total = int(self.ends[-1]) if len(self.ends) else 0
        self.raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=total) if total else b""
        self.x = np.frombuffer(self.raw, np.uint8)

    def doc_of(self, p: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, p, side="right")]


def _array(values: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values).tobytes())


def _values(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


#: Keys that are sampled for each partition, and from each chunk.
_SAMPLE, _OF_CHUNK = 8, 2000


def _splitters(chunks: DataFrame, buckets: int, take, length: int) -> tuple[np.ndarray, np.ndarray]:
    """At most buckets - 1 splitters from a hashed sample of chunks, and the tokens on which several fell.

    ``take`` gives a chunk's leading tokens. The sample only balances partitions. It grows with them: a token
    on which two splitters fall holds about the share of a whole partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = _Chunk(r["ids"], r["sizes"], r["packed"])
                p, h = anchors(c.x, c.ends, length)
                keep = np.nonzero(p % 61 == 0)[0]
                keep = keep[:: -(-len(keep) // _OF_CHUNK)] if len(keep) else keep
                v = take(c, p[keep], h[keep])
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.uint64).view(np.int64))], ["k"])

    n = chunks.count()
    some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max(24, 2 * _SAMPLE * buckets / _OF_CHUNK) / max(n, 1))))
    keys = np.sort(some.mapInArrow(run, "k long").toArrow().column(0).to_numpy().view(np.uint64))
    buckets = max(1, min(buckets, len(keys) // _SAMPLE))
    if buckets == 1:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    found, times = np.unique(keys[np.linspace(0, len(keys) - 1, buckets + 1).astype(int)[1:-1]], return_counts=True)
    return found, found[times > 1]


def _windows_alone(c: _Chunk, p: np.ndarray, length: int, buckets: int) -> list[tuple]:
    """Rows to send for the windows around the anchors ``p``: each distinct window once, to a partition beyond ``buckets`` by its hash."""
    if not len(p):
        return []
    left = length - BLOCK
    doc = np.searchsorted(c.ends, p, side="right")
    lo, hi = np.concatenate(([0], c.ends[:-1]))[doc], c.ends[doc]
    at = p[:, None] + np.arange(-left, 1)
    at = np.unique(at[(at >= lo[:, None]) & (at + length <= hi[:, None])])
    h, d = block_hashes(c.x, length)[at], c.doc_of(at)
    order = np.lexsort((d, h))
    at, h, d = at[order], h[order], d[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    head = np.nonzero(new)[0][np.cumsum(new) - 1]
    same = np.ones(len(at), bool)
    for a in range(0, len(at), 65536):  # a window that only has the hash of another isn't taken for it
        x, y = at[a : a + 65536, None] + np.arange(length), at[head[a : a + 65536], None] + np.arange(length)
        same[a : a + 65536] = (c.x[x] == c.x[y]).all(axis=1)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    out = []
    for k in np.unique(bucket).tolist():
        mine = np.nonzero((bucket == k) & same)[0]
        heads, number = np.unique(head[mine], return_inverse=True)
        windows = c.x[at[heads][:, None] + np.arange(length)]
        out.append((buckets + k, _array(windows, 3), _array(d[heads]), _array(at[mine].astype(np.uint32)), _array(number.astype(np.uint32)), _array(d[mine] > d[heads][number])))
    return out


def _leading(c: np.ndarray) -> np.ndarray:
    """The first eight bytes of suffixes as numbers."""
    return np.ascontiguousarray(c[:, :8]).view(">u8").ravel().astype(np.uint64)


def sizes(total: int) -> tuple[int, int, int]:
    """Bytes of a chunk, partitions of suffixes and buckets of chunks for a table of ``total`` bytes.

    Chunks and partitions grow with the table up to what a task holds, so that the messages between them, up to one for each
    pair, have keys enough to be worth a row.
    """
    chunk = min(96 << 20, max(6 << 20, total // 20_000))
    return chunk, int(max(24, total // min(256 << 20, max(24 << 20, total // 4_000)))), int(total // (128 << 20))


def repeats(docs: DataFrame, length: int = 50, chunk_bytes: int | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): what is left without the bytes that an earlier document's string covers.

    A byte goes if a string of ``length`` (21 to 51) bytes over it also stands in a document of smaller doc_id;
    strings don't cross documents and are judged on the input. Returns ``doc_id, n_bytes, n_removed,
    n_spans, kept_sha256``. Null and empty texts have no bytes; rows of one doc_id
    don't remove from each other; other columns are ignored; an empty table gives an empty result.
    """
    if not BLOCK < length <= BLOCK + 31:  # a bit for each window around an anchor
        raise ValueError(f"length must be from {BLOCK + 1} to {BLOCK + 31}")
    spark = docs.sparkSession
    left = length - BLOCK
    total = table_bytes(docs)
    chunk, buckets, held = sizes(total)
    chunks = bucketed_table(_chunks(docs, chunk_bytes or chunk), "chunk", "chunks", held)  # joined with twice, and never sent
    width = min(8, max(4, math.ceil((math.log2(max(total, 1) / 16 + 1) + 14) / 8)))  # bytes of a token that tell most apart; equal ones only cost a comparison
    hashed = spark.sparkContext.broadcast(_splitters(chunks, buckets, lambda c, p, h: h, length)[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = _Chunk(r["ids"], r["sizes"], r["packed"])
                p, h = anchors(c.x, c.ends, length)
                d = c.doc_of(p)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                heads = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0] if len(h) else np.empty(0, np.int64)
                several = (np.maximum.reduceat(d, heads) != np.minimum.reduceat(d, heads)) if len(h) else np.empty(0, bool)
                h = h[heads]
                at = np.searchsorted(hashed.value, h, side="right")
                cuts = np.searchsorted(at, np.arange(len(hashed.value) + 2))
                top = np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :width]
                rows = [(k, r["chunk"], top[i:j].tobytes(), np.packbits(several[i:j]).tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[3] for x in rows], pa.binary())], ["bucket", "chunk", "keys", "several"])

    def answer(t: pa.Table) -> pa.Table:
        keys = []
        for k in t["keys"].to_pylist():
            wide = np.zeros((len(k) // width, 8), np.uint8)
            wide[:, :width] = np.frombuffer(k, np.uint8).reshape(-1, width)
            keys.append(wide.view(">u8").ravel().astype(np.uint64))
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool) for s, k in zip(t["several"].to_pylist(), keys, strict=True)]
        every, flag = np.concatenate(keys), np.concatenate(several)
        order = np.argsort(every, kind="stable")
        s = every[order]
        equal = s[1:] == s[:-1]
        shared = np.zeros(len(s), bool)
        shared[1:] |= equal
        shared[:-1] |= equal
        out = np.empty(len(s), bool)
        out[order] = shared
        out |= flag
        cuts = np.cumsum([0, *map(len, keys)])
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "shared": pa.array([np.packbits(out[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    asked = chunks.mapInArrow(ask, "bucket int, chunk long, keys binary, several binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, shared binary")
    by_chunk = told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared")).alias("told"))
    split = spark.sparkContext.broadcast(_splitters(chunks, buckets, lambda c, p, h: _leading(contexts(c.x, c.ends, p, length)[:, left:]), length))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = _Chunk(r["ids"], r["sizes"], r["packed"])
                p, h = anchors(c.x, c.ends, length)
                u, inverse = np.unique(h, return_inverse=True)
                at = np.searchsorted(hashed.value, u, side="right")
                cuts, shared = np.searchsorted(at, np.arange(len(hashed.value) + 2)), np.zeros(len(u), bool)
                for x in r["told"] or []:
                    i, j = cuts[x["bucket"]], cuts[x["bucket"] + 1]
                    shared[i:j] = np.unpackbits(np.frombuffer(x["shared"], np.uint8), count=j - i)
                p = p[shared[inverse]]
                around, d = contexts(c.x, c.ends, p, length), c.doc_of(p)
                split_at, frequent = split.value
                first_bytes = _leading(around[:, left:])
                lead = np.searchsorted(split_at, first_bytes, side="right")
                often = np.isin(first_bytes, frequent)
                rows = _windows_alone(c, p[often], length, buckets)
                rows = [(k, r["chunk"], *rest) for k, *rest in rows]
                lead[often] = -1
                for k in np.unique(lead[lead >= 0]).tolist():
                    mine = np.nonzero(lead == k)[0]
                    v = around[mine]
                    order, run = multikey_order(v)
                    heads = np.nonzero(np.concatenate(([True], run[1:] != run[:-1])))[0]
                    first = np.minimum.reduceat(d[mine][order], heads)
                    number = np.empty(len(mine), np.uint32)
                    number[order] = np.cumsum(np.concatenate(([True], run[1:] != run[:-1]))) - 1
                    rows.append((k, r["chunk"], _array(v[order[heads]], 3), _array(first), _array(p[mine].astype(np.uint32)), _array(number), _array(d[mine] > first[number])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64()), *(pa.array([x[q] for x in rows], pa.binary()) for q in range(2, 7))], ["bucket", "chunk", "around", "docs", "places", "number", "later"])

    sent = kept_table(chunks.join(by_chunk, "chunk", "left").select("chunk", "ids", "sizes", "packed", "told").mapInArrow(send, "bucket int, chunk long, around binary, docs binary, places binary, number binary, later binary"), "suffixes")

    def sort(t: pa.Table) -> pa.Table:
        docs_of = [_values(x, np.int64) for x in t["docs"].to_pylist()]
        alone = t["bucket"][0].as_py() >= buckets
        c = np.concatenate([_values(x, np.uint8).reshape(len(d), length if alone else left + length) for x, d in zip(t["around"].to_pylist(), docs_of, strict=True)])
        bits = (earlier_equal if alone else earlier_windows)(c, np.concatenate(docs_of), length)
        cuts = np.cumsum([0, *map(len, docs_of)])
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "bits": pa.array([_array(bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    sorted_ = sent.select("bucket", "chunk", "around", "docs").groupBy("bucket").applyInArrow(sort, "chunk long, bucket int, bits binary")
    back = sorted_.join(sent.select("bucket", "chunk", "places", "number", "later"), ["bucket", "chunk"]).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits", "places", "number", "later")).alias("back"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = _Chunk(r["ids"], r["sizes"], r["packed"])
                doc_ends, doc_starts = c.ends, np.concatenate(([0], c.ends[:-1]))
                edge = np.zeros(len(c.x) + 1, np.int32)
                for x in r["back"] or []:
                    bits, later = _values(x["bits"], np.uint32)[_values(x["number"], np.uint32)], _values(x["later"], bool)
                    p = _values(x["places"], np.uint32).astype(np.int64)
                    if x["bucket"] >= buckets:
                        at = p[bits.astype(bool) | later]
                        edge[at] += 1
                        edge[at + length] -= 1
                        continue
                    doc = np.searchsorted(c.ends, p, side="right")
                    for j in range(left + 1):
                        at = p - left + j
                        ok = ((bits >> np.uint32(j)) & np.uint32(1)).astype(bool) | later
                        ok &= (at >= doc_starts[doc]) & (at + length <= doc_ends[doc])
                        at = np.unique(at[ok])
                        edge[at] += 1
                        edge[at + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                rows = []
                for i, a, z in zip(c.ids.tolist(), doc_starts.tolist(), doc_ends.tolist(), strict=True):
                    g = gone[a:z]
                    n = int(g.sum())
                    spans = int((g[1:] & ~g[:-1]).sum()) + int(z > a and g[0]) if n else 0
                    rows.append((i, z - a, n, spans, hashlib.sha256(c.x[a:z][~g] if n else c.raw[a:z]).hexdigest()))
                yield pa.RecordBatch.from_arrays([*(pa.array([x[q] for x in rows], pa.int64()) for q in range(4)), pa.array([x[4] for x in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return chunks.join(back, "chunk", "left").select("chunk", "ids", "sizes", "packed", "back").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
