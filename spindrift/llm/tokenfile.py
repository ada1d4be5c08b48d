"""Token ids of documents in files of independent zstandard frames with a trailing seek table.

A file holds one or more segments. A segment is

    zstandard frames, each with the ids of whole consecutive documents
    one skippable zstandard frame, with the seek table:
        per frame: compressed bytes, raw bytes, low half of the raw bytes' XXH64 (unsigned 32 bits each)
        per document: doc_id (signed 64 bits), its frame, its first id in the frame, its number of ids (unsigned 32 bits)
        footer: frames, documents (unsigned 64 bits), width of an id in bytes, bytes of the segment (unsigned 64 bits), MAGIC

with all numbers little-endian. A zstandard tool that reads the file sees the
ids alone. A reader starts at the end, and decompresses the frames it needs.
MAGIC ends in a line feed, which Spark's text writer puts there: so files are
written through Spark's own commit protocol to any store that Spark reaches.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import planned_bytes, scratch_path
from spindrift.llm.pretokens import PieceMemo, is_plain, split_plain

MAGIC = b"SPTOKZ1\n"
_SKIPPABLE = 0x184D2A5E
_FOOTER = struct.Struct("<QQQQ8s")
_FRAMES = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("sum", "<u4")])
_DOCS = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


class SegmentWriter:
    """Gathers documents; ``close`` gives the segment's bytes without the last line feed. Ids of more than ``width`` bytes are refused."""

    def __init__(self, width: int = 2, frame_ids: int = 32768, level: int = 3):
        self.width, self.frame_ids = width, frame_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.frames: list[tuple] = []
        self.docs: list[tuple] = []
        self.size, self.held, self.held_n = 0, [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} doesn't fit in {self.width} bytes")
        self.docs.append((doc_id, len(self.frames), self.held_n, len(ids)))
        self.held.append(ids.astype(f"<u{self.width}").tobytes())
        self.held_n += len(ids)
        if self.held_n >= self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.zip.compress(raw)
        self.parts.append(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)
        self.held, self.held_n = [], 0

    def close(self) -> bytes:
        if self.held:
            self._frame()
        tables = np.array(self.frames, _FRAMES).tobytes() + np.array(self.docs, _DOCS).tobytes()
        inside = len(tables) + _FOOTER.size
        footer = _FOOTER.pack(len(self.frames), len(self.docs), self.width, self.size + 8 + inside, MAGIC)
        return b"".join([*self.parts, struct.pack("<II", _SKIPPABLE, inside), tables, footer])[:-1]


class Segment:
    """Random access to one segment that ends at ``end`` of ``data`` (bytes or a memory map)."""

    def __init__(self, data: bytes, end: int | None = None):
        end = len(data) if end is None else end
        n_frames, n_docs, self.width, size, magic = _FOOTER.unpack(data[end - _FOOTER.size : end])
        if magic != MAGIC:
            raise ValueError("no token file: its end mark is missing")
        self.data, self.start = data, end - size
        at = end - _FOOTER.size - n_docs * _DOCS.itemsize
        self.docs = np.frombuffer(data[at : end - _FOOTER.size], _DOCS)
        self.frames = np.frombuffer(data[at - n_frames * _FRAMES.itemsize : at], _FRAMES)
        self.offsets = self.start + np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            raw = self.unzip.decompress(self.data[self.offsets[k] : self.offsets[k + 1]], max_output_size=int(self.frames["raw"][k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["sum"][k]:
                raise ValueError(f"frame {k}: its checksum is wrong")
            self._last = (k, np.frombuffer(raw, f"<u{self.width}"))
        return self._last[1]

    def document(self, row: int) -> np.ndarray:
        """The ids of the document in that row of ``docs``; only its frame is decompressed."""
        d = self.docs[row]
        return self.frame(int(d["frame"]))[int(d["at"]) : int(d["at"]) + int(d["n"])]


def segments(data: bytes) -> list[Segment]:
    """All segments of a file, in order."""
    found, end = [], len(data)
    while end > 0:
        found.append(Segment(data, end))
        end = found[-1].start
    return found[::-1]


_encoders: dict[str, Callable[[list[str]], Iterator[np.ndarray]]] = {}


def encoder(tokenizer_file: str) -> Callable[[Iterable[str]], Iterator[np.ndarray]]:
    """Encodes texts with the tokenizers library, special tokens' strings being ordinary text.

    A byte-level tokenizer's merges never cross the pieces that its pattern
    splits off, so each distinct piece is encoded by the library once and kept in
    a bounded memory; texts with characters beyond plain Latin go to the library
    whole, and so do all texts where the file has another pattern than the published one, or a normalizer.
    """
    if tokenizer_file not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)
        tok.encode_special_tokens = True
        whole = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        memo, usual = PieceMemo(many=whole, limit=1_000_000), _usual(tok)

        def encode(texts: Iterable[str]) -> Iterator[np.ndarray]:
            for t in texts:
                yield np.frombuffer(memo.ids(split_plain(t)), "<u4") if usual and is_plain(t) else np.array(whole([t])[0], np.uint32)

        _encoders[tokenizer_file] = encode
    return _encoders[tokenizer_file]


def _usual(tok) -> bool:
    """Whether a tokenizer splits by the published byte-level pattern, and nothing before or besides."""
    told = json.loads(tok.to_str())
    first, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    special = all(x["special"] for x in told.get("added_tokens") or [])  # others are found in ordinary text
    return plain and special and not told.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex") is True and not first.get("add_prefix_space")


def _id_width(tokenizer_file: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True).values()])
    return 2 if most < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, segment_bytes: int = 64 << 20, range_bytes: int = 256 << 20, segments_a_file: int = 8, frame_ids: int = 32768) -> None:
    """Writes the ids of ``docs`` (``doc_id, text``) below ``path`` in ascending doc_id order over the files.

    Null and empty texts are their end id alone. Rows of equal doc_id are kept, in
    order of their texts. An empty table writes no segment. Other columns are ignored. Ids take two bytes,
    or four if the vocabulary has more. There is a range of doc_ids for each ``range_bytes`` of the table, and a
    file holds ``segments_a_file`` segments at most, so that none nears the 2 GB that can be read at once.
    """
    width = _id_width(tokenizer_file, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_file), np.array([end_id], np.uint32)
        out = None
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(t or "" for t in b.column(1).to_pylist()), strict=True):
                out = out or SegmentWriter(width, frame_ids)
                out.add(doc_id, np.concatenate((ids, end)))
                if out.size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], ["value"])
                    out = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], ["value"])

    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), planned_bytes(docs) // range_bytes)
    ordered = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", segments_a_file).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files below ``path``.

    ``start`` counts the ids of all documents before it. One pass reads the seek tables
    for the segments' totals (a row per segment), another decompresses the frames.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(int(s.docs["doc_id"][0]), int(s.docs["doc_id"][-1]), k, int(s.docs["n"].sum(dtype=np.int64))) for k, s in enumerate(segments(data))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["path", "first", "last", "seg", "total"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, s in enumerate(segments(data)):
                    n = s.docs["n"].astype(np.int64)
                    sums = np.array([zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in range(len(n))], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(n)), pa.array(np.full(len(n), k)), pa.array(s.docs["doc_id"].astype(np.int64)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(sums)], ["path", "seg", "doc_id", "local", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    by_order = Window.orderBy("first", "last", "path", "seg")  # a row for each segment
    starts = files.mapInArrow(totals, "path string, first long, last long, seg long, total long").withColumn("before", F.sum("total").over(by_order) - F.col("total")).select("path", "seg", "before")
    found = files.mapInArrow(rows, "path string, seg long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["path", "seg"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of the documents in ``doc_ids`` (in the files below ``path``); no frame without one of them is decompressed."""
    wanted = np.unique(np.array(doc_ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                for s in segments(data):
                    rows = np.nonzero(np.isin(s.docs["doc_id"], wanted))[0].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(s.docs["doc_id"][rows].astype(np.int64)), pa.array([s.document(i).astype(np.int64) for i in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, ids array<long>")


def open_documents(file: str, doc_ids: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The documents in ``doc_ids`` of a file on this machine, which is mapped, not read."""
    with open(file, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        for s in segments(data):
            for i in np.nonzero(np.isin(s.docs["doc_id"], doc_ids))[0].tolist():
                yield int(s.docs["doc_id"][i]), s.document(i).copy()


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_file, end_id)
    return read_token_files(spark, path)
