"""Byte-level BPE as a lazily determinised transducer, and decoding with a UTF-8 state machine.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each
token encodes to itself and each adjacent pair encodes to that pair. So each
prefix of a text has one last token, and following last tokens back gives the
prefix's encoding. Reading on, a later token can only begin where the bytes since
then are the beginning of some token; all tokens before the place where the
chains of those beginnings meet are certain and are emitted. What remains (the
last certain token, the pending bytes and their last tokens) is the state; states
and arcs are made when a text first needs them, and dropped when there are too many.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.llm.pretokens import PieceMemo, splitter


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: a line each, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _State:
    __slots__ = ("arcs", "context", "lasts", "pending", "rest")

    def __init__(self, context: int, pending: bytes, lasts: tuple[int, ...]):
        self.context, self.pending, self.lasts = context, pending, lasts
        self.arcs: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.rest: tuple[int, ...] | None = None  # the ids that end the text here


class Transducer:
    """Encodes the bytes of one piece by ``ranks``; ``limit`` bounds its states."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 180_000):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.longest = max(self.sizes.values(), default=0)
        self.begins = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.sound: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        for s in getattr(self, "states", {}).values():
            s.arcs.clear()  # states hold each other; so they are freed at once
        self.start = _State(-1, b"", ())
        self.states = {(-1, b"", ()): self.start}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joins; None for a single byte."""
        if token not in self.halves:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.sound[token] = len(parts) <= 2
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _apart(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is the two tokens: undoing their merges
        from the last one back, no pair that met at the border would have merged first."""
        ranks, bytes_of = self.ranks, self.bytes_of
        before = 1 << 40  # the rank that a merge over the border must beat
        while True:
            joint = ranks.get(bytes_of[left] + bytes_of[right])
            if joint is not None and joint < before:
                return False
            for side in (0, 1) if left > right else (1, 0):
                halves = self._split(right if side else left)
                if halves:
                    if side:
                        before, right = right + 1, halves[0]
                    else:
                        before, left = left, halves[1]
                    break
            else:
                return True

    def _fits(self, before: int, token: int) -> bool:
        ok = self.sound.get(token)
        if ok is None:
            self._split(token)
            ok = self.sound[token]
        if not ok or before < 0:
            return ok
        key = before << 32 | token
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= 4 * self.limit:
                self.pairs.clear()
            ok = self.pairs[key] = self._apart(before, token)
        return ok

    def _chain(self, pending: bytes, lasts: tuple[int, ...], at: int) -> list[int]:
        """Boundaries from 0 to ``at``."""
        out = [at]
        while at:
            at -= self.sizes[lasts[at - 1]]
            out.append(at)
        return out[::-1]

    def _arc(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        pending, n = state.pending + bytes((byte,)), len(state.pending) + 1
        token = -1
        for at in range(max(0, n - self.longest), n):
            before = state.context if at == 0 else state.lasts[at - 1]
            found = self.ranks.get(pending[at:])
            if found is not None and (at == 0 or before >= 0) and self._fits(before, found):
                token = found
                break
        lasts = (*state.lasts, token)
        # Chains of boundaries from each place where a later token can begin; only what is on one of them is kept.
        begins, sizes = self.begins, self.sizes
        context = state.context
        chains = []
        for at in range(max(0, n - self.longest + 1), n + 1):
            if at == n or ((at == 0 or lasts[at - 1] >= 0) and pending[at:] in begins):
                chain = [at]
                while at:
                    at -= sizes[lasts[at - 1]]
                    chain.append(at)
                chains.append(chain)
        on = set(chains[0])
        common = set(chains[0])
        for chain in chains[1:]:
            on.update(chain)
            common.intersection_update(chain)
        met = max(common)
        out: tuple[int, ...] = ()
        if met:
            out = tuple(lasts[e - 1] for e in reversed(chains[-1]) if 0 < e <= met)
            context = out[-1]
        lasts = tuple(lasts[e - 1] if e in on else -1 for e in range(met + 1, n + 1))
        pending = pending[met:]
        if pending and pending not in begins:
            context = -1  # no later token begins at the border, so what is before it no longer matters
        key = (context, pending, lasts)
        nxt = self.states.get(key)
        if nxt is None:
            nxt = self.states[key] = _State(*key)
        state.arcs[byte] = (nxt, out)
        return nxt, out

    def _rest(self, state: _State) -> tuple[int, ...]:
        if state.rest is None:
            n = len(state.pending)
            state.rest = tuple(state.lasts[e - 1] for e in self._chain(state.pending, state.lasts, n) if e)
        return state.rest

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.limit:
            self._restart()
        state, out = self.start, []
        for i, byte in enumerate(piece):
            arc = state.arcs.get(byte) or self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
            if not i & 0xFFFF and i and len(self.states) > self.limit:  # a very long piece; the state at hand lives on
                self._restart()
        return out + list(self._rest(state)) if piece else out


# Well-formed UTF-8. From a first byte's range: bytes to come, and the range of the next one.
_LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))
_LEAD = {b: (n, lo, hi) for a, z, n, lo, hi in _LEADS for b in range(a, z + 1)}


class Utf8Machine:
    """Incremental UTF-8: ``push`` gives the bytes of all characters that are complete, and holds the rest.

    The state is the bytes held (at most 3) with the number and range of those to come.
    Bytes that can't continue a character are passed on, for the caller to replace.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(tail: bytes) -> bool:
        """Whether ``tail`` is the proper beginning of a character."""
        lead = _LEAD.get(tail[0])
        if lead is None:
            return False
        more, lo, hi = lead
        for b in tail[1:]:
            if not lo <= b <= hi:
                return False
            more, lo, hi = more - 1, 0x80, 0xBF
        return more > 0

    def push(self, chunk: bytes) -> bytes:
        data, self.held = self.held + chunk, b""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                if self._open(data[-back:]):
                    data, self.held = data[:-back], data[-back:]
                break
            if data[-back] < 0x80:
                break
        return data

    def finish(self) -> bytes:
        data, self.held = self.held, b""
        return data


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], at_once: int = 4096) -> Iterator[bytes]:
    """The bytes of ``ids`` in chunks that never end inside a character (but for the last, if the ids do)."""
    machine = Utf8Machine()
    ids = iter(ids)
    while some := list(itertools.islice(ids, at_once)):
        if done := machine.push(b"".join(map(bytes_of.__getitem__, some))):
            yield done
    if done := machine.finish():
        yield done


class Codec:
    """Encoding of whole texts and decoding; pieces met before are taken from a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, held: int = 700_000):
        self.machine = Transducer(ranks)
        self.split = splitter(pattern)
        self.memo = PieceMemo(one=lambda piece: self.machine.encode(piece.encode("utf-8")), limit=held)
        self.bytes_of = self.machine.bytes_of

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.memo.ids(self.split(text)), "<u4")

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        return decode_stream(ids.tolist(), self.bytes_of)


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, held: int = 700_000) -> Codec:
    """A process's codec; ``held`` pieces are remembered, at some 200 bytes each."""
    key = (path, pattern, held)
    if key not in _codecs:
        _codecs.clear()  # one at a time, for its memory
        _codecs[key] = Codec(read_ranks(path), pattern, held)
    return _codecs[key]


def _rows(docs: DataFrame, one: Callable[[Codec, str], tuple], names: list[str], kinds: list, schema: str, path: str, pattern: str, held: int = 700_000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern, held)
        for b in batches:
            made = [one(use, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of each row; null and empty texts have no ids."""
    return _rows(docs, lambda c, t: (c.encode(t).astype(np.int32),), ["doc_id", "ids"], [pa.list_(pa.int32())], "doc_id long, ids array<int>", path, pattern)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, ".")
        for b in batches:
            texts = [None if ids is None else "".join(x.decode("utf-8", "replace") for x in decode_stream(ids, use.bytes_of)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str, held: int = 1_200_000) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, the text encoded and its ids decoded again.

    Null and empty texts have no ids. Repeated rows stay; other columns are ignored;
    an empty table gives an empty result. A row is worked on alone, whatever its length. A task remembers ``held`` pieces.
    """

    def one(c: Codec, text: str) -> tuple[int, str, str]:
        ids, out = c.encode(text), hashlib.sha256()
        for done in c.decode(ids):
            out.update(done)
        return len(ids), hashlib.sha256(ids).hexdigest(), out.hexdigest()

    return _rows(docs, one, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, held)
