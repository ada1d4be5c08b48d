"""Splitting text before byte-pair merges, and a bounded memory of what pieces encode to."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex

# Latin letters, and the characters for which the plain pattern below splits as the published one does.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_ODD = re.compile(f"[^\\t\\n\\r\\x20-\\x7e¡-©«-±´¶-¸»¿×÷{_LETTER}]")
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \\t\\n\\r0-9{_LETTER}]+|[ \\t\\n\\r]+(?![^ \\t\\n\\r])|[ \\t\\n\\r]+")


_PLAIN_BYTES = bytes(i for i in range(256) if not _ODD.search(chr(i)))


def is_plain(text: str) -> bool:
    """Whether every character is one that ``split_plain`` is exact for."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return not _ODD.search(text)


split_plain = _PLAIN.findall


#: Fixed value: the published pattern, which ``split_plain`` stands for.
PUBLISHED = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


@lru_cache(1)
def _other_classes() -> tuple[regex.Pattern, dict[int, str]]:
    """Characters that the tiktoken library's Unicode tables class otherwise than ours, and for each a usual one of its class there."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    odd, theirs = set(), []
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        own = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs.append(set(bytes(own.encode_ordinary(every)).decode()))
        odd |= theirs[-1] ^ set(regex.findall(kind, every))
    stands = {ord(c): "a" if c in theirs[0] else "1" if c in theirs[1] else "\n" if c in theirs[2] else "!" for c in odd}
    return regex.compile(f"[{''.join(map(regex.escape, sorted(odd)))}]" if odd else r"(?!)"), stands


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pieces of a text under ``pattern``, as the tiktoken library splits it.

    Under the published pattern plain Latin text takes a faster, equal way, and characters that the library's
    Unicode tables class otherwise are split by their class there. Other patterns are run as they are.
    """
    full = regex.compile(pattern)
    if pattern != PUBLISHED:
        return lambda text: [m[0] for m in full.finditer(text)]

    def split(text: str) -> list[str]:
        if is_plain(text):
            return split_plain(text)
        odd, stands = _other_classes()
        if not odd.search(text):
            return full.findall(text)
        return [text[m.start() : m.end()] for m in full.finditer(text.translate(stands))]

    return split


class PieceMemo(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes, for about ``limit`` pieces.

    Half of them are the latest, the others those before; when the latest are too many they take the place of the others, so that a
    piece stays as long as it is met now and then. ``one`` encodes a piece, or ``many`` a list of them.
    """

    def __init__(self, one: Callable[[str], list[int]] | None = None, many: Callable[[list[str]], list[list[int]]] | None = None, limit: int = 700_000, longest: int = 64):
        super().__init__()
        self.one, self.many, self.half, self.longest = one, many, limit // 2, longest
        self.before: dict[str, bytes] = {}

    def _room(self, n: int = 1) -> None:
        if len(self) + n > self.half:
            self.before = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        out = self.before.get(piece)
        if out is None:
            out = array("I", self.one(piece)).tobytes()
        if len(piece) <= self.longest:
            self._room()
            self[piece] = out
        return out

    def ids(self, pieces: list[str]) -> bytes:
        """The ids of all ``pieces``, joined. With ``many``, a call's own distinct pieces are held at a time, whatever the limit."""
        if self.one:
            return b"".join(map(self.__getitem__, pieces))
        found = list(map(self.get, pieces))
        try:
            return b"".join(found)
        except TypeError:  # some aren't among the latest
            missing = [i for i, x in enumerate(found) if x is None]
        old = self.before
        made = {p: old.get(p) for p in dict.fromkeys(pieces[i] for i in missing)}
        new = [p for p, x in made.items() if x is None]
        if new:
            made.update(zip(new, (array("I", x).tobytes() for x in self.many(new)), strict=True))
        for i in missing:
            found[i] = made[pieces[i]]
        kept = {p: x for p, x in made.items() if len(p) <= self.longest}
        self._room(len(kept))
        self.update(kept)
        return b"".join(found)
