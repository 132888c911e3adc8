"""A byte-level BPE vocabulary, and how a text falls into the pieces that it merges within."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: Fixed values of the vocabulary's pre-tokenizer: contractions, which stand before all other kinds of piece.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _exact() -> re.Pattern:
    """The pre-tokenizer's pattern with its classes spelt out; slow, for texts that hold any of ODD."""
    inside = {"L": [], "N": []}
    for c in map(chr, range(sys.maxunicode + 1)):
        if (major := unicodedata.category(c)[0]) in inside:
            inside[major].append(c)
    letters, numbers = ("".join(f"{re.escape(a)}-{re.escape(z)}" for a, z in _runs(x)) for x in inside.values())
    space = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile("|".join([*CONTRACTIONS, f" ?[{letters}]+", f" ?[{numbers}]+", f" ?[^{space}{letters}{numbers}]+", f"[{space}]+(?![^{space}])", f"[{space}]+"]))


def _runs(chars: list[str]) -> Iterator[tuple[str, str]]:
    """First and last of each run of neighbouring code points."""
    start = None
    for a, z in zip(chars, [*chars[1:], None], strict=True):
        start = start or a
        if z is None or ord(z) != ord(a) + 1:
            yield start, a
            start = None


#: Characters that Python's own classes hold for something else: separators that are no White_Space, numbers that are no digits.
ODD = frozenset("\x1c\x1d\x1e\x1f") | {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")}
_QUICK = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def pieces(text: str) -> list[str]:
    """The pieces of a text without special strings; merges don't cross their borders."""
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else not ODD.isdisjoint(text)
    return (_exact() if odd else _QUICK).findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Token bytes, merge ranks and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, model = _byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {k: v for k, v in model["vocab"].items() if k not in self.special}
        self.id_of = {bytes(letter[c] for c in k): v for k, v in raw.items()}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*raw.values(), *self.special.values()]))
        for k, v in self.id_of.items():
            self.bytes_of[v] = k
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        #: (left, right) to (rank, merged)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.born: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = raw[a], raw[b]
            self.merge[pair] = rank, raw[a + b]
            self.born[raw[a + b]] = (rank, *pair)
        self.longest = max(map(len, self.id_of))
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def segments(self, text: str) -> list[str]:
        """The text, cut around special strings; those stand at odd places."""
        if self.splitter is None or not any(s in text for s in self.special):
            return [text]
        return self.splitter.split(text)


#: Bytes that a worker's known pieces and their results may take, roughly; beyond, it starts anew. Results don't depend on it.
CACHE_BYTES = 96 << 20
#: Of a known piece: its entries in tables and lists, and what each of its characters adds to them.
PIECE_BYTES, CHARACTER_BYTES = 320, 8


class PieceIndex(dict):
    """Numbers distinct pieces as they are met; new ones wait in fresh until their results are known. bytes is what is held."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.bytes = 0

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        self.bytes += PIECE_BYTES + CHARACTER_BYTES * len(piece)
        return n

    @property
    def full(self) -> bool:
        return self.bytes > CACHE_BYTES

    def codes(self, segment: str) -> array:
        return array("q", map(self.__getitem__, pieces(segment)))


@lru_cache(4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
