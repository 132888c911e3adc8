"""BPE encoding and decoding over an index of pair occurrences.

A partition's pieces are known by number while memory allows. Those that a slice of it adds lie side by side in one array of
symbols, linked to their neighbours. An index maps each
adjacent pair that some merge takes to all its places. The lowest active rank is applied at all its places at once, and the
pairs that it makes are added to the lists of their own ranks, until no rank is active.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, PieceIndex, default_path, load
from .common import sliced, table


class PairIndexBpe:
    """Encodes pieces and decodes ids, of one vocabulary."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.width = bpe, len(bpe.bytes_of)
        keys = np.array([a * self.width + b for a, b in bpe.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in bpe.merge.values()], np.int32)[order]
        self.by_rank = {r: (a, b, m) for (a, b), (r, m) in bpe.merge.items()}
        self.byte_ids = np.array(bpe.byte_ids, np.int32)
        self.digits = [str(k).encode() for k in range(self.width)]
        self.reset()

    def reset(self) -> None:
        self.index, self.ids_text, self.decoded, self.length = PieceIndex(), [], [], np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        sym = self.byte_ids[data]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        nxt[ends[size > 0] - 1] = -1
        prv[(ends - size)[size > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            rank = self._rank(sym[places], sym[nxt[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            starts = [0, *cuts.tolist()]
            for r, a, z in zip(rank[starts].tolist(), starts, [*starts[1:], len(places)], strict=True):
                if (known := index.get(r)) is None:
                    index[r] = [places[a:z]]
                    heapq.heappush(active, r)
                else:
                    known.append(places[a:z])

        add(np.flatnonzero(nxt >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            left, right, merged = self.by_rank[rank]
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            after = nxt[places]
            live = (sym[places] == left) & (after >= 0) & (sym[after] == right)
            places, after = places[live], after[live]
            if left == right and len(places) > 1:  # of overlapping places every second one, from the left
                head = np.r_[True, after[:-1] != places[1:]]
                run = np.arange(len(places)) - np.maximum.accumulate(np.where(head, np.arange(len(places)), 0))
                places, after = places[run % 2 == 0], after[run % 2 == 0]
            if not len(places):
                continue
            beyond = nxt[after]
            sym[places], sym[after] = merged, -1
            nxt[places], nxt[after] = beyond, -1
            prv[beyond[beyond >= 0]] = places[beyond >= 0]
            before = prv[places]
            add(np.unique(np.concatenate([before[before >= 0], places[beyond >= 0]])))
        kept = sym >= 0
        owner = np.repeat(np.arange(len(raw)), size)[kept]
        counts = np.bincount(owner, minlength=len(raw))
        flat, at, out = sym[kept].tolist(), 0, []
        for c in counts.tolist():
            out.append(flat[at : at + c])
            at += c
        return out

    def learn(self) -> None:
        """Encodes and decodes the index's fresh pieces."""
        fresh, self.index.fresh = self.index.fresh, []
        if not fresh:
            return
        ids, digits, part = self.encode_pieces(fresh), self.digits, self.bpe.bytes_of
        self.ids_text += [b",".join([digits[i] for i in x]) for x in ids]
        self.decoded += [b"".join([part[i] for i in x]) for x in ids]
        self.length = np.concatenate([self.length, np.fromiter(map(len, ids), np.int64, len(ids))])

    def codes(self, text: str) -> array:
        """A text as numbers of pieces; special tokens follow after all pieces' numbers, as -1 - id."""
        out = array("q")
        for k, segment in enumerate(self.bpe.segments(text)):
            if k % 2:
                out.append(-1 - self.bpe.special[segment])
            else:
                out.extend(self.index.codes(segment))
        return out

    def joined(self, codes: array) -> tuple[int, bytes, bytes]:
        """Number of ids, their decimals joined by commas, and the bytes that they decode to."""
        if not codes:
            return 0, b"", b""
        if min(codes) >= 0:
            return int(self.length[np.frombuffer(codes, np.int64)].sum()), b",".join(map(self.ids_text.__getitem__, codes)), b"".join(map(self.decoded.__getitem__, codes))
        text = [self.ids_text[c] if c >= 0 else self.digits[-1 - c] for c in codes]
        back = [self.decoded[c] if c >= 0 else self.bpe.bytes_of[-1 - c] for c in codes]
        return sum(int(self.length[c]) if c >= 0 else 1 for c in codes), b",".join(text), b"".join(back)


@lru_cache(2)
def codec(path: str) -> PairIndexBpe:
    return PairIndexBpe(load(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of docs: its id, n_tokens, ids (decimal, comma-joined) and decoded, the text that the ids give back.

    Null and empty texts have no ids and decode to the empty text. Special strings inside a text are their special token.
    """
    return _coded(docs, id_col, text_col, path, [("n_tokens", pa.int64(), "bigint"), ("ids", pa.string(), "string"), ("decoded", pa.string(), "string")], lambda n, ids, back: (n, ids.decode(), back.decode("utf-8", "replace")))


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As encode(), with SHA-256 of ids and decoded text in their stead."""
    return _coded(docs, id_col, text_col, path, [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], lambda n, ids, back: (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest()))


def _coded(docs: DataFrame, id_col: str, text_col: str, path: str | None, fields: list, row) -> DataFrame:
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in sliced(batches):
            codes = [c.codes(t or "") for t in b.column(1).to_pylist()]
            c.learn()
            columns = list(zip(*(row(*c.joined(x)) for x in codes), strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, (_, t, _) in zip(columns, fields, strict=True))], names=[id_col, *(f[0] for f in fields)])
            if c.index.full:
                c.reset()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {s}" for n, _, s in fields))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
