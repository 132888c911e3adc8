"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The tokens of a piece's prefix are those of a shorter prefix and one last token. Among the vocabulary's tokens that end
there, one alone forms a stable pair with the last token of the shorter prefix, so a pass from left to right finds the count
at every place. Counts at all prefixes of a whole text follow from its pieces, and are stored: what any budget of tokens
comes to is read from them, without the text and without encoding again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import CONTRACTIONS, ByteBpe, PieceIndex, default_path, load, pieces
from .common import sliced, table, written

#: Bytes of text that are counted at a time: a pass takes all fresh pieces of one length at once, the more the better.
SLICE = 8 << 20
#: In the tree of token bytes, the key of the token that ends at a node.
TOKEN = -1
#: What a piece is: a contraction, white space alone, one that begins with white space.
CONTRACTION, BLANK, BLANK_FIRST = 1, 2, 4


class PrefixCounter:
    """Counts at each prefix, of pieces and of whole texts."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.stable: dict[tuple[int, int], bool] = {}
        self.reset()
        # Tokens that their own bytes don't encode to are never made.
        self._tables()
        self.tree: dict = {}
        for k, v in bpe.id_of.items():
            if len(k) == 1 or self._makes(v):
                at = self.tree
                for b in k:
                    at = at.setdefault(b, {})
                at[TOKEN] = v
        self._flatten()

    def reset(self) -> None:
        """Forgets all pieces: for each by its number what every code point adds, the count of all of it, and what it is; and
        what follows of pieces behind others that they join with."""
        self.index, self.known, self.totals, self.kinds, self.joint = PieceIndex(), [], np.zeros(0, np.int64), np.zeros(0, np.uint8), {}

    def _tables(self) -> None:
        """What the pass over many pieces at once looks up: merges by pair, and how tokens came about."""
        merge, born = self.bpe.merge, self.bpe.born
        self.width = len(self.bpe.bytes_of)
        keys = np.array([a * self.width + b for a, b in merge], np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.array([r for r, _ in merge.values()], np.int64)[order]
        self.rank_of, self.left_of, self.right_of = (np.full(self.width, -1, np.int64) for _ in range(3))
        for token, (rank, left, right) in born.items():
            self.rank_of[token], self.left_of[token], self.right_of[token] = rank, left, right

    def _flatten(self) -> None:
        """The tree as arrays: child[node, byte] and the token that ends at a node, -1 for none."""
        nodes, tokens, todo = [], [], [self.tree]
        inner = {id(self.tree): 0}
        while todo:
            now = todo.pop(0)
            nodes.append(now)
            for b, x in now.items():
                if b != TOKEN and any(k != TOKEN for k in x):
                    inner[id(x)] = len(inner)
                    todo.append(x)
        # Nodes without children come after those that have some, and need no row.
        leaves = len(nodes)
        self.child = np.full((leaves, 256), -1, np.int32)
        tokens = [x.get(TOKEN, -1) for x in nodes]
        for k, now in enumerate(nodes):
            for b, x in now.items():
                if b != TOKEN:
                    at = inner.get(id(x))
                    if at is None:
                        at = len(tokens)
                        tokens.append(x[TOKEN])
                    self.child[k, b] = at
        self.inner, self.token_at = leaves, np.array(tokens, np.int32)

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stays() for many pairs."""
        never = np.int64(1 << 60)
        out, on = np.ones(len(left), bool), np.arange(len(left))
        up_left, up_right = np.full(len(left), never), np.full(len(left), never)
        while len(on):
            at = np.minimum(np.searchsorted(self.pairs, key := left * self.width + right), len(self.pairs) - 1)
            m = np.where(self.pairs[at] == key, self.ranks[at], never)
            bad = (m < up_left) & (m <= up_right) & (m < never)
            out[on[bad]] = False
            a, b = self.rank_of[left], self.rank_of[right]
            go = ~bad & ((a >= 0) | (b >= 0))
            on, left, right, up_left, up_right, a, b = (x[go] for x in (on, left, right, up_left, up_right, a, b))
            first = a > b
            up_left, up_right = np.where(first, a, up_left), np.where(first, up_right, b)
            left, right = np.where(first, self.right_of[left], left), np.where(first, right, self.left_of[right])
        return out

    def _pass(self, raw: list[bytes]) -> np.ndarray:
        """The counts at every prefix of pieces of one length, a row for each."""
        n = len(raw[0])
        data = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), n)
        last, count = np.full((len(raw), n + 1), -1, np.int64), np.zeros((len(raw), n + 1), np.int32)
        for start in range(n):
            on, node = np.arange(len(raw)), np.zeros(len(raw), np.int64)
            for end in range(start, n):
                node = self.child[node, data[on, end]]
                on, node = on[node >= 0], node[node >= 0]
                if not len(on):
                    break
                token = self.token_at[node].astype(np.int64)
                open_ = np.flatnonzero((token >= 0) & (last[on, end + 1] < 0))
                rows, token = on[open_], token[open_]
                if start and len(rows):
                    pair, which = np.unique(last[rows, start] * self.width + token, return_inverse=True)
                    ok = self._stay(pair // self.width, pair % self.width)[which]
                    rows, token = rows[ok], token[ok]
                last[rows, end + 1], count[rows, end + 1] = token, count[rows, start] + 1
                on, node = on[node < self.inner], node[node < self.inner]
        return count

    def learn(self) -> None:
        """Counts the index's fresh pieces at all their prefixes."""
        fresh, self.index.fresh = self.index.fresh, []
        if not fresh:
            return
        raw = [p.encode() for p in fresh]
        by: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by.setdefault(len(b), []).append(k)
        new, total = [b""] * len(fresh), np.zeros(len(fresh), np.int64)
        for n, where in by.items():
            step = max(1, 1_000_000 // n)
            for at in range(0, len(where), step):
                some = where[at : at + step]
                if len(some) * 4 <= n:
                    for k in some:
                        new[k] = self._count(fresh[k])
                        total[k] = sum(array("b", new[k]))
                    continue
                counts = self._pass([raw[k] for k in some])
                total[some] = counts[:, -1]
                # A code point ends where no byte that continues it follows.
                data = np.frombuffer(b"".join([raw[k] for k in some]), np.uint8).reshape(len(some), n)
                ends = np.column_stack([(data[:, 1:] & 0xC0) != 0x80, np.ones(len(some), bool)])
                size = ends.sum(1)
                stop = np.cumsum(size)
                flat = counts[:, 1:][ends]
                before = np.r_[0, flat[:-1]]
                before[stop - size] = 0
                steps = (flat - before).astype(np.int8).tobytes()
                for k, a, z in zip(some, (stop - size).tolist(), stop.tolist(), strict=True):
                    new[k] = steps[a:z]
        self.known += new
        self.totals = np.append(self.totals, total)
        kinds = [CONTRACTION * (p in CONTRACTIONS) | BLANK * p.isspace() | BLANK_FIRST * p[0].isspace() for p in fresh]
        self.kinds = np.append(self.kinds, np.array(kinds, np.uint8))

    def _makes(self, token: int) -> bool:
        born = self.bpe.born.get(token)
        return born is not None and self._stays(born[1], born[2], born[0])

    def _stays(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge of a rank below limit joins bytes of both tokens, when they stand side by side.

        Both are undone step by step, the younger one first; an older pair across the border would have merged before.
        Of two merges of one rank the left one goes first.
        """
        merge, born, up_left, up_right = self.bpe.merge, self.bpe.born, limit, limit
        while True:
            m = merge.get((left, right))
            if m is not None and m[0] < up_left and (m[0] < up_right or m[0] == up_right < limit):
                return False
            a, b = born.get(left), born.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                up_left, left = a[0], a[2]
            else:
                up_right, right = b[0], b[1]

    def _count(self, text: str) -> bytes:
        raw, tree, stable = text.encode(), self.tree, self.stable
        n = len(raw)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            at, before = tree, last[start]
            for end in range(start, n):
                at = at.get(raw[end])
                if at is None:
                    break
                token = at.get(TOKEN)
                if token is None or last[end + 1] >= 0:
                    continue
                if start:
                    pair = before, token
                    ok = stable.get(pair)
                    if ok is None:
                        ok = stable[pair] = self._stays(before, token)
                    if not ok:
                        continue
                last[end + 1], count[end + 1] = token, count[start] + 1
        if len(stable) > 2_000_000:
            stable.clear()
        if n != len(text):  # counts at code points only
            ends, at = [], 0
            for c in text:
                at += len(c.encode())
                ends.append(at)
            count = [0] + [count[e] for e in ends]
        return array("b", map(int.__sub__, count[1:], count)).tobytes()

    def _total(self, text: str) -> int:
        return sum(array("b", self._count(text)))

    def _behind(self, before: str, part: str) -> bytes:
        """What each code point of a part adds where a prefix that ends in it falls into pieces otherwise than the whole text: a
        contraction, white space behind white space, a special string."""
        found = self.joint.get((before, part))
        if found is not None:
            return found
        known = self._total(before) if before else 0
        split = lambda k: sum(map(self._total, pieces(before + part[:k]))) - known
        n = len(part)
        if part in self.bpe.special:
            counts = [split(k) for k in range(1, n)] + [1]
        elif part in CONTRACTIONS:
            counts = [split(k) for k in range(1, n)] + [self._total(part)]
        else:  # white space at the end of a prefix is one piece, and here no more than one character of it is left
            counts = [split(1), *accumulate(array("b", self._count(part)))]
            del counts[1]
        found = array("b", map(int.__sub__, counts, [0, *counts[:-1]])).tobytes()
        if len(self.joint) > 20_000:
            self.joint.clear()
        self.joint[before, part] = found
        return found

    def prefix_deltas(self, texts: list[str]) -> list[bytes]:
        """For each text, and each of its code points, what it adds to the count of the prefix that ends with it, as signed bytes."""
        cut = [[x if k % 2 else pieces(x) for k, x in enumerate(self.bpe.segments(t))] for t in texts]
        codes = [[None if k % 2 else np.fromiter(map(self.index.__getitem__, x), np.int64, len(x)) for k, x in enumerate(parts)] for parts in cut]
        self.learn()
        out = []
        for parts, numbers in zip(cut, codes, strict=True):
            deltas: list[bytes] = []
            owed = 0  # what the count at the last place lacks of that of the pieces so far, in a longer prefix
            for k, (part, code) in enumerate(zip(parts, numbers, strict=True)):
                if k % 2:
                    before = parts[k - 1]
                    deltas.append(_raised(self._behind(before[-1] if before else "", part), owed))
                    owed = 0
                    continue
                kinds = self.kinds[code]
                joins = (kinds & CONTRACTION) > 0
                joins[1:] |= ((kinds[:-1] & BLANK) > 0) & ((kinds[1:] & BLANK_FIRST) > 0)
                own = list(map(self.known.__getitem__, code.tolist()))
                for i in np.flatnonzero(joins).tolist():
                    own[i] = _raised(self._behind(part[i - 1] if i else "", part[i]), owed)
                    owed = int(self.totals[code[i]]) - sum(array("b", own[i])) + owed
                    if owed and i + 1 < len(own) and not joins[i + 1]:
                        own[i + 1], owed = _raised(own[i + 1], owed), 0
                deltas += own
            out.append(b"".join(deltas))
        return out

    def tokens(self, texts: list[str]) -> list[int]:
        """The count of each whole text, from the last prefix of each of its pieces."""
        cut = [self.bpe.segments(t) for t in texts]
        codes = [[self.index.codes(x) for x in parts[::2]] for parts in cut]
        self.learn()
        return [len(parts) // 2 + sum(int(self.totals[np.frombuffer(c, np.int64)].sum()) for c in cs if c) for parts, cs in zip(cut, codes, strict=True)]


def _raised(deltas: bytes, by: int) -> bytes:
    """Deltas of a part, the first of them more by so much."""
    return array("b", [deltas[0] - 256 * (deltas[0] > 127) + by]).tobytes() + deltas[1:] if by else deltas


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(load(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, budget: int = 512, store_prefixes: bool = False) -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_tokens, over_limit (n_tokens > budget).

    store_prefixes adds prefix_deltas: one signed byte for each code point, whose running sum is the exact token count of each
    prefix, so any budget or truncation is answered from it (prefix_counts, cut_at, cuts) without encoding again.
    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each. Other columns are not read.
    """
    path = path or default_path()
    fields = [pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_())]
    fields += [pa.field("prefix_deltas", pa.binary())] * store_prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in sliced(batches, most=SLICE):
            texts = [t or "" for t in b.column(1).to_pylist()]
            size = [len(s.encode()) for s in texts]
            kept = c.prefix_deltas(texts) if store_prefixes else []
            # The last prefix is the text.
            found = [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in kept] if store_prefixes else c.tokens(texts)
            columns = [b.column(0), pa.array(size, pa.int64()), pa.array(found, pa.int64()), pa.array([n > budget for n in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * store_prefixes, schema=pa.schema([pa.field(id_col, b.column(0).type), *fields]))
            if c.index.full:
                c.reset()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean" + ", prefix_deltas binary" * store_prefixes
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, schema)


def prefix_counts(deltas: bytes) -> np.ndarray:
    """The token count of every prefix, the empty one first."""
    return np.append(0, np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64))


def cut_at(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1])


def cuts(stored: DataFrame, budget: int, name: str = "cut_chars") -> DataFrame:
    """Stored counts with, in place of prefix_deltas, the code points of each text's longest prefix of at most budget tokens; all
    of it where that is the whole text. Texts are not read."""
    names = [n for n in stored.columns if n != "prefix_deltas"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(names)):
            found = [cut_at(d, budget) for d in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], names=[*names, name])

    schema = ", ".join(f"`{n}` {stored.schema[n].dataType.simpleString()}" for n in names)
    return stored.select(*names, "prefix_deltas").mapInArrow(cut, f"{schema}, `{name}` bigint")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and where each text has to be cut to fit into 512 tokens, read from the stored counts at its prefixes."""
    return cuts(written(token_counts(table(spark, sf_dir, "documents"), store_prefixes=True), "prefixes"), 512)
