"""A trained encoder: latent semantic vectors, by a randomised range finder over TF-IDF.

The matrix of documents by words is never held. A pass over the documents multiplies it and its transpose with a thin matrix of words:
each task adds its documents' parts up, and the parts meet by blocks of words. A few passes from a random start give a basis of the
strongest directions, a last one their order and strength.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import USUAL
from ..functions.columns import payload, tokens

#: Words that a model has at most, those that most patches have: its size is so many times the width. Words of one patch tell nothing.
MOST_WORDS, LEAST_PATCHES = 50_000, 2
#: Directions more than wanted that passes carry along, and words to a block.
MORE, BLOCK = 10, 512


def _weighed(found: np.ndarray, n_words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of one text's words, of length 1."""
    x = (1 + np.log(n_words)) * idf[found]
    return x / (np.linalg.norm(x) or 1.0)


class Latent:
    """Vectors of a width from the words of title and description. Texts without a known word are the zero vector."""

    def __init__(self, words: list[str], idf: np.ndarray, basis: np.ndarray, strength: np.ndarray):
        self.words, self.idf, self.basis, self.strength = words, idf, basis, strength
        self.name = f"latent-{basis.shape[1]}"
        self.at = {w: k for k, w in enumerate(words)}

    @classmethod
    def fit(cls, patches: DataFrame, width: int = 64, passes: int = 3, seed: int = USUAL.seed) -> Latent:
        """Learns from all patches (title, description); null texts are empty. With fewer words than the width vectors have zeros at
        their ends."""
        text = patches.select(tokens(payload(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))).alias("words"))
        total = text.count()
        seen = text.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PATCHES)
        found = seen.orderBy(F.desc("n"), "w").limit(MOST_WORDS).collect()
        words = [r["w"] for r in found]
        idf = np.log((1 + total) / (1 + np.array([r["n"] for r in found], np.float64))) + 1
        out = cls(words, idf, np.zeros((len(words), width)), np.zeros(width))
        wide = min(width + MORE, len(words))
        if not wide:
            return out
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(words), wide)))[0]
        for _ in range(passes):
            basis = np.linalg.qr(out._multiplied(text, basis))[0]
        values, turn = np.linalg.eigh(basis.T @ out._multiplied(text, basis))
        first = np.argsort(-values)[: min(width, wide)]
        out.basis[:, : len(first)] = basis @ turn[:, first]
        out.strength[: len(first)] = np.sqrt(np.maximum(values[first], 0))
        return out

    def _sparse(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A text's known words by number, and their weights."""
        known, counts = np.unique(np.array([k for w in words if (k := self.at.get(w)) is not None], np.int64), return_counts=True)
        return known, _weighed(known, counts, self.idf)

    def _multiplied(self, text: DataFrame, thin: np.ndarray) -> np.ndarray:
        """The transposed matrix times the matrix times a thin one; words times width numbers reach the driver."""
        n, wide = thin.shape

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, any_row = np.zeros((n, wide)), False
            for b in batches:
                for words in b.column(0).to_pylist():
                    at, x = self._sparse(words)
                    if len(at):
                        sums[at] += np.outer(x, x @ thin[at])
                        any_row = True
            if any_row:
                for k in range(0, n, BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k : k + BLOCK].tobytes()], pa.binary())], names=["block", "part"])

        def met(parts: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p) for p in parts["part"].to_pylist())
            return pa.table({"block": pa.array([parts["block"][0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((n, wide))
        for r in text.mapInArrow(added, "block int, part binary").groupBy("block").applyInArrow(met, "block int, part binary").collect():
            out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["part"]).reshape(-1, wide)
        return out

    def encode(self, patches: DataFrame) -> DataFrame:
        """(patch_id, vector), of length 1; each row for itself, without a shuffle."""
        source = patches.select("patch_id", tokens(payload(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))).alias("words"))

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = np.zeros((b.num_rows, self.basis.shape[1]))
                for k, words in enumerate(b.column(1).to_pylist()):
                    at, x = self._sparse(words)
                    if len(at):
                        rows[k] = x @ self.basis[at]
                norms = np.linalg.norm(rows, axis=1, keepdims=True)
                rows /= np.where(norms == 0, 1, norms)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), vectors], names=["patch_id", "vector"])

        return source.mapInArrow(made, "patch_id string, vector array<double>")
