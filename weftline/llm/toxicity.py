"""Toxicity by non-negative positive-unlabelled learning.

Labelled documents confirmed as toxic are the positive class; other labelled documents, sampled without a look at their labels,
are the unlabelled text. A linear classifier in numpy minimises prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]), the
risk of a fully labelled set as far as positives, unlabelled text and the class prior tell it, never below zero in its negative
part. Its features are all words and word beginnings, hashed; their weights are held at zero or above by projection at each step, and
those of features that too few positives bear out by a penalty on their sum, most of which is lifted once they are gone. Last, the
bias is set where the risk of wrong verdicts, estimated in the same non-negative way, is least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: Bounds of the sample of labelled rows that the classifier is fitted on: confirmed toxic ones, and ones whose label isn't looked at.
MOST_POSITIVES, MOST_UNLABELLED = 4000, 6000
#: Features are hashed into so many numbers.
FEATURES = 1 << 18
#: How many positives' worth of risk a unit of weight has to save.
PENALTY = 3.0
FOLDS = 5
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Distinct words whose features a worker keeps.
CACHE = 50_000


def held_out(id_col: Column) -> Column:
    """Whether a row belongs to the fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0, F.lit(False))


def word_features(raw: str) -> tuple[int, ...]:
    """A word without signs at its ends, and its beginnings, which words of one stem share; hashed."""
    w = _EDGES.sub("", raw)
    return () if not w else tuple(crc32(x.encode()) % FEATURES for x in (w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) >= n)))


def text_features(text: str | None) -> np.ndarray:
    """The distinct features of a text, in order."""
    return np.unique(np.fromiter((f for raw in text_words(text) for f in word_features(raw)), np.uint32))


def text_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Classifier:
    """Weights by feature; a document's features count once each."""

    weights: dict[int, float]
    bias: float

    def scorer(self):
        weights, bias, known = self.weights, self.bias, {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for raw in text_words(text):
                hit = known.get(raw)
                if hit is None:
                    if len(known) > CACHE:
                        known.clear()
                    hit = known[raw] = tuple(f for f in word_features(raw) if f in weights)
                found.update(hit)
            z = bias + sum(map(weights.__getitem__, sorted(found)))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


class Risk:
    """The non-negative risk of a linear classifier over documents given as arrays of distinct features, and its gradient."""

    def __init__(self, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, names: np.ndarray):
        self.prior, self.n, self.features = prior, (len(positives), len(unlabelled)), len(names)
        self.p, self.u = self._sparse(positives, names), self._sparse(unlabelled, names)

    @staticmethod
    def _sparse(docs: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, found = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
        at = np.searchsorted(names, found)
        has = names[np.minimum(at, len(names) - 1)] == found
        return rows[has], at[has]

    def curvature(self) -> np.ndarray:
        """For each feature, and the bias, the most that the risk's slope changes by a unit."""
        share = [np.bincount(cols, minlength=self.features) / n for (_, cols), n in zip((self.p, self.u), self.n, strict=True)]
        return np.append(0.25 * (self.prior * share[0] + share[1]) + 1e-12, 0.25)

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        (pr, pc), (ur, uc), (n_p, n_u) = self.p, self.u, self.n
        zp, zu = np.bincount(pr, w[pc], n_p) + w[-1], np.bincount(ur, w[uc], n_u) + w[-1]
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        negative = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
        by_p, by_u = -self.prior * sigmoid(zp) / n_p, sigmoid(zu) / n_u
        # The risk of the negatives can't be below zero: where it is, the step goes back from what has been overfitted.
        by_p, by_u = (-by_p, -by_u) if negative < 0 else (by_p - self.prior * sigmoid(-zp) / n_p, by_u)
        slope = np.bincount(pc, by_p[pr], self.features) + np.bincount(uc, by_u[ur], self.features)
        return self.prior * np.logaddexp(0, -zp).mean() + max(0.0, negative), np.append(slope, by_p.sum() + by_u.sum())

    def verdicts(self, w: np.ndarray) -> float:
        """The score from which on calling documents positive has the least non-negative risk of wrong verdicts: the middle of the
        widest gap between scores where it is least."""
        (pr, pc), (ur, uc), (n_p, n_u) = self.p, self.u, self.n
        zp, zu = np.sort(np.bincount(pr, w[pc], n_p) + w[-1]), np.sort(np.bincount(ur, w[uc], n_u) + w[-1])
        z = np.unique(np.concatenate([zp, zu]))
        if len(z) < 2:
            return 0.0
        at = (z[1:] + z[:-1]) / 2
        caught, called = 1 - np.searchsorted(zp, at) / n_p, 1 - np.searchsorted(zu, at) / n_u
        risk = self.prior * (1 - caught) + np.maximum(0, called - self.prior * caught)
        return float(at[np.lexsort((-np.diff(z), np.round(risk, 9)))[0]])

    def minimised(self, w: np.ndarray, penalty: float, steps: int = 150, rate: float = 0.1) -> np.ndarray:
        """The best of a number of projected steps: weights are never below zero, the bias is free."""
        scale, best, least = self.curvature(), w, np.inf
        for _ in range(steps):
            risk, slope = self(w)
            if risk + penalty * w[:-1].sum() < least:
                best, least = w, risk + penalty * w[:-1].sum()
            step = rate * np.clip((slope + np.append(np.full(self.features, penalty), 0)) / scale, -2, 2)
            w = np.append(np.maximum(0, (w - step)[:-1]), (w - step)[-1])
        return best


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, penalty: float = PENALTY) -> Classifier:
    """Fits weights to documents given as arrays of distinct features, in order. Where nothing tells positives from the rest, every
    score is next to 0."""
    positives = _unlike(positives)
    if not positives or not unlabelled:
        return Classifier({}, -12.0)
    found, counts = np.unique(np.concatenate(positives), return_counts=True)
    # A feature of no more positives than the penalty asks for can't leave zero: what it saves is at most its share of them.
    names = found[counts > penalty]
    if not len(names):
        return Classifier({}, -12.0)
    first = np.append(np.zeros(len(names)), np.log(prior / (1 - prior)))
    sparse = Risk(positives, unlabelled, prior, names).minimised(first, penalty * prior / len(positives))
    left = sparse[:-1] > 0
    if not left.any():
        return Classifier({}, -12.0)
    over = Risk(positives, unlabelled, prior, names[left])
    w = over.minimised(np.append(sparse[:-1][left], sparse[-1]), 0.3 * penalty * prior / len(positives), rate=0.03)
    w[-1] -= over.verdicts(w)
    return Classifier({int(f): float(x) for f, x in zip(names[left], w, strict=False)}, float(w[-1]))


def _unlike(docs: list[np.ndarray], hashes: int = 32) -> list[np.ndarray]:
    """One document of each group of copies and near copies, which would lend its rare words the weight of many: those whose
    minimum hashes agree with those of an earlier one by half or more."""
    r = np.random.default_rng(5)
    by = r.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    signs, kept = np.zeros((len(docs), hashes), np.uint64), []
    for d in docs:
        sign = np.array([(d.astype(np.uint64) * a >> np.uint64(20)).min() for a in by]) if len(d) else np.zeros(hashes, np.uint64)
        if not kept or (signs[: len(kept)] == sign).sum(1).max() < hashes // 2:
            signs[len(kept)] = sign
            kept.append(d)
    return kept


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED) -> Classifier:
    """Learns from labels outside the held-out fold: two samples of labelled rows by hashes of their ids, of bounded sizes, one
    of the confirmed toxic ones, one of all of them without a look at the label. The prior is the share of toxic ones among all.
    Labels that are null, or whose id is null or not among the docs, don't count. Of an id's several labels each counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out(F.col("id")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    if not positive:
        return fit([], [], 0.5)
    some = known.where("label = 1").select("id").distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(most_positives)
    others = known.select("id").distinct().orderBy(F.xxhash64("id", F.lit(2)), "id").limit(most_unlabelled)

    def sample(ids: DataFrame) -> list[np.ndarray]:
        # ids are bounded by the sizes above.
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi").mapInArrow(_features_of, "features binary")
        return [np.frombuffer(f, np.uint32) for f in sorted(bytes(r["features"]) for r in rows.toLocalIterator())]

    return fit(sample(some), sample(others), min(0.9, max(0.001, positive / n)))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        yield pa.RecordBatch.from_arrays([pa.array([text_features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["features"])


def scored(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score, 0 to 1, in a last column, in place of one that has its name. Null and empty texts have no features: their
    score is the bias alone. Rows, repeated ones too, stay as they are."""
    docs = docs.drop(score_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in sliced(batches, at):
            found = pa.array([score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{score_col}` double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
