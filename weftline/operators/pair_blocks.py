"""Features of all pairs of a window, made where two blocks of patches meet.

A pair is no row until its features are there: blocks of one time and of one share of the patches are sent to a task, which compares
them as matrices and hands on ids and features. What is shuffled is patches, a few copies of each, and no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros, payload, ticket_refs, token_set
from .windows import DAY

#: Buckets of time to a window, and rows of either side that meet in one task, at most; of the left side fewer for many features.
BUCKETS, LEFT_ROWS, FEW_LEFT_ROWS, RIGHT_ROWS = 2, 4_096, 512, 2_048
#: Blocks of a task, about.
TASK_BLOCKS = 8
#: A word is counted by a matrix product where it would make more than such a share of all pairs; else its pairs are listed.
DENSE = 1 / 64
#: Pairs that are listed at a time, words in one matrix, paths that are compared at a time, and rows of one batch of results.
LISTED, COLUMNS, PATHS, BATCH = 4_000_000, 2_048, 256, 250_000
#: What each feature is made of.
NEEDS = {
    "jaccard": "files", "nb_shared": "files", "abs_delta_files": "files", "min_len_files": "files", "max_len_files": "files", "same_component": "files",
    "lcp_mean": "files", "lcp_max": "files", "lcsuff_mean": "files", "lcsuff_max": "files", "sim_cosine": "vector", "token_jaccard": "words", "delta_time_hours": "at", "shares_ticket_ref": "tickets",
}


def met(left: DataFrame, right: DataFrame, days: float, left_rows: int, forward: bool = False):
    """left (q, at) and right (n, at), grouped alike for a cogroup: each two rows that are at most so many days apart are in one group
    of both, once. Groups are bounded on both sides however many patches are of one time; at is in microseconds. With forward only
    two rows of which the right one isn't in an earlier bucket of time; the left one's bucket is own."""
    width = max(1, int(days * DAY) // BUCKETS)
    reach = -(-int(days * DAY) // width)
    own = F.floor(F.col("at") / F.lit(width))
    left, right = left.withColumn("bucket", F.explode(F.sequence(own if forward else own - reach, own + reach))), right.withColumn("bucket", own)
    left = left.withColumn("own", own) if forward else left
    count = lambda df, name, most: df.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    sizes = count(left, "of_a", left_rows).join(count(right, "of_b", RIGHT_ROWS), "bucket")
    share = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = left.join(sizes, "bucket").withColumn("a", share("q", "of_a")).withColumn("b", every("of_b")).drop("of_a", "of_b")
    right = right.join(sizes, "bucket").withColumn("b", share("n", "of_b")).withColumn("a", every("of_a")).drop("of_a", "of_b")
    # As many tasks as blocks ask for: what they read is small, so they would be put together by its size.
    blocks = sizes.agg(F.sum(F.col("of_a").cast("long") * F.col("of_b"))).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // TASK_BLOCKS)
    left, right = (df.repartition(tasks, "bucket", "a", "b") for df in (left, right))
    return left.groupBy("bucket", "a", "b"), right.groupBy("bucket", "a", "b")


def sides(rows: DataFrame, key: str, needs: set[str]) -> DataFrame:
    """What blocks need of patches: key, at, and of files, words (as 64-bit hashes), tickets and vector those that are asked for."""
    text = payload(F.col("title"), F.col("description"))
    made = {"files": F.col("files"), "words": F.transform(token_set(text), lambda w: F.xxhash64(w)), "tickets": ticket_refs(text)}
    made["vector"] = F.col("vector").cast("array<double>") if "vector" in rows.columns else F.array().cast("array<double>")
    return rows.select(F.col("n").alias(key), micros(F.col("created_time")).alias("at"), *(made[c].alias(c) for c in sorted(needs - {"at"})))


def window_features(queries: DataFrame, rows: DataFrame | None, days: float, names: tuple[str, ...], once: bool = False, places: int | None = None, larger: bool = False) -> DataFrame:
    """(q, n, features): for each query all other rows at most so many days apart, with features of these names; with once only rows
    of a larger number, with larger only rows of a smaller one than the query's. Both have n, created_time, title, description, files and maybe vector. Features are rounded to so many places,
    if they are given, as round() of Spark does.

    Without rows all pairs of the queries are meant, each once: features are the same with both exchanged, so a patch is sent only to
    buckets of time that don't lie before its own.
    """
    both = rows is None
    needs = {NEEDS[f] for f in names}
    pairs = met(sides(queries, "q", needs), sides(queries if both else rows, "n", needs), days, LEFT_ROWS if len(names) <= 4 else FEW_LEFT_ROWS, forward=both)
    span, names = int(days * DAY), tuple(names)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("q"), b.sort_by("n")  # so that the larger numbers of a run are its end
        q, n = a["q"].to_numpy(), b["n"].to_numpy()
        apart = np.abs(a["at"].to_numpy()[:, None] - b["at"].to_numpy()[None, :])
        near, less = apart <= span, q[:, None] < n[None, :]
        x, y = np.nonzero(near & (less if once or both else q[:, None] > n[None, :] if larger else q[:, None] != n[None, :]))
        ends = (q[x], n[y])
        if both:  # of another bucket also the smaller numbers, which are queries then
            k, j = np.nonzero((near & (q[:, None] > n[None, :]) & (a["own"].to_numpy() != b["bucket"][0].as_py())[:, None]).T if len(b) else np.zeros((0, 0)))
            x, y, ends = np.r_[x, j], np.r_[y, k], (np.r_[ends[0], n[k]], np.r_[ends[1], q[j]])
        columns = {c: pa.array(v, pa.int64()) for c, v in zip(("q", "n"), ends, strict=True)}
        if len(x):
            cut = (lambda v: v[x, y]) if places is None else (lambda v: rounded(v[x, y], places))
            columns |= {f: pa.array(cut(v), pa.float64(), mask=None if gone is None else gone[x, y]) for f, v, gone in _made(a, b, apart, names)}
        else:
            columns |= {f: pa.array([], pa.float64()) for f in names}
        out = pa.table({c: columns[c] for c in ("q", "n", *names)})
        return pa.Table.from_batches(out.to_batches(BATCH), out.schema)

    return pairs[0].cogroup(pairs[1]).applyInArrow(meet, "q bigint, n bigint, " + ", ".join(f"{f} double" for f in names))


def rounded(values: np.ndarray, places: int) -> np.ndarray:
    """Values to so many places as Spark rounds them: half ones up, away from 0, as their shortest decimal says."""
    scale = 10.0**places
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.abs(values) * scale
        out = np.sign(values) * np.floor(size + 0.5) / scale + 0.0
        close = np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-3)
        far = np.flatnonzero(~(size < 2.0**52))  # NaN, infinities and numbers without such places
    unlike, which = np.unique(values[close], return_inverse=True)
    exact = [float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in unlike]
    out[close] = np.array(exact, np.float64)[which] + 0.0
    out[far] = values[far]
    return out


#: Scores that differ by less may be alike to nine places.
SLACK = 2e-9


def window_best(queries: DataFrame, rows: DataFrame, days: float, names: tuple[str, ...], score: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(q, n, ml_score): of the pairs of window_features() those that can be among the k best of a query. Score makes scores,
    and where they are null, of features by name and of where these are null, which are NaN then; "" is a feature of zeros.

    A block hands on its own k best of each query, and what may be equal to the last one to nine places; of equal scores the k smallest
    numbers. So what becomes rows grows with queries and blocks, not with pairs.
    """
    pairs = met(sides(queries, "q", {NEEDS[f] for f in names}), sides(rows, "n", {NEEDS[f] for f in names}), days, LEFT_ROWS if len(names) <= 4 else FEW_LEFT_ROWS)
    span, names = int(days * DAY), tuple(names)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q, n = a["q"].to_numpy(), b["n"].to_numpy()
        apart = np.abs(a["at"].to_numpy()[:, None] - b["at"].to_numpy()[None, :])
        inside = (apart <= span) & (q[:, None] != n[None, :])
        x, y = np.nonzero(inside)
        take, found, null = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        if len(x):
            values, nulls = {"": np.zeros(len(x))}, {}
            for f, v, gone in _made(a, b, apart, names):
                values[f] = v[inside]
                if gone is not None:
                    nulls[f] = gone[inside]
                    values[f][nulls[f]] = np.nan
            found, null = score(values, nulls)
            ends = np.searchsorted(x, np.arange(len(q) + 1))
            order = np.where(null, -np.inf, np.where(np.isnan(found), np.inf, found))  # as Spark sorts them
            take = np.concatenate([i + best_of(order[i:j], n[y[i:j]], k) for i, j in zip(ends, ends[1:], strict=False)])
        return pa.table({"q": pa.array(q[x[take]], pa.int64()), "n": pa.array(n[y[take]], pa.int64()), "ml_score": pa.array(found[take], pa.float64(), mask=null[take])})

    return pairs[0].cogroup(pairs[1]).applyInArrow(meet, "q bigint, n bigint, ml_score double")


def best_of(scores: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The places of scores that may be among the k largest to nine places; of equal ones those of the k smallest n."""
    if len(scores) <= k:
        return np.arange(len(scores))
    reach = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - SLACK)
    reach = reach[np.lexsort((n[reach], -scores[reach]))]
    place, begins = np.arange(len(reach)), np.r_[True, scores[reach][1:] != scores[reach][:-1]]
    return reach[place - np.maximum.accumulate(np.where(begins, place, 0)) < k]


def _made(a: pa.Table, b: pa.Table, apart: np.ndarray, names: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
    """Features as matrices of all rows of a and b, and where they are null."""
    asked = set(names)
    if "delta_time_hours" in asked:
        yield "delta_time_hours", apart / 3_600_000_000, None
    if "sim_cosine" in asked:
        yield "sim_cosine", cosines(a["vector"], b["vector"]), None
    if "token_jaccard" in asked:
        yield "token_jaccard", _jaccard(*_coded(a["words"], b["words"])[:2]), None
    if "shares_ticket_ref" in asked:
        yield "shares_ticket_ref", (shared(*_coded(a["tickets"], b["tickets"])[:2]) > 0).astype(float), None
    if asked & {f for f, of in NEEDS.items() if of == "files"}:
        yield from _of_files(a, b, asked)


def _of_files(a: pa.Table, b: pa.Table, asked: set[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
    x, y, kinds = _coded(a["files"], b["files"])
    sets = [_Lists.of(*_distinct(s), s.n) for s in (x, y)]
    none = [np.asarray(t["files"].is_null()) for t in (a, b)]
    either = (none[0][:, None] | none[1][None, :]) if none[0].any() or none[1].any() else None
    both = None if either is None else none[0][:, None] & none[1][None, :]
    if "jaccard" in asked:
        yield "jaccard", _jaccard(*sets), None
    if "nb_shared" in asked:
        yield "nb_shared", shared(*sets).astype(float), either
    size = [s.sizes.astype(float) for s in (x, y)]
    if "abs_delta_files" in asked:
        yield "abs_delta_files", np.abs(size[0][:, None] - size[1][None, :]), either
    for name, less in (("min_len_files", np.fmin), ("max_len_files", np.fmax)):
        if name in asked:
            l, r = (np.where(z, np.nan, s) for z, s in zip(none, size, strict=True))
            yield name, less(l[:, None], r[None, :]), both
    # One number for each segment; paths are cut once for each distinct path.
    words: dict[str, int] = {}
    cut = [[words.setdefault(s, len(words)) for s in (p or "").strip(" ").split("/") if s] for p in kinds]
    if "same_component" in asked:
        top = np.array([c[0] if c else -1 for c in cut], np.int64)
        tops = [_Lists.of(*_distinct(_Lists.of(s.rows[top[s.codes] >= 0], top[s.codes][top[s.codes] >= 0], s.n)), s.n) for s in (x, y)]
        yield "same_component", (shared(*tops) > 0).astype(float), None
    for mean, most, turned in (("lcp_mean", "lcp_max", False), ("lcsuff_mean", "lcsuff_max", True)):
        if asked & {mean, most}:
            m, h = _agreements(x, y, [c[::-1] for c in cut] if turned else cut)
            yield from ((f, v, None) for f, v in ((mean, m), (most, h)) if f in asked)


class _Lists:
    """Lists of numbers: the row and the number of each element, rows in order."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, n: int):
        self.rows, self.codes, self.n, self.sizes = rows, codes, n, np.bincount(rows, minlength=n)

    @classmethod
    def of(cls, rows: np.ndarray, codes: np.ndarray, n: int) -> _Lists:
        return cls(rows, codes, n)


def _coded(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[_Lists, _Lists, list]:
    """Two columns of lists with a number for each value, and the values by number."""
    whole = [c.combine_chunks() for c in (a, b)]
    lengths = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in whole]
    values = pa.concat_arrays([c.flatten() for c in whole]).dictionary_encode("encode")
    codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = int(lengths[0].sum())
    rows = [np.repeat(np.arange(len(k)), k) for k in lengths]
    return _Lists(rows[0], codes[:at], len(lengths[0])), _Lists(rows[1], codes[at:], len(lengths[1])), values.dictionary.to_pylist() if not pa.types.is_integer(values.dictionary.type) else []


def _distinct(x: _Lists) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers without repeats in a row."""
    kinds = int(x.codes.max()) + 1 if len(x.codes) else 1
    once = np.unique(x.rows * kinds + x.codes)
    return once // kinds, once % kinds


def shared(x: _Lists, y: _Lists) -> np.ndarray:
    """How many numbers each row of x has in common with each row of y; none comes twice in a row."""
    kinds = int(max(x.codes.max(initial=-1), y.codes.max(initial=-1))) + 1
    here, there = np.bincount(x.codes, minlength=kinds), np.bincount(y.codes, minlength=kinds)
    pairs = here * there
    out = np.zeros((x.n, y.n), np.float32)
    dense = np.flatnonzero(pairs > max(DENSE * x.n * y.n, 1))
    place = np.full(kinds, -1)
    place[dense] = np.arange(len(dense))
    for at in range(0, len(dense), COLUMNS):
        size = min(COLUMNS, len(dense) - at)
        parts = []
        for s in (x, y):
            m = np.zeros((s.n, size), np.float32)
            p = place[s.codes] - at
            some = (p >= 0) & (p < size)
            m[s.rows[some], p[some]] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    rare = (pairs > 0) & (place < 0)
    left = np.flatnonzero(rare[x.codes])
    right = np.flatnonzero(rare[y.codes])
    right = right[np.argsort(y.codes[right], kind="stable")]
    rows = y.rows[right]
    begins = np.searchsorted(y.codes[right], np.arange(kinds))
    times = there[x.codes[left]]
    ends = np.cumsum(times)
    at = 0
    while at < len(left):  # elements that make so many pairs at a time, one at least
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LISTED, side="right")))
        t = times[at:upto]
        step = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        other = rows[np.repeat(begins[x.codes[left[at:upto]]], t) + step]
        out += np.bincount(np.repeat(x.rows[left[at:upto]], t) * y.n + other, minlength=x.n * y.n).reshape(out.shape)
        at = upto
    return out


def _jaccard(x: _Lists, y: _Lists) -> np.ndarray:
    both = shared(x, y).astype(float)
    either = x.sizes[:, None] + y.sizes[None, :] - both
    return np.divide(both, either, out=np.zeros_like(both), where=either > 0)


def _agreements(x: _Lists, y: _Lists, cut: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and most of the shares of positions at which paths agree, over all pairs of paths of two rows; 0 for rows without.
    Rows with the same list are compared once."""
    ours, (x, own), (y, other) = max(map(len, cut), default=0), _once(x), _once(y)
    size = np.array([len(c) for c in cut], np.int64)
    total, most = np.zeros((x.n, y.n)), np.zeros((x.n, y.n))
    if len(x.codes) and len(y.codes):
        table = np.full((len(cut), ours), -1, np.int32)
        for k, c in enumerate(cut):
            table[k, : len(c)] = c
        filled = np.flatnonzero(y.sizes)
        begins = (np.cumsum(y.sizes) - y.sizes)[filled]
        theirs = np.where(table[y.codes] < 0, -2, table[y.codes])
        for at in range(0, len(x.codes), PATHS):
            codes, rows = x.codes[at : at + PATHS], x.rows[at : at + PATHS]
            same = np.zeros((len(codes), len(y.codes)), np.int16)
            for i in range(ours):
                same += table[codes, i][:, None] == theirs[:, i][None, :]
            score = same / np.maximum(np.maximum(size[codes][:, None], size[y.codes][None, :]), 1)
            sums, tops = np.add.reduceat(score, begins, axis=1), np.maximum.reduceat(score, begins, axis=1)
            cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            where = np.ix_(rows[cuts], filled)
            total[where] += np.add.reduceat(sums, cuts, axis=0)
            most[where] = np.maximum(most[where], np.maximum.reduceat(tops, cuts, axis=0))
    pairs = x.sizes[:, None] * y.sizes[None, :]
    mean = np.divide(total, pairs, out=np.zeros_like(total), where=pairs > 0)
    return mean[np.ix_(own, other)], most[np.ix_(own, other)]


def _once(x: _Lists) -> tuple[_Lists, np.ndarray]:
    """The distinct lists, and for each row the place of its list."""
    places: dict[bytes, int] = {}
    ends = np.cumsum(x.sizes)
    lists = [x.codes[e - s : e] for e, s in zip(ends, x.sizes, strict=True)]
    own = np.array([places.setdefault(c.tobytes(), len(places)) for c in lists], np.int64)
    firsts = [np.frombuffer(c, np.int64) for c in places]
    codes = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return _Lists(np.repeat(np.arange(len(firsts)), [len(c) for c in firsts]).astype(np.int64), codes, len(firsts)), own


def cosines(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Cosine similarities; 0 for vectors that are null, zero, have a null in them or are of another length."""
    (x, of_x), (y, of_y) = _matrix(a), _matrix(b)
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    fits = (of_x[:, None] == of_y[None, :]) & (norms != 0)
    return np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=fits)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, short ones filled up with zeros, and their lengths; those with a null are zero."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        out[rows[np.asarray(flat.is_null())]] = 0
    return out, sizes
