"""Retrieval for many queries at once: nearest vectors, keywords, and what is made of both.

Queries have q, title, description, files, created_time and vector; the corpus has n and the same. Window and self are left
out only after the legs have been cut, as the order of these steps decides about results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import USUAL, Settings
from ..functions.columns import jaccard, path_query, payload, tokens
from ..session import kept
from .windows import top, within

#: Queries and rows of the corpus that meet in one task, at most; similarities are made for so many queries at once.
QUERY_BLOCK, CORPUS_BLOCK, STEP = 16_384, 65_536, 256
#: What a row that is found takes, as a share of a vector.
RESULT = 1 / 20
#: Queries and documents whose words meet in one task, at most, and of these queries and postings that are added up at a time.
WORD_QUERIES, WORD_ROWS, QUERIES_STEP, POSTINGS_STEP = 16_384, 16_384, 64, 2_000_000
#: Words that more than this share of a block's documents have are a column of a matrix each, so many at most; others are lists.
COMMON, MOST_COMMON = 1 / 12, 512
#: Scores from here on are not 0 to nine places.
SURE = 1e-8
#: Distinct words of queries that are broadcast, at most; beyond, both sides are shuffled.
MOST_WORDS = 500_000
#: Words that are counted at a time.
WORDS_STEP = 1_000_000


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(q, n, sem, rank): exact cosine top k; zero vectors have similarity 0 with all.

    Queries and corpus are dealt into blocks, and each two blocks meet in one task, which multiplies them and hands on its own
    best k of each query. Vectors stay on the executors; the driver sees two counts.
    """
    n_queries, n_rows, spread = queries.count(), corpus.count(), int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_queries, of_rows = dealt(n_queries, n_rows, k, spread)
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    vector = F.col("vector").cast("array<double>").alias("vector")
    left = queries.select("q", vector, block("q", of_queries).alias("a"), every(of_rows).alias("b"))
    right = corpus.select("n", vector, block("n", of_rows).alias("b")).withColumn("a", every(of_queries))

    return top(meetings(left, right, k), k, "sem")


def dealt(n_queries: int, n_rows: int, k: int, spread: int) -> tuple[int, int]:
    """Into how many blocks queries and rows are dealt: as many meet as there are tasks, and as little as can be is sent. Every block of
    rows is sent all queries and hands on k rows for each, every block of queries is sent all rows."""
    tasks, least = max(1, min(spread, n_rows // 256)), max(1, -(-n_rows // CORPUS_BLOCK))
    of_queries = lambda m: max(1, -(-n_queries // QUERY_BLOCK), min(-(-tasks // m), n_queries // STEP))
    some = [m for m in range(least, max(tasks, least) + 1) if m * of_queries(m) >= tasks or m >= tasks] or [least]
    best = min(some, key=lambda m: m * n_queries * (1 + k * RESULT) + of_queries(m) * n_rows)
    return of_queries(best), best


def meetings(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(q, n, sem): for all left rows (q, vector, a, b) the k best of the right rows (n, vector, a, b) in the same blocks a and b, by
    similarity to nine places, then the smaller row."""

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, n = asked["q"].to_numpy(), rows["n"].to_numpy()
        found = []
        if len(ids) and len(n):
            matrix, others = _matrix(asked), _matrix(rows).T
            take = min(k, len(n))
            for at in range(0, len(ids), STEP):
                sims = np.round(matrix[at : at + STEP] @ others, 12)
                order = _first(np.round(sims, 9), n, take)
                found.append((np.repeat(ids[at : at + STEP], take), n[order].ravel(), np.take_along_axis(sims, order, 1).ravel()))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()), "sem": pa.array(columns[2], pa.float64())})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, "q bigint, n bigint, sem double")


def _first(sims: np.ndarray, n: np.ndarray, take: int) -> np.ndarray:
    """The columns of the best of each row, equal ones by their n. Only what reaches the last place is sorted."""
    rows = range(len(sims))
    if take == sims.shape[1]:
        return np.stack([np.lexsort((n, -sims[r])) for r in rows])
    least = np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take]
    reach = (np.flatnonzero(sims[r] >= least[r]) for r in rows)
    return np.stack([c[np.lexsort((n[c], -sims[r, c]))[:take]] for r, c in zip(rows, reach, strict=True)])


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(rows.num_rows, -1))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def postings(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, tf) of a corpus in which each n is one row. Words are counted where the text lies, so nothing is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:  # rows of so many words at a time, one at least
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_STEP, side="right")))
                part = b.slice(at, upto - at)
                words = part.column(1).flatten().dictionary_encode()
                kinds, row = len(words.dictionary), np.repeat(np.arange(upto - at), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
                found, tf = np.unique(row * kinds + words.indices.to_numpy(), return_counts=True)
                row, word = (found // kinds, found % kinds) if kinds else (found, found)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(word)), part.column(0).take(pa.array(row)), pa.array(tf, pa.int64())], names=["token", "n", "tf"])
                at = upto

    kind = corpus.schema["n"].dataType.simpleString()
    return corpus.select("n", tokens(F.coalesce(text, F.lit(""))).alias("words")).mapInArrow(counted, f"token string, n {kind}, tf bigint")


def keyword_weights(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(q, token, w): what one occurrence in a document adds to its score, occurrences in the query times ln(documents /
    (occurrences in the corpus + 1))."""
    asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("token")).groupBy("q", "token").agg(F.count("*").alias("qtf"))
    common = index.groupBy("token").agg(F.sum("tf").alias("cf"))
    return asked.join(common, "token").select("q", "token", (F.col("qtf") * F.ln(F.lit(float(n_docs)) / (F.col("cf") + 1))).alias("w"))


def keyword_scores(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(q, n, kw): sum over occurrences in query and document of ln(documents / (occurrences in the corpus + 1)), for all documents
    that share a word with the query.

    Frequencies are summed by token before the join, so that a common word is one row of each query and document.
    """
    return keyword_weights(queries, index, n_docs).join(index, "token").groupBy("q", "n").agg(F.sum(F.col("w") * F.col("tf")).alias("kw"))


def keyword_top(queries: DataFrame, index: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(q, n, kw, rank): the k best of keyword_scores() for each query."""
    return top(keyword_meetings(kept(keyword_weights(queries, index, n_docs), "weights"), index, k), k, "kw")


def keyword_meetings(weights: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(q, n, kw): for weights (q, token, w) the k best of each block of the postings (token, n, tf), and so the k best of all.

    Long queries have a word in common with nearly every document, so pairs are not written out: words become numbers, and blocks
    of queries meet blocks of documents in tasks, which hand on their own best k of each query. The work grows with the postings of
    the queries' own words.
    """
    spread = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_queries, n_rows = weights.select("q").distinct().count(), index.select("n").distinct().count()
    of_queries = -(-n_queries // WORD_QUERIES) or 1
    # Every block of documents is sent all queries, so there are no more blocks than keep that within twice the documents' own rows.
    of_rows = max(1, -(-n_rows // WORD_ROWS), min(spread, n_rows // 64, 2 * n_rows * of_queries // max(n_queries, 1)))
    words = kept(weights.select("token").distinct().withColumn("id", F.monotonically_increasing_id()), "words")
    few = F.broadcast(words) if words.count() <= MOST_WORDS else words
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = weights.join(few, "token").select("q", "id", "w", block("q", of_queries).alias("a"), every(of_rows).alias("b"))
    numbers = few.select("token", F.col("id").alias("word"))
    right = index.join(numbers, "token").select("n", "word", F.col("tf").cast("double").alias("tf"), block("n", of_rows).alias("b")).withColumn("a", every(of_queries))

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = list(_word_scores(*(asked[c].to_numpy() for c in ("q", "id", "w")), *(rows[c].to_numpy() for c in ("n", "word", "tf")), k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()), "kw": pa.array(columns[2], pa.float64())})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, "q bigint, n bigint, kw double")


def _word_scores(q: np.ndarray, q_word: np.ndarray, w: np.ndarray, n: np.ndarray, n_word: np.ndarray, tf: np.ndarray, k: int):
    """(q, n, kw) arrays of the k best of each query among documents that share a word with it.

    Documents are listed by word, so a query touches the lists of its own words only; words that many documents have are columns of a
    matrix, which some queries at a time are multiplied with.
    """
    known = np.unique(q_word)
    if not len(known):
        return
    word = np.minimum(np.searchsorted(known, n_word), len(known) - 1)
    asked = known[word] == n_word
    word, n, tf = word[asked], n[asked], tf[asked]
    if not len(n):
        return
    order = np.argsort(word, kind="stable")
    rows, row = np.unique(n[order], return_inverse=True)
    starts, tf = np.searchsorted(word[order], np.arange(len(known) + 1)), tf[order]
    sizes = np.diff(starts)
    common = np.flatnonzero(sizes > COMMON * len(rows))
    common = common[np.argsort(-sizes[common], kind="stable")[:MOST_COMMON]]
    column = np.full(len(known), -1)
    column[common] = np.arange(len(common))
    matrix = np.zeros((len(common), len(rows)))
    for j, c in enumerate(common):
        of = slice(starts[c], starts[c + 1])
        matrix[j] = np.bincount(row[of], tf[of], len(rows))

    def listed(words: np.ndarray):
        """The places of these words' postings, and how many each word has, so many postings at a time, those of one word at least."""
        ends, at = np.cumsum(sizes[words]), 0
        while at < len(words):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + POSTINGS_STEP, side="right")))
            size = sizes[words[at:upto]]
            yield np.repeat(starts[words[at:upto]] - (ends[at:upto] - size - done), size) + np.arange(ends[upto - 1] - done), slice(at, upto), size
            at = upto

    order = np.argsort(q, kind="stable")
    queries, first = np.unique(q[order], return_index=True)
    bounds, q_word, w = np.append(first, len(q)), np.searchsorted(known, q_word[order]), w[order]
    for i in range(0, len(queries), QUERIES_STEP):
        j = min(i + QUERIES_STEP, len(queries))
        some = slice(bounds[i], bounds[j])
        at, place = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1])), column[q_word[some]]
        weights = np.zeros((j - i, len(common)))
        weights[at[place >= 0], place[place >= 0]] = w[some][place >= 0]
        sums = weights @ matrix
        for scores, query, begin, end in zip(sums, queries[i:j], bounds[i:j], bounds[i + 1 : j + 1], strict=True):
            words, own = q_word[begin:end], w[begin:end]
            rare = column[words] < 0
            for of, part, size in listed(words[rare]):
                scores += np.bincount(row[of], np.repeat(own[rare][part], size) * tf[of], len(rows))
            found = np.flatnonzero(scores > SURE)
            if len(found) < k:  # scores of nothing and less count too, but only where a word is shared
                shared = np.zeros(len(rows), bool)
                for of, _, _ in listed(words):
                    shared[row[of]] = True
                found = np.flatnonzero(shared)
            if len(found) > k:
                found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - SURE]
            best = found[np.lexsort((rows[found], -np.round(scores[found], 9)))[:k]]
            yield np.full(len(best), query), rows[best], scores[best]


def hybrid(queries: DataFrame, corpus: DataFrame, index: DataFrame, n_docs: int, top_k: int, days: float, s: Settings = USUAL, near: DataFrame | None = None) -> DataFrame:
    """(q, n, sem, kw, score, rank): the union of both legs, cut to retrieval_factor * top_k each; then window and self."""
    cut = s.retrieval_factor * top_k
    near = nearest(queries, corpus, cut) if near is None else near.where(F.col("rank") <= cut)
    words = keyword_top(queries, index, n_docs, cut)
    # A query's highest score by words is looked for in the union, which has all of them, so that words are searched once.
    both = near.select("q", "n", "sem").join(words.select("q", "n", "kw"), ["q", "n"], "full_outer").withColumn("most", F.max("kw").over(Window.partitionBy("q")))
    scored = both.select("q", "n", F.coalesce("sem", F.lit(0.0)).alias("sem"), F.coalesce("kw", F.lit(0.0)).alias("kw"), (s.semantic_weight * F.coalesce("sem", F.lit(0.0)) + s.keyword_weight * F.coalesce(F.try_divide(F.coalesce("kw", F.lit(0.0)), "most"), F.lit(0.0))).alias("score"))
    times = queries.select("q", F.col("created_time").alias("q_time"))
    placed = scored.join(times, "q").join(corpus.select("n", "created_time", "files"), "n")
    return top(placed.where(within(F.col("q_time"), F.col("created_time"), days) & (F.col("q") != F.col("n"))).drop("q_time", "created_time"), top_k)


def semantic(queries: DataFrame, corpus: DataFrame, top_k: int, days: float, s: Settings = USUAL) -> DataFrame:
    """(q, n, sem, files_shared, score, rank): the first top_k of the nearest 3 * top_k that are in the window, then scored with
    file overlap, which reorders them but pulls no others in."""
    near = nearest(queries, corpus, s.semantic_fan_out * top_k)
    placed = near.drop("rank").join(queries.select("q", F.col("created_time").alias("q_time"), F.col("files").alias("q_files")), "q").join(corpus.select("n", "created_time", "files"), "n")
    kept = top(placed.where(within(F.col("q_time"), F.col("created_time"), days) & (F.col("q") != F.col("n"))), top_k, "sem", rank="near")
    shared = jaccard(F.col("q_files"), F.col("files"))
    scored = kept.select("q", "n", "sem", shared.alias("files_shared"), (s.semantic_weight * F.col("sem") + s.file_weight * shared).alias("score"))
    return top(scored, top_k)


def with_files(found: DataFrame, queries: DataFrame, top_k: int, weight: float, of_score: float) -> DataFrame:
    """of_score * score + weight * file overlap, cut to top_k; keeps original_score and file_overlap."""
    placed = found.drop("rank").join(queries.select("q", F.col("files").alias("q_files")), "q")
    shared = jaccard(F.col("q_files"), F.col("files"))
    scored = placed.withColumns({"original_score": F.col("score"), "file_overlap": shared}).withColumn("score", of_score * F.col("original_score") + weight * F.col("file_overlap"))
    return top(scored.drop("q_files"), top_k)


def retrieve(queries: DataFrame, corpus: DataFrame, strategy: str = "multi_query", top_k: int = USUAL.top_k, days: float = USUAL.window_days, s: Settings = USUAL) -> DataFrame:
    """The top_k of each query by a strategy: semantic, hybrid, file_boost, or multi_query, which any other name stands for."""
    if strategy == "semantic":
        return semantic(queries, corpus, top_k, days, s)
    text = payload(F.col("title"), F.col("description"))
    index, n_docs = kept(postings(corpus.withColumn("text", text)), "postings"), corpus.count()
    asked = queries.withColumn("text", text)
    if strategy == "hybrid":
        return with_files(hybrid(asked, corpus, index, n_docs, top_k * s.hybrid_fan_out, days, s), queries, top_k, s.file_weight, s.semantic_weight)
    if strategy == "file_boost":
        return with_files(hybrid(asked, corpus, index, n_docs, top_k * s.boost_fan_out, days, s), queries, top_k, s.boost_weight, 1 - s.boost_weight)
    # One search by vector serves all query texts of a patch: a vector that is looked up doesn't depend on them.
    near = kept(nearest(queries, corpus, s.retrieval_factor * 2 * top_k), "near")
    legs = [
        (asked, 2 * top_k),
        (queries.withColumn("text", F.col("title")).where("title != ''"), top_k),
        (queries.withColumn("text", path_query(F.col("files"))).where("text != ''"), top_k),
    ]
    merged = reduce(DataFrame.unionByName, [hybrid(t, corpus, index, n_docs, k, days, s, near.join(t.select("q"), "q", "left_semi")) for t, k in legs])
    merged = merged.groupBy("q", "n").agg(F.max("score").alias("score"), F.count("*").alias("query_count"))
    boosted = merged.withColumn("score", F.col("score") * (1 + s.count_boost * F.col("query_count"))).join(corpus.select("n", "files"), "n").withColumn("rank", F.lit(0))
    return with_files(boosted, queries, top_k, s.merged_file_weight, s.merged_weight)
