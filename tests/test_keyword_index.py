import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import keyword_index
from weftline.operators import retrieval as R
from weftline.operators.keyword_index import KeywordIndex
from weftline.operators.windows import top
from weftline.schema import patches


def texts(n, seed, words=300):
    """Zipf-like words, so that some come up in most texts, and some texts are long."""
    rnd, vocabulary = random.Random(seed), [f"word{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return ["the the " + " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([0, 3, 20, 60, 400]))) for _ in range(n)]


def rows_of(spark, all_texts, first=0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(all_texts)], "n long, text string")


def plain(asked, rows, k):
    return shown(top(R.keyword_scores(asked, R.postings(rows), rows.count()), k, "kw"))


def shown(found):
    return sorted((r["q"], r["rank"], r["n"], round(r["kw"], 6)) for r in found.collect())


@pytest.mark.parametrize("dense", [0.5, 2.0])
@pytest.mark.parametrize("k", [1, 25, 1000])
def test_search_equals_all_scores(spark, monkeypatch, tmp_path, k, dense):
    monkeypatch.setattr(keyword_index, "DENSE", dense)
    monkeypatch.setattr(R, "WORD_QUERIES", 7)
    monkeypatch.setattr(R, "WORD_ROWS", 90)
    monkeypatch.setattr(R, "QUERIES_STEP", 3)
    monkeypatch.setattr(R, "POSTINGS_STEP", 100)
    rows = rows_of(spark, texts(300, 1))
    index = KeywordIndex.build(rows, str(tmp_path / "i"))
    asked = rows.where("n % 20 = 0").withColumn("q", F.col("n")).unionByName(spark.createDataFrame([(-1, "the", -1), (-2, "word299 nowhere", -2), (-3, None, -3), (-4, "the word0", -4)], "n long, text string, q long"))
    assert shown(index.search(asked, k)) == plain(asked, rows, k)


def test_fewer_postings_are_read_than_there_are(spark, tmp_path):
    rows = rows_of(spark, texts(1200, 2, 5000))
    index = KeywordIndex.build(rows, str(tmp_path / "i"))
    asked = spark.createDataFrame([(q, f"word{300 + 7 * q} word{2 + q} the word{1000 + 3 * q}") for q in range(30)], "q long, text string")
    terms = index._terms(asked)
    read = index._read(terms, index._reached(terms, index.postings(), 5))
    of = {r["essential"]: r["n"] for r in read.groupBy("essential").agg(F.sum("size").alias("n")).collect()}
    assert of[True] < 0.4 * (of[True] + of[False])
    lists = asked.select("q", F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("token")).join(R.postings(rows), "token").count()
    assert of[True] + of[False] == lists
    assert shown(index.search(asked, 5)) == plain(asked, rows, 5)


def test_index_equals_a_rebuild_after_changes(spark, tmp_path):
    before, after = texts(200, 3), texts(200, 4)
    rows = rows_of(spark, before)
    index = KeywordIndex.build(rows.where("n < 150"), str(tmp_path / "i"))
    index.add(rows.where("n >= 150"))
    index.remove(rows.where("n % 7 = 0").select("n"))
    changed = rows_of(spark, after).where("n % 7 = 3")
    KeywordIndex(spark, str(tmp_path / "i")).change(changed)
    index.add(rows_of(spark, after).where("n = 14"))
    now = rows.where("n % 7 not in (0, 3)").unionByName(changed).unionByName(rows_of(spark, after).where("n = 14"))
    asked = now.where("n % 10 = 4").withColumn("q", F.col("n"))
    made = KeywordIndex.build(now, str(tmp_path / "new"))
    for same in (index, index.compacted(str(tmp_path / "c"))):
        assert same.n_docs == now.count()
        assert sorted(map(tuple, same.postings().collect())) == sorted(map(tuple, made.postings().collect()))
        assert sorted(map(tuple, same.counts().drop("most").collect())) == sorted(map(tuple, made.counts().drop("most").collect()))
        assert shown(same.search(asked, 10)) == plain(asked, now, 10)


def test_words_are_counted_in_place(spark):
    rows = spark.createDataFrame([(1, "b a b ccc ccc Bbb bbb bbb ccc aaa"), (2, None), (3, ""), (4, "x y"), (5, "zzz"), (6, "the " * 30_000)], "n long, text string")
    assert sorted(map(tuple, R.postings(rows).collect())) == [("aaa", 1, 1), ("bbb", 1, 3), ("ccc", 1, 3), ("the", 6, 30_000), ("zzz", 5, 1)]


def test_scores_of_exactly_nothing_are_no_match(spark):
    """Two words in half of the texts have weight 0: texts that have them are found, others are not."""
    rows = spark.createDataFrame([(k, "half" if k % 2 else "other") for k in range(9)] + [(9, "none")], "n long, text string")
    asked = spark.createDataFrame([(1, "half other half")], "q long, text string")
    index = R.postings(rows.where("n < 9"))
    for n_docs in (5, 6, 10):
        assert shown(R.keyword_top(asked, index, n_docs, 20)) == shown(top(R.keyword_scores(asked, index, n_docs), 20, "kw"))


def test_empty_index(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "none"))
    assert index.n_docs == 0 and index.search(rows_of(spark, ["a word0"]).withColumn("q", F.col("n")), 3).count() == 0


def test_patches_of_the_given_tables(spark, sf, tmp_path):
    rows = patches(spark, sf).select("n", F.concat_ws(" ", "title", "description").alias("text"))
    index = KeywordIndex.build(rows, str(tmp_path / "i"))
    asked = rows.where("n % 50 = 0").withColumn("q", F.col("n"))
    assert shown(index.search(asked, 25)) == plain(asked, rows, 25)


def test_a_query_costs_the_postings_of_its_own_words():
    """Two thousand queries of a rare word each take hardly longer than twenty: no query goes through all postings of a block."""
    rnd = np.random.default_rng(7)
    n, word = np.repeat(np.arange(8000), 40), rnd.integers(0, 20_000, 320_000)
    _, once = np.unique(n * 20_000 + word, return_index=True)
    n, word, tf = n[once], word[once], rnd.integers(1, 4, len(once)).astype(float)
    took = {}
    for queries in (20, 2000):
        q = np.arange(queries)
        began = time.process_time()
        found = list(R._word_scores(q, q * 10, np.ones(queries), n, word, tf, 5))
        took[queries] = time.process_time() - began
        for asked, rows, kw in found[:20]:
            mine = sorted(zip(-tf[word == asked[0] * 10], n[word == asked[0] * 10], strict=True))[:5]
            assert [(-s, r) for s, r in mine] == list(zip(kw, rows, strict=True))
    assert took[2000] < 15 * took[20] + 0.5


@pytest.mark.parametrize("common", [0.0, 0.05, 1.0])
def test_scores_by_lists_and_by_matrix_are_the_same(monkeypatch, common):
    monkeypatch.setattr(R, "COMMON", common)
    rnd = np.random.default_rng(8)
    n, word = np.divmod(np.unique(rnd.integers(0, 300, 9000) * 100 + (rnd.pareto(1, 9000) * 4).astype(int) % 100), 100)
    tf, q = rnd.integers(1, 5, len(n)).astype(float), np.repeat(np.arange(90), 30)
    q, q_word = np.divmod(np.unique(q * 120 + rnd.integers(0, 120, len(q))), 120)
    w = np.round(rnd.normal(size=len(q)), 1)
    got = [(a, b, round(c, 9)) for x in R._word_scores(q, q_word, w, n, word, tf, 40) for a, b, c in zip(*x, strict=True)]
    scores = {}
    for a, t, x in zip(q, q_word, w, strict=True):
        for b, y in zip(n[word == t], tf[word == t], strict=True):
            scores[a, b] = scores.get((a, b), 0.0) + x * y
    want = [(a, b, round(s, 9)) for a in range(90) for s, b in [(-s, b) for s, b in sorted((-round(s, 9), b) for (x, b), s in scores.items() if x == a)[:40]]]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and all(abs(x[2] - y[2]) < 1e-8 for x, y in zip(got, want, strict=True))


def test_words_are_runs_of_three_or_more(spark):
    odd = ["", "ab abc", "a_b ÀÉî_ñ x1y", "１２３ 12 123", "日本 日本語", "😀😀😀 a😀b", "été né", "İstanbul ΣΑΣ", "foo-bar.baz  q", None]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    plain = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2)
    assert all(r[0] == r[1] for r in rows.select(plain, R.tokens(F.col("text"))).collect())
