import datetime
import random

import pytest
from pyspark.sql import functions as F
from test_patch_linkage import plan_of

from weftline.functions import columns as C
from weftline.operators import pair_blocks as B
from weftline.operators import pools as P
from weftline.operators import ranking as K
from weftline.operators import training as T
from weftline.operators import windows as W
from weftline.schema import embedded

START = datetime.datetime(2024, 1, 1)
SCHEMA = "n long, created_time timestamp_ntz, title string, description string, files array<string>, vector array<double>"


def odd_rows(n, minutes):
    """Patches many of which are of one time, with lists that are empty, repeat or hold odd paths, and odd vectors."""
    rnd = random.Random(3)
    files = lambda: rnd.choice([[], ["a/b/c", "a/b/c"], [" /a//b ", "x"], ["", "a"], [rnd.choice("abc") + "/" + rnd.choice("xyz") + "/f" for _ in range(rnd.randint(1, 4))]])
    vector = lambda: rnd.choice([[0.0, 0.0, 0.0], [rnd.random() - 0.5 for _ in range(3)], [1.0, 2.0, 3.0]])
    word = lambda: rnd.choice(["Bug", "bug", "the", "BUG-12", "#4821", f"w{rnd.randint(0, 400)}", "É"])
    text = lambda: rnd.choice([None, "", " ".join(word() for _ in range(rnd.randint(0, 30)))])
    return [(k, START + datetime.timedelta(minutes=rnd.choice([0, rnd.randint(0, minutes)])), text(), text(), files(), vector()) for k in range(n)]


@pytest.mark.parametrize("sizes", [(2048, 512, 2048, 1 / 64), (7, 5, 9, 1 / 64), (16, 16, 16, 2.0), (16, 16, 16, 0.0)])
def test_features_of_blocks_equal_features_of_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("LEFT_ROWS", "FEW_LEFT_ROWS", "RIGHT_ROWS", "DENSE"), sizes, strict=True):
        monkeypatch.setattr(B, name, size)
    rows = spark.createDataFrame(odd_rows(80, 600), SCHEMA)
    got = {(r["q"], r["n"]): r for r in B.window_features(rows.where("n % 3 = 0"), rows, 0.1, K.FEATURES).collect()}
    want = {(r["q"], r["n"]): r for r in K.features(W.candidates(rows.where("n % 3 = 0"), rows, 0.1).select("q", "n"), rows).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for pair, r in want.items():
        for f in K.FEATURES:
            assert got[pair][f] == pytest.approx(r[f], abs=1e-12), (pair, f)
    once = B.window_features(rows, rows, 0.1, ("delta_time_hours",), once=True)
    assert {(r["q"], r["n"]) for r in once.collect()} == {(r["q"], r["n"]) for r in W.candidates(rows, rows, 0.1).where("q < n").collect()}


def test_no_pairs(spark):
    rows = spark.createDataFrame(odd_rows(9, 600), SCHEMA)
    assert B.window_features(rows.where("false"), rows, 1, K.FEATURES).count() == 0
    assert B.window_features(rows.where("n = 1"), rows.where("n = 1"), 1, K.FEATURES).count() == 0


def test_pairs_are_not_shuffled_with_texts(spark, sf):
    """Between the task that finds a pair and the ranking there are ids, score and kept features alone."""
    rows = embedded(spark, sf)
    plan = plan_of(K.ml_window(rows.where("n % 50 = 0"), rows, 2, keep=("jaccard",)))
    tree = plan.split("\n\n")[0]
    assert tree.index("Window") < tree.index("FlatMapCoGroupsInArrow") and "Join" not in tree[: tree.index("FlatMapCoGroupsInArrow")]


def test_blend_of_kept_features_equals_blend_of_joined_ones(spark, sf):
    rows = embedded(spark, sf)
    ranked = K.ml_window(rows.where("n % 50 = 0"), rows, 2, keep=("sim_cosine", "jaccard"))
    by = lambda df: sorted((r["q"], r["n"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert by(K.refine(ranked, rows, 10)) == by(K.refine(ranked.drop("sim_cosine", "jaccard"), rows, 10))
    assert {(r["q"], r["n"], r["ml_rank"]) for r in ranked.collect()} == {(r["q"], r["n"], r["ml_rank"]) for r in K.ml_stage(W.candidates(rows.where("n % 50 = 0"), rows, 2).select("q", "n"), rows).collect()}
    assert rows.select(F.max("n")).first()[0] > 50


@pytest.mark.parametrize("sizes", [(512, 2048), (4, 6)])
def test_negatives_of_blocks_equal_negatives_of_pairs(spark, monkeypatch, sizes):
    """Pools that stay whole, larger ones, linked pairs that are left out, and candidates from elsewhere of which some are inside."""
    monkeypatch.setattr(P, "FEW_LEFT_ROWS", sizes[0])
    monkeypatch.setattr(B, "RIGHT_ROWS", sizes[1])
    rows = spark.createDataFrame(odd_rows(90, 3000), SCHEMA)
    asked = rows.where("n % 4 = 0").withColumn("q", F.col("n"))
    linked = spark.createDataFrame([(q, n) for q in range(0, 90, 4) for n in range(90) if (q + n) % 7 == 0], "q long, n long")
    others = spark.createDataFrame([(q, n) for q in range(0, 90, 4) for n in range(90) if (q + n) % 5 == 0], "q long, n long")
    pool = W.candidates(asked, rows, 0.4).select("q", "n").unionByName(others.where("q != n")).distinct().join(linked, ["q", "n"], "left_anti")
    of = lambda side: rows.select(F.col("n").alias(side), F.col("vector").alias(f"v{side}"))
    sims = pool.join(of("q"), "q").join(of("n"), "n").select("q", "n", C.cosine(F.col("vq"), F.col("vn")).alias("sem"))
    kinds = set()
    for most in (20, 60):
        want = sorted(map(tuple, P.negatives(sims, most).collect()))
        kinds |= {k for _, _, k in want}
        assert sorted(map(tuple, P.window_negatives(asked, rows, 0.4, linked, others, most).collect())) == want
    assert kinds == {"all", "hard", "easy"}


def test_negative_pool_shuffles_no_pairs(spark, sf):
    from weftline.plans.ranking_queries import QUERIES

    tree = plan_of(QUERIES["negative_pool"](spark, sf)).split("\n\n")[0]
    assert "Join" in tree and "Exchange" not in tree[: tree.index("Join")]


def test_numbers_with_several_texts_are_linked_by_each(spark, tmp_path):
    from weftline.plans.ranking_queries import QUERIES

    docs = [(50, "a"), (50, "b"), (1, "a"), (2, "b"), (3, "c"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["negative_pool"](spark, str(tmp_path)).collect()} == {(50, 3)}


def test_training_draws_from_windows_as_from_a_table_of_pairs(spark, sf):
    rows = embedded(spark, sf).where("n < 200")
    links = spark.createDataFrame([(str(k), str(k + 7)) for k in range(0, 150, 10)], "source string, target string")
    split = 1.8e15
    some = lambda q: q.select("q").crossJoin(rows.where("n % 9 = 0").select("n"))
    whole = lambda q: some(q).unionByName(W.candidates(q, rows, 3).select("q", "n")).distinct()
    got = [{(r["q"], r["n"], r["label"]) for r in T.labelled_pairs(rows, links, split, pool, days)[1].collect()} for pool, days in ((some, 3), (whole, None))]
    assert got[0] == got[1] and {k for _, _, k in got[0]} == {0, 1}


@pytest.mark.parametrize("sizes", [(2048, 512, 2048), (7, 5, 9)])
def test_best_of_blocks_are_those_of_all_pairs(spark, monkeypatch, sizes):
    """Many equal scores, scores that are null or NaN or differ by less than nine places, and trees that test null features."""
    from weftline.operators.boosting import LambdaMart

    for name, size in zip(("LEFT_ROWS", "FEW_LEFT_ROWS", "RIGHT_ROWS"), sizes, strict=True):
        monkeypatch.setattr(B, name, size)
    rows = [(*r[:4], None if r[0] % 6 == 5 else r[4], [float("nan"), 1.0, 2.0] if r[0] % 10 == 7 else r[5]) for r in odd_rows(120, 200)]
    rows = spark.createDataFrame(rows, SCHEMA)
    few = K.FixedWeights({"same_component": 1.0, "delta_time_hours": -1e-10})
    linear = K.FixedWeights({f: (-1) ** k * (0.1 + 0.037 * k) for k, f in enumerate(K.FEATURES)})
    tree = {1: ("nb_shared", 0.0, 1.0), 2: ("sim_cosine", 0.3, 1.0), 3: 0.25, 4: 0.1, 5: -0.7}
    trees = LambdaMart([tree, {1: ("token_jaccard", 0.02, 1.0), 2: 0.3, 3: ("max_len_files", 2.0, 1.0), 6: 0.11, 7: 0.13}] * 6)
    for ranker in (few, linear, K.Pairwise(linear), trees, LambdaMart([])):
        plain = type("Plain", (), {"needs": ranker.needs, "score": ranker.score})()
        want, got = (sorted(map(repr, K.ml_window(rows.where("n % 3 = 0"), rows, 0.1, r, 4).collect())) for r in (plain, ranker))
        assert got == want and len(got) > 100


def test_pairs_beyond_the_best_of_a_block_are_no_rows(spark):
    rows = spark.createDataFrame(odd_rows(300, 60), SCHEMA)
    found = B.window_best(rows, rows, 1, ("jaccard", "token_jaccard"), K.FixedWeights({"jaccard": 1.0, "token_jaccard": 2.0}).of_arrays, 3)
    assert found.count() < 300 * 3 * 8 < B.window_features(rows, rows, 1, ("jaccard",)).count()


@pytest.mark.parametrize("sizes", [(2048, 512, 2048), (7, 5, 9)])
def test_pairs_of_one_table_are_met_once(spark, monkeypatch, sizes):
    """Features of each pair once, rounded as Spark rounds, with less sent than for two tables."""
    for name, size in zip(("LEFT_ROWS", "FEW_LEFT_ROWS", "RIGHT_ROWS"), sizes, strict=True):
        monkeypatch.setattr(B, name, size)
    rows = spark.createDataFrame([(*r[:4], None if r[0] % 9 == 5 else r[4], r[5]) for r in odd_rows(90, 600)], SCHEMA)
    by = lambda df: sorted(map(repr, df.select("q", "n", *K.FEATURES).collect()))
    whole = B.window_features(rows, rows, 0.1, K.FEATURES, once=True).select("q", "n", *(F.round(f, 6).alias(f) for f in K.FEATURES))
    want = by(whole)
    assert len(want) > 300 and by(B.window_features(rows, None, 0.1, K.FEATURES, places=6)) == want
    turned = B.window_features(rows, rows, 0.1, K.FEATURES, places=6, larger=True).select(F.col("n").alias("q"), F.col("q").alias("n"), *K.FEATURES)
    assert by(turned) == want
    copies = [B.met(B.sides(rows, "q", set()), B.sides(rows, "n", set()), 0.1, 2048, forward=f)[0]._df.count() for f in (False, True)]
    assert copies[1] < 0.8 * copies[0]


def test_rounding_is_that_of_spark(spark):
    rnd = random.Random(2)
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, 1.0000005, 0.1234565, 0.1234575, 1e-9, -1e-9, 1e300, -1e18, float("nan"), float("inf"), 123456.7890125, *(rnd.randint(0, 10**7) / 2e6 * rnd.choice([1, -1]) for _ in range(2000)), *(rnd.randint(0, 300) / rnd.randint(1, 600) for _ in range(3000)), *(rnd.randint(0, 10**6) * 1e-6 + 5e-7 for _ in range(3000))]
    want = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").orderBy("k").select(F.round("v", 6)).collect()]
    import numpy as np

    assert list(map(repr, B.rounded(np.array(values), 6).tolist())) == list(map(repr, want))


def test_blocks_are_not_put_together_into_few_tasks(spark, sf):
    """Blocks read little, whatever they have to compare: their number says how many tasks there are, and they are dealt once."""
    from weftline.plans.ranking_queries import QUERIES

    found = QUERIES["shared_tickets"](spark, sf)
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = plan_of(found).split("\n\n")[0]
    assert "REPARTITION_BY_NUM" in plan_of(found) and "Exchange" not in tree[: tree.index("FlatMapCoGroupsInArrow")]
