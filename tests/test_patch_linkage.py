import contextlib
import io
import random

from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions import columns as C
from weftline.operators import evaluation as E
from weftline.operators import ranking as K
from weftline.operators import rerank as L
from weftline.operators import retrieval as R
from weftline.operators import windows as W
from weftline.schema import embedded, patches
from weftline.sources import changes as G
from weftline.sources import files as S


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_replies_are_lists_of_strings_or_nothing(spark):
    replies = ['["1","2"]', '```json\n["1"]\n```', '```\n["1"]```', "[]", "prose", '{"a": "b"}', "[1, 2]", "", '[null]', '["1", null]', None]
    assert column(spark, replies, C.parsed_reply) == [["1", "2"], ["1"], ["1"], [], None, None, None, None, None, None, None]


def test_clipping_and_summaries(spark):
    assert column(spark, [None, "  ", " ab ", "abcd ef", "abcdefgh"], lambda c: C.clip(c, 5)) == ["n/a", "n/a", "ab", "abcd [...]", "abcde [...]"]
    assert column(spark, [None, [], ["a"], ["a", "b", "c"]], lambda c: C.files_summary(c, 2), "array<string>") == ["n/a", "n/a", "a", "a, b, ... (+1 more)"]


def test_tickets_and_tokens(spark):
    assert column(spark, ["fix#4821 #4821 BUG-12", "CVE-2020-1234", None], C.ticket_refs) == [["#4821", "BUG-12"], ["CVE-2020"], None]
    assert column(spark, ["Größe_1 ab THE the"], C.tokens) == [["größe_1", "the", "the"]]


def test_lists_as_python_writes_them(spark):
    assert column(spark, ["['a', 'b']", "[]", "{'a': 1}", "garbage", "", None], C.parse_list) == [["a", "b"], [], [], [], [], []]


def test_urls(spark):
    assert column(spark, ["https://x/c/12345", "https://review.opendev.org/c/proj/+/777"], lambda c: C.change_of_url(c)[1]) == [None, "777"]


def test_features_are_symmetric_and_fourteen(spark, sf):
    rows = embedded(spark, sf).where("n < 40")
    pairs = W.candidates(rows, rows, 30).select("q", "n")
    a = {(r["q"], r["n"]): r for r in K.features(pairs, rows).collect()}
    assert len(K.FEATURES) == 14 and a
    for (q, n), r in a.items():
        assert all(abs(r[f] - a[n, q][f]) < 1e-9 for f in K.FEATURES)


def test_path_scores_count_positions(spark):
    df = spark.createDataFrame([("a/b/c", "a/x/c/d")], "x string, y string")
    front = C.path_scores(F.array(C.segments(F.col("x"))), F.array(C.segments(F.col("y"))))
    assert df.select(front.alias("s")).first()["s"] == [0.5]


def test_band_join_is_a_hash_or_merge_join_and_equals_brute_force(spark, sf):
    p = patches(spark, sf)
    near = W.candidates(p, p, 0.25)
    assert "NestedLoop" not in plan_of(near) and "Cartesian" not in plan_of(near)
    times = {r["n"]: r["created_time"] for r in p.select("n", "created_time").collect()}
    want = {(a, b) for a in times for b in times if a != b and abs((times[a] - times[b]).total_seconds()) <= 21600}
    assert {(r["q"], r["n"]) for r in near.select("q", "n").collect()} == want


def test_top_k_limits_before_the_shuffle(spark, sf):
    p = patches(spark, sf)
    assert "WindowGroupLimit" in plan_of(W.top(W.candidates(p, p, 1).withColumn("score", F.col("n") * 1.0), 3))


def test_a_batch_of_queries_equals_one_at_a_time(spark, sf):
    rows = embedded(spark, sf)
    ids = [0, 7, 50]
    many = R.retrieve(rows.where(F.col("n").isin(ids)).withColumn("q", F.col("n")), rows, "hybrid").select("q", "n", "rank")
    one = [r for i in ids for r in R.retrieve(rows.where(F.col("n") == i).withColumn("q", F.col("n")), rows, "hybrid").select("q", "n", "rank").collect()]
    assert sorted(many.collect()) == sorted(one)


def test_unknown_strategies_are_multi_query(spark, sf):
    rows = embedded(spark, sf)
    q = rows.where("n = 3").withColumn("q", F.col("n"))
    assert R.retrieve(q, rows, "nonsense").select("n", "rank").collect() == R.retrieve(q, rows).select("n", "rank").collect()


def test_reordering_is_a_permutation(spark):
    rnd = random.Random(1)
    heads, orders = [], []
    for q in range(20):
        ids = rnd.sample(range(100), 8)
        heads += [(q, n, k + 1) for k, n in enumerate(ids)]
        orders.append((q, [rnd.choice([*ids, 999]) for _ in range(rnd.randint(0, 12))]))
    out = L.reordered(spark.createDataFrame(heads, "q int, n int, rank int"), spark.createDataFrame(orders, "q int, order array<int>"))
    got = {}
    for r in out.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["rank"], r["n"]))
    for q, order in orders:
        ids = [n for x, n, _ in heads if x == q]
        want = list(dict.fromkeys(i for i in order if i in ids))
        assert [n for _, n in got[q]] == want + [i for i in ids if i not in want]
        assert [k for k, _ in got[q]] == list(range(1, 9))


def test_outages_are_not_cached_and_known_orders_cost_nothing(spark):
    asked = spark.createDataFrame([("a", ["1", "2"], "good"), ("b", ["3"], "bad"), ("c", ["4"], "prose")], "q string, ids array<string>, prompt string")

    def client(p):
        if p == "bad":
            raise RuntimeError("down")
        return '["2", "1"]' if p == "good" else "I think 4"

    first = L.rerank(asked, client, "m").collect()
    assert {r["q"]: r["status"] for r in first} == {"a": "ok", "b": "failed", "c": "malformed"}
    known = spark.createDataFrame([(r["key"], r["order"]) for r in first if r["status"] == "ok"], "key string, order array<string>")

    def down(p):
        raise RuntimeError("down")

    again = {r["q"]: (r["status"], r["order"]) for r in L.rerank(asked, down, "m", known).collect()}
    assert again["a"] == ("cached", ["2", "1"]) and again["b"][0] == again["c"][0] == "failed"


def test_prompts_are_bounded_and_strangers_are_refused(spark):
    texts = spark.createDataFrame([(f"p{k}", "t" * 5000, "d" * 200_000, ["f"] * 500) for k in range(11)], "patch_id string, title string, description string, files array<string>")
    rows = spark.createDataFrame([("p0", [f"p{k}" for k in range(1, 11)])], "source_patch_id string, candidates array<string>")
    assert 10_000 < len(L.payloads(rows, texts).first()["prompt"]) < 40_000
    strangers = spark.createDataFrame([("x", ["y", "z"])], "source_patch_id string, candidates array<string>")
    try:
        L.payloads(strangers, texts)
    except ValueError:
        return
    raise AssertionError("texts of other rows were taken")


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "q int, n int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 99), (3, 5)], "q int, n int")
    got = {r["q"]: r for r in E.per_query(ranked, truth, (1, 2)).collect()}
    assert got[1]["reciprocal_rank"] == 0.5 and got[1]["recall_at_1"] == 0 and got[1]["recall_at_2"] == 0.5
    assert got[2]["reciprocal_rank"] == 0 and got[3]["n_returned"] == 0
    total = E.aggregate(E.per_query(ranked, truth, (1, 2)), (1, 2)).first()
    assert total["n_queries"] == 3 and abs(total["mrr"] - 0.5 / 3) < 1e-12
    assert total["mrr"] <= total["hit_rate_at_2"]


def test_missing_features_are_refused(spark, sf):
    rows = embedded(spark, sf).where("n < 5")
    try:
        K.ml_stage(rows.select(F.col("n").alias("q"), "n"), rows, K.FixedWeights({"reviewers": 1.0}))
    except ValueError:
        return
    raise AssertionError


def test_csv_and_json_round_trips(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    df = spark.createDataFrame([("1", 'a "quoted" title', "two\nlines", "2024-01-01 00:00:00", "['a/b.py', 'c.py']"), (None, "x", "y", "2024-01-01 00:00:00", "[]"), ("2", None, None, "2024-01-02 00:00:00", "nothing")], "patch_id string, title string, description string, created_time string, files string")
    S.write_csv(df.selectExpr("*", "'' as author_name", "'' as author_email", "'' as author_username", "'' as change_log", "'' as comments"), path)
    got = {r["patch_id"]: r for r in S.read_patches(spark, path).collect()}
    assert set(got) == {"1", "2"} and got["1"]["title"] == 'a "quoted" title' and got["1"]["description"] == "two\nlines"
    assert got["1"]["files"] == ["a/b.py", "c.py"] and got["2"]["files"] == [] and got["2"]["title"] == ""
    links = tmp_path / "links.json"
    links.write_text('[["1", "2"], {"a": "3", "b": "4"}]')
    assert sorted(map(tuple, S.read_links(spark, str(links)).collect())) == [("1", "2"), ("3", "4")]


def test_tree_of_changes(spark, tmp_path):
    for change, files in {"c1": {"metadata": '{"_number": 5, "change_id": "I5", "subject": "s", "timestamps": {"created": "2024"}}', "patchsets": '{"patchset_number": 1, "modified_file_paths": ["/COMMIT_MSG", "a.py"]}', "linkages": '[{"changeId": "I6"}]'}, "c2": {"metadata": '{"change_id": "I6", "subject": ""}'}, "c3": {"metadata": "broken"}}.items():
        d = tmp_path / "tree" / "proj" / change
        d.mkdir(parents=True)
        for k, v in files.items():
            (d / f"{k}.json").write_text(v)
    tree = G.extracted(G.read_tree(spark, str(tmp_path / "tree")))
    got = {r["patch_id"]: r for r in tree.collect()}
    assert set(got) == {"5", "I6"} and got["5"]["files"] == ["a.py"] and got["5"]["created_time"] == "2024"
    links = G.resolved(G.links_of(tree), tree).collect()
    assert [(r["patch_id"], r["target"], r["reason"]) for r in links] == [("5", "I6", "ok")]


def test_client_errors():
    def fails(_):
        raise OSError

    c = G.Client({"a": "https://host"}, fails)
    assert c.fetch("a", "1") is None
    try:
        c.fetch("b", "1")
    except ValueError:
        return
    raise AssertionError


def test_settings_from_environment():
    s = Settings.from_environment({"WEFTLINE_TOP_K": "9", "WEFTLINE_WINDOW_DAYS": "2.5"})
    assert s.top_k == 9 and s.window_days == 2.5 and s.boost_weight == 0.3


def test_rerank_stream_resumes(spark, tmp_path):
    from weftline.streaming.stages import reranked_stream

    src, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", ["1", "2"], "p"), ("b", ["3"], "p")], "q string, ids array<string>, prompt string")
    rows.write.parquet(src)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(src)
    reranked_stream(stream(), lambda p: '["2", "1"]', "m", cache, str(tmp_path / "s1")).awaitTermination()
    assert spark.read.parquet(cache).count() == 2

    def down(_):
        raise RuntimeError

    reranked_stream(stream(), down, "m", cache, str(tmp_path / "s2")).awaitTermination()
    assert spark.read.parquet(cache).count() == 2


def test_the_rest_works_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tmp_path / "copy"
    shutil.copytree(here, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'strategy_multi_query' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_ranker_learns_before_the_split_and_ranks_windows_after_it(spark, sf, monkeypatch):
    from weftline.config import USUAL
    from weftline.operators import pools as P
    from weftline.plans import ranking_queries as Q
    from weftline.schema import ground_truth

    # The small table has no links of late patches: the last ten are linked in a row.
    last = [r["patch_id"] for r in embedded(spark, sf).orderBy(F.desc("created_time"), "n").select("patch_id").limit(10).collect()]
    late = spark.createDataFrame(list(zip(last[1:], last, strict=False)), "source string, target string")
    links = ground_truth(spark, sf).select("source", "target").unionByName(late)
    monkeypatch.setattr(Q, "ground_truth", lambda spark, sf: links)
    learnt, fit = [], K.Pairwise.fit
    monkeypatch.setattr(K.Pairwise, "fit", lambda rows: learnt.extend(rows.select("q", "n", "label").collect()) or fit(rows))
    got = {}
    for r in Q.trained_ranker(spark, sf).collect():
        got.setdefault(r["q"], []).append(r["n"])
    rows = embedded(spark, sf)
    split = P.split_time(patches(spark, sf)).first()["split_micros"]
    time = {r["n"]: r["t"] for r in rows.select("n", C.micros(F.col("created_time")).alias("t")).collect()}
    anchors = {int(r["anchor"]) for r in P.anchors(P.canonical_pairs(links), rows).collect()}
    window = {q: {n for n, t in time.items() if n != q and abs(t - time[q]) <= USUAL.window_days * W.DAY} for q in anchors}
    assert got and {q: len(n) for q, n in got.items()} == {q: min(10, len(w)) for q, w in window.items() if time[q] >= split and w}
    assert all(set(n) <= window[q] for q, n in got.items())
    assert learnt and all(time[r["q"]] < split for r in learnt) and {r["label"] for r in learnt} == {0, 1}
