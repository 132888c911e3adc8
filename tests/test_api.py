import pytest
from weftline.api import Engine
from weftline.schema import embedded
from weftline.sources.changes import Client

REPLY = ')]}\'\n{"subject": "the of and", "created": "2024-01-10 00:00:00.000", "revisions": {"a": {"_number": 1, "commit": {"message": "that with this for"}, "files": {"mod1/sub1/f1.py": {}}}}}'


def test_predictions_and_errors(spark, sf):
    e = Engine({"docs": embedded(spark, sf)}, Client({"docs": "https://host"}, lambda url: REPLY if "/777777/" in url else "nothing"))
    assert e.projects() == ["docs"]
    got = e.predict(" Docs ", " 50 ", top_k="3")
    assert got.count() <= 3 and got.where("patch_id = '50'").count() == 0
    assert e.predict("docs", "777777").count() > 0
    for bad in (("nope", "1"), ("docs", "  ")):
        with pytest.raises(ValueError):
            e.predict(*bad)
    with pytest.raises(LookupError):
        e.predict("docs", "888888")
    with pytest.raises(ValueError):
        e.predict("docs", "1", top_k="many")


def test_command_line(capsys):
    from weftline.__main__ import main

    assert main(["list"]) == 0
    assert "strategy_multi_query" in capsys.readouterr().out


def test_facade_ranks_compares_and_pools(spark, sf):
    from pyspark.sql import functions as F

    rows = embedded(spark, sf)
    e = Engine({"docs": rows})
    queries = rows.where("n % 50 = 0").withColumn("q", F.col("n"))
    ranked = e.rank_ml_to_rag("docs", queries, top_k=3)
    assert ranked.groupBy("q").count().where("count > 3").count() == 0 and ranked.count() > 0
    pool = e.candidate_pool("docs", queries)
    assert pool.groupBy("q", "n").count().where("count > 1").count() == 0
    same = e.compare(ranked, ranked).collect()
    assert same and all(r["both"] > 0 and r["model_only"] == r["retrieval_only"] == 0 for r in same)
    hand_off = spark.createDataFrame([("0", ["1", "2", "nope"])], "source_patch_id string, candidates array<string>")
    texts = e.hydrate("docs", hand_off)
    assert {r["patch_id"] for r in texts.collect()} <= {"0", "1", "2"}
    done = e.rerank(hand_off, texts, lambda prompt: '["2", "1"]', "m").first()
    assert done["status"] == "ok" and done["order"] == ["2", "1"] and done["seconds"] >= 0


def test_etl_command(tmp_path, spark):
    import json

    from weftline.__main__ import main

    for k, links in ((1, [{"changeNumber": 2}]), (2, []), (3, None)):
        d = tmp_path / "tree" / "x" / str(k)
        d.mkdir(parents=True)
        (d / "metadata.json").write_text(json.dumps({"_number": k, "subject": f"s{k}", "timestamps": {"created": "2024-01-01"}}))
        if links is not None:
            (d / "linkages.json").write_text(json.dumps(links))
    assert main(["etl", str(tmp_path / "tree"), str(tmp_path / "out")]) == 0
    from weftline.sources import files

    assert [tuple(r) for r in files.read_links(spark, str(tmp_path / "out/links")).collect()] == [("1", "2")]
    stats = spark.read.json(str(tmp_path / "out/counters")).first()
    assert (stats["patches"], stats["with_file"], stats["with_no_links"], stats["ok"], stats["via_number"]) == (3, 2, 1, 1, 1)
    with pytest.raises(FileNotFoundError):
        files.read_texts(spark, str(tmp_path / "nothing"))


def test_train_rank_compare_and_evaluate_commands(tmp_path, spark, sf, capsys):
    from pyspark.sql import functions as F

    from weftline.__main__ import main
    from weftline.schema import ground_truth
    from weftline.sources.store import read_trees

    model, ranked = str(tmp_path / "model"), str(tmp_path / "ranked")
    assert main(["train", sf, model]) == 0
    assert read_trees(spark, model).about["window_days"] == 14
    assert main(["rank", sf, ranked, "--model", model]) == 0
    assert main(["compare", ranked, ranked]) == 0
    assert "both" in capsys.readouterr().out
    ground_truth(spark, sf).select(F.col("source").cast("long").alias("q"), F.col("target").cast("long").alias("n")).write.parquet(str(tmp_path / "truth"))
    assert main(["evaluate", ranked, str(tmp_path / "truth"), str(tmp_path / "metrics")]) == 0
    found = spark.read.json(str(tmp_path / "metrics")).first()
    assert found["n_queries"] > 0 and 0 <= found["mrr"] <= 1


def test_full_chain_of_the_facade(spark, sf):
    from pyspark.sql import functions as F

    rows = embedded(spark, sf)
    e = Engine({"docs": rows})
    queries = rows.where("n % 100 = 0").withColumn("q", F.col("n"))
    before = {(r["q"], r["n"]): r["rank"] for r in e.rank_ml_to_rag("docs", queries, top_k=12).collect()}
    down = e.rank_full("docs", queries, lambda prompt: 1 / 0, "m", top_k=12).collect()
    assert {(r["q"], r["n"]): r["rank"] for r in down} == before and {r["status"] for r in down} == {"failed"}
    last = e.rank_full("docs", queries, lambda prompt: '["' + prompt.rsplit("id: ", 1)[1].split("\n")[0] + '"]', "m", top_k=12).collect()
    assert {r["old_rank"] for r in last if r["rank"] == 1} == {10} and {(r["q"], r["n"]): r["old_rank"] for r in last} == before
