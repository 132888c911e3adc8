import glob
import os

from pyspark.sql import functions as F

from weftline.operators import windows as W


def test_pairs_are_written_as_short_runs(spark, tmp_path):
    """A bucket of very many rows: its pairs take far less room than their numbers do."""
    rows = spark.range(200_000).select("id", F.col("id").alias("n"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 60 as int))").alias("created_time"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for sides that are too large for it
    try:
        W.candidates(rows.where("n % 10000 = 0"), rows, 14).select("q", "n").write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 20 * 199_999
    size = sum(map(os.path.getsize, glob.glob(f"{tmp_path}/pairs/*.parquet")))
    assert size < 2 * 20 * 199_999


def test_pairs_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(W, "RUN_ROWS", 7)
    rows = spark.range(300).select(F.col("id").alias("n"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7919 % 43200 as int))").alias("created_time"))
    for days in (0.25, 2, 14):
        got = W.candidates(rows.where("n % 50 = 0"), rows, days).select("q", "n").collect()
        want = {(q, n) for q in range(0, 300, 50) for n in range(300) if q != n and abs(q * 7919 % 43200 - n * 7919 % 43200) <= days * 1440}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def written(df, folder):
    """Rows, and bytes of their files for each."""
    df.write.parquet(folder)
    n = df.sparkSession.read.parquet(folder).count()
    return n, sum(map(os.path.getsize, glob.glob(f"{folder}/*.parquet"))) / n


def test_pairs_of_runs_take_less_than_half_a_byte(spark, tmp_path):
    rows = spark.range(30_000).select(F.col("id").alias("n"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7919 % 60 as int))").alias("created_time"))
    n, each = written(W.candidates(rows.where("n % 150 = 0"), rows, 14), f"{tmp_path}/pairs")
    assert n == 200 * 29_999 and each < 0.4


def test_pairs_of_larger_numbers_and_of_nothing_in_common(spark, monkeypatch):
    for name, most in (("RUN_ROWS", 5), ("RIGHT_ROWS", 20), ("LEFT_ROWS", 30), ("TASK_PAIRS", 500)):
        monkeypatch.setattr(W, name, most)
    minute = lambda n: n * 7919 % 43200 if n % 3 else 600
    tags = lambda n: [n % 11] if n % 4 else [n % 11, n % 7 + 20]
    made = spark.range(200).select(F.col("id").alias("n"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(if(id % 3 > 0, id * 7919 % 43200, 600) as int))").alias("created_time"), F.expr("if(id % 4 > 0, array(id % 11), array(id % 11, id % 7 + 20))").alias("tags"))
    for days in (0.3, 5):
        near = {(q, n): abs(minute(q) - minute(n)) for q in range(200) for n in range(200) if q != n and abs(minute(q) - minute(n)) <= days * 1440}
        got = W.candidates(made, made, days, larger=True, gaps=True).collect()
        assert len(got) == len(near) // 2 and {(r["q"], r["n"]): r["apart_micros"] for r in got} == {k: v * 60_000_000 for k, v in near.items() if k[0] < k[1]}
        got = W.candidates(made.where("n % 2 = 0"), made, days, apart="tags").collect()
        want = {k for k in near if k[0] % 2 == 0 and not set(tags(k[0])) & set(tags(k[1]))}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_negatives_and_gaps_are_written_as_runs(spark, tmp_path):
    from test_patch_linkage import plan_of
    from weftline.plans.ranking_queries import QUERIES

    docs = spark.range(0, 43_200 * 8, 8).where("id * 7919 % 43200 < 3600").select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5000).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    n, each = written(QUERIES["negative_pool"](spark, str(tmp_path)), f"{tmp_path}/negatives")
    assert n > 100_000 and each < 0.6
    gaps = QUERIES["delta_time_hours"](spark, str(tmp_path))
    assert "InArrow" not in plan_of(gaps)
