import time

import pytest
from pyspark.sql import functions as F

from weftline.functions.formats import duration, latency, progress
from weftline.operators import evaluation as E
from weftline.operators.statistics import kth, quantile
from weftline.streaming.progress import Progress, observed


def test_formats(spark):
    times = spark.createDataFrame([(0.0,), (59.9,), (61.0,), (3723.0,), (400_000.0,), (-5.0,), (None,), (0.25,), (9.9994,), (10.0,), (12.39,)], "s double")
    got = [(r["d"], r["l"]) for r in times.select(duration(F.col("s")).alias("d"), latency(F.col("s")).alias("l")).collect()]
    assert [d for d, _ in got[:7]] == ["0:00", "0:59", "1:01", "1:02:03", "111:06:40", "0:00", None]
    assert [x for _, x in got[7:]] == ["250ms", "9999ms", "10.0s", "12.3s"]
    schema = "done long, total long, mrr double, elapsed double, calls long, failed long, cached long, seconds double"
    runs = spark.createDataFrame([(5, 10, 0.5, 10.0, 4, 1, 1, 1.0), (0, None, None, 0.0, 0, 0, 0, 0.0), (7, 0, 0.66667, 3.5, None, None, None, None), (9999, 10_000, 1.0, 1.0, 1, 0, 0, 12.0)], schema)
    assert [r[0] for r in runs.select(progress(*map(F.col, runs.columns))).collect()] == [
        "5/10, 50.0%, mrr 0.5000, per second 0.50, left 0:10, answered 3, cached 1, failed 1, mean call 250ms",
        "0/0, 100.0%, mrr -, per second -, left -, answered 0, cached 0, failed 0, mean call -",
        "7/7, 100.0%, mrr 0.6666, per second 2.00, left 0:00, answered 0, cached 0, failed 0, mean call -",
        "9999/10000, 99.9%, mrr 1.0000, per second 9999.00, left 0:00, answered 1, cached 0, failed 0, mean call 12.0s",
    ]


def test_running_mrr_of_a_stream(spark, tmp_path):
    for k in range(3):
        status = F.when(F.col("id") % 4 == 0, "cached").when(F.col("id") % 4 == 1, "failed").otherwise("asked")
        spark.range(4 * k, 4 * k + 4).select((1 / (F.col("id") + 1)).alias("reciprocal_rank"), status.alias("status"), F.lit(0.5).alias("seconds")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("reciprocal_rank double, status string, seconds double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    lines: list = []
    listener = Progress(12, lines.append)
    spark.streams.addListener(listener)
    try:
        observed(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while len(lines) < 3 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.n == 12 and len(lines) == 3 and lines[-1].startswith("12/12, 100.0%, ") and lines[-1].endswith(", answered 6, cached 3, failed 3, mean call 500ms")
    assert listener.mrr == pytest.approx(sum(1 / k for k in range(1, 13)) / 12)


def test_order_statistics(spark, monkeypatch):
    from weftline.operators import statistics as S

    monkeypatch.setattr(S, "FEW", 50)
    monkeypatch.setattr(S, "ACCURACY", 100)
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).unionByName(spark.createDataFrame([(None,), (3,), (3,)], "v long"))
    values = sorted([*range(5000), 3, 3])
    assert [kth(rows, "v", k) for k in (0, 3, 4, 2500, 5001, 5002)] == [0, 3, 3, values[2500], 4999, None]
    assert quantile(rows, "v", 0.5) == (values[2500] + values[2501]) / 2
    assert quantile(rows.where("false"), "v", 0.5) is None


def test_alignment_is_checked(spark):
    a, b = spark.range(3), spark.range(2)
    assert E.aligned(a, a.withColumn("x", F.lit(1)), "id").count() == 3
    with pytest.raises(ValueError):
        E.aligned(a, b, "id")
