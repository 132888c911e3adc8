import datetime
import random

from weftline.streaming.stages import arriving_pairs

ROWS = "n long, created_time timestamp_ntz"
START = datetime.datetime(2024, 1, 1)


def test_pairs_across_and_within_batches_and_a_state_that_shrinks(spark, tmp_path):
    rnd, batches = random.Random(1), []
    for k in range(4):  # each batch half over the one before, the last one long after
        first = 20 * k + (1000 if k == 3 else 0)
        batches.append([(100 * k + i, START + datetime.timedelta(hours=first + rnd.random() * 40)) for i in range(40)])
        spark.createDataFrame(batches[-1], ROWS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = str(tmp_path / "out")
    run = arriving_pairs(stream, 0.25, "2 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["q"], r["n"]) for r in spark.read.parquet(out).collect())
    rows = [r for b in batches for r in b]
    want = sorted((a, b) for a, at in rows for b, bt in rows if a < b and abs(at - bt) <= datetime.timedelta(hours=6))
    assert got == want
    across = [p for p in got if p[0] // 100 != p[1] // 100]
    assert across and len(across) < len(got)
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in run.recentProgress]
    assert held[-1] < max(held) and sum(s["numRowsRemoved"] for p in run.recentProgress for s in p["stateOperators"]) > 0
