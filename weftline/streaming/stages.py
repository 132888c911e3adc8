"""Streams: new patches against known ones, and reranking that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import micros, order_key
from ..operators.rerank import rerank
from ..operators.windows import DAY, bucketed


def arriving(stream: DataFrame, known: DataFrame, days: float) -> DataFrame:
    """(q, n): for each patch of a stream the known patches in its window. Stateless: a join of stream and table on buckets of
    time, as band_join() makes it, so no state grows with the stream."""
    new = bucketed(stream.select(F.col("n").alias("q"), F.col("created_time").alias("q_time")), "q_time", days, around=True)
    old = bucketed(known.select("n", F.col("created_time").alias("n_time")), "n_time", days)
    near = F.abs(micros(F.col("q_time")) - micros(F.col("n_time"))) <= int(days * DAY)
    return new.join(old, "bucket").where(near & (F.col("q") != F.col("n"))).select("q", "n")


def arriving_pairs(stream: Callable[[], DataFrame], days: float, late: str = "2 days") -> DataFrame:
    """(q, n), q the smaller: patches of a stream that are at most so many days apart, whichever batches they come in. stream makes the
    stream, which is read twice.

    A join of the stream with itself on buckets of time, each as wide as the window. A patch is kept in the state until the watermark
    says that none in its window can come any more, so the state holds what came within the window and the allowed delay. What
    comes later than that is left out.
    """
    width = max(1, int(days * DAY))
    timed = lambda side: stream().select(F.col("n").alias(side), F.col("created_time").cast("timestamp").alias(f"{side}_time")).withWatermark(f"{side}_time", late)
    own = lambda side: F.floor(F.unix_micros(f"{side}_time") / F.lit(width))
    left = timed("q").withColumn("bucket", F.explode(F.sequence(own("q") - 1, own("q") + 1)))
    right = timed("n").withColumn("bucket of n", own("n"))
    reach = f"interval {width // 1_000_000} seconds"
    near = F.expr(f"q_time >= n_time - {reach} and q_time <= n_time + {reach}")
    return left.join(right, (F.col("bucket") == F.col("bucket of n")) & near & (F.col("q") < F.col("n"))).select("q", "n")


def per_day(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, n_patches): patches by day of creation; what comes later than the watermark allows isn't counted any more."""
    timed = stream.withColumn("at", F.col("created_time").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n_patches")).select(F.col("w.start").alias("day"), "n_patches")


def reranked_stream(asked: DataFrame, client: Callable[[str], str], model: str, cache: str, checkpoint: str, head: int = 10) -> StreamingQuery:
    """Reranks the rows of a stream (q, ids, prompt) batch by batch and keeps sound orders under their key in a Parquet table.

    A batch that is run again after a failure asks only for what the table doesn't have yet.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        known = _read(spark, cache)
        # Rows whose key is known cost nothing; the same key asked for twice in a batch is asked once.
        keyed = rows.withColumn("key", order_key(F.lit(model), head, F.col("q"), F.col("ids"))).dropDuplicates(["key"]).drop("key")
        done = rerank(keyed, client, model, known, head)
        done.where("status = 'ok'").select("key", "q", "order").write.mode("append").parquet(cache)

    return asked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = "key string, q string, `order` array<string>"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
