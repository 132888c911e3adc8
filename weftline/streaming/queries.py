"""Streaming operators over whole tables, each drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import DAY
from ..schema import SQL, patch_view, patches, table
from ..session import new_folder
from .stages import arriving, arriving_pairs, per_day

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Files that one micro-batch reads, at most.
FILES_AT_ONCE = 64


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The patch view of documents as a stream; the table is a file or a folder of files, of which a batch reads a bounded number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.option("maxFilesPerTrigger", FILES_AT_ONCE).schema(table(spark, sf, "documents").schema)
    return patch_view(reader.parquet(f"{sf}/documents.parquet") if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(sf))


def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    name = f"stream_{uuid.uuid4().hex}"
    # One row for each day: what the memory sink holds doesn't grow with the patches.
    per_day(_stream(spark, sf)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    out = spark.table(name)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_patches")


def streamed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    near = arriving(_stream(spark, sf).where("n % 50 = 0"), patches(spark, sf), 1)
    folder = new_folder(spark, "stream")
    near.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(near.schema).parquet(f"{folder}/out")


def streamed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth patch against those that arrive with it. Files come in no order of time, so the delay that is allowed is a month, as
    long as the patches' times are apart."""
    pairs = arriving_pairs(lambda: _stream(spark, sf).where("n % 10 = 0"), 1 / 12, "31 days")
    folder = new_folder(spark, "stream")
    pairs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{folder}/out")


QUERIES |= {"streamed_counts": streamed_counts, "streamed_candidates": streamed_candidates, "streamed_pairs": streamed_pairs}
ORACLES |= {
    "streamed_counts": f"with {SQL} select strftime(created_time, '%Y-%m-%d') as day, count(*)::bigint as n_patches from p group by 1",
    "streamed_pairs": f"with {SQL} select a.n as q, b.n as n from p a join p b on a.n % 10 = 0 and b.n % 10 = 0 and a.n < b.n and abs(epoch_us(a.created_time) - epoch_us(b.created_time)) <= 7200000000",
    "streamed_candidates": f"with {SQL} select a.n as q, b.n as n from p a join p b on a.n % 50 = 0 and a.n <> b.n and abs(epoch_us(a.created_time) - epoch_us(b.created_time)) <= {DAY}",
}
