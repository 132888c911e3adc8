"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, scratch, tidied  # noqa: F401
from ..session import kept as written

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\t\n\x0b\x0c\r"
#: Bytes of text that a Python worker turns into objects at a time; one row is never cut.
SLICE = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many bytes in a column of texts, so that what is made of them is bounded however many long
    texts a batch has. A slice has one row at least. Memory that Arrow keeps is given back at the end."""
    try:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
                yield b.slice(at, upto - at)
                at = upto
    finally:
        pa.default_memory_pool().release_unused()


def words(text: Column) -> Column:
    """The words of a text, whole and in order; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_numbers(rows: DataFrame, keys: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """rows with a column of that name: numbers without gaps, in the order of the keys, by a sort over all partitions. The driver
    sees one count for each partition. Of the columns only those of keep are stored, if it is given."""
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys).select(*(keep or rows.columns))
    kept = written(sorted_rows.withColumn("row within", F.monotonically_increasing_id()), "in-order")
    part, within = F.shiftright("row within", 33), F.col("row within").bitwiseAND(F.lit((1 << 33) - 1))
    firsts, n = [], 0
    for r in sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        firsts.append((r["part"], n))
        n += r["n"]
    starts = spark.createDataFrame(firsts, "`part of` bigint, `starts at` bigint")
    return kept.join(F.broadcast(starts), part == F.col("part of")).withColumn(name, F.col("starts at") + within).drop("part of", "starts at", "row within")
