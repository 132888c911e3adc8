"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups.

A partial partition holds one sum for each shard. Differencing takes the two partial partitions of largest spread and adds
them in opposite order, the largest sum to the smallest. It works in two levels: groups are dealt by hash into cells, each
cell is differenced within one task, and what is left of each cell - one sum for each shard - is differenced on the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table, tidied, written

#: Groups that a cell holds on average, at most.
CELL_GROUPS = 20_000
#: Cells at most: the driver holds one sum for each cell and shard.
MOST_CELLS = 200_000


def differenced(sums: np.ndarray) -> np.ndarray:
    """For each row of sums (items by shards) the shard that each of its columns goes to.

    An item with one sum for each shard is a partial partition of its own; a plain item has its size in column 0.
    """
    items, shards = sums.shape
    if not items:
        return np.zeros((0, shards), np.int64)
    # A heap entry: minus spread, a tie-breaker, the sums from small to large, and for each the columns that are in it.
    heap = []
    for k, row in enumerate(sums.tolist()):
        order = sorted(range(shards), key=lambda c: (row[c], c))
        heap.append((row[order[0]] - row[order[-1]], k, [row[c] for c in order], [(k, c) for c in order]))
    heapq.heapify(heap)
    made: list[tuple] = []
    number = items
    while len(heap) > 1:
        _, _, a, a_of = heapq.heappop(heap)
        _, _, b, b_of = heapq.heappop(heap)
        made_at = len(made)
        made.append((a_of, b_of[::-1]))
        total = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(shards), key=lambda c: (total[c], c))
        heapq.heappush(heap, (total[order[0]] - total[order[-1]], number, [total[c] for c in order], [(-1 - made_at, c) for c in order]))
        number += 1
    out = np.zeros((items, shards), np.int64)
    todo = [(of, shard) for shard, of in enumerate(heap[0][3])]
    while todo:
        (k, c), shard = todo.pop()
        if k >= 0:
            out[k, c] = shard
        else:
            a_of, b_of = made[-1 - k]
            todo += [(a_of[c], shard), (b_of[c], shard)]
    return out


@tidied
def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", cell_groups: int = CELL_GROUPS) -> DataFrame:
    """One row for each row of docs: its id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot.

    Rows of equal text are one group and stay together; sums of sizes are as near equal as differencing makes them. Slots
    number the rows of each shard without gaps from 0. Null texts are one group, of size 1, and their CRC is that of no bytes;
    empty texts are a group of their own. A group larger than its share makes its shard as much larger. Repeated rows and
    null ids get a slot each. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(
            F.col(id_col),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), F.lit(b"")).alias("group"),
        ).withColumn("size", F.col("size") + 1),
        "rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    cells = max(1, min(MOST_CELLS, groups.count() // cell_groups + 1))
    cell = F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True])
        sums = np.zeros((len(pdf), n_shards), np.int64)
        sums[:, 0] = pdf["bytes"]
        return pdf.assign(column=differenced(sums)[:, 0])[["cell", "group", "bytes", "column"]]

    placed = written(groups.withColumn("cell", cell).groupBy("cell").applyInPandas(within, "cell int, `group` binary, bytes bigint, column bigint"), "cells")
    left = placed.groupBy("cell", "column").agg(F.sum("bytes").alias("bytes")).toPandas()  # cells x shards numbers
    sums = np.zeros((cells, n_shards), np.int64)
    sums[left["cell"], left["column"]] = left["bytes"]
    final = differenced(sums)
    at = spark.createDataFrame([(c, k, int(s)) for c, row in enumerate(final.tolist()) for k, s in enumerate(row)], "cell int, column bigint, shard int")
    of = placed.join(F.broadcast(at), ["cell", "column"]).select("group", "shard")
    # A group may hold any share of the rows: only the groups move by key, the rows are joined with AQE's split of skew.
    sharded = written(rows.join(of, "group").select(id_col, "size", "text_crc32", "shard"), "sharded")
    return numbered(sharded, "shard", id_col, n_shards)


def numbered(rows: DataFrame, by: str, id_col: str, kinds: int) -> DataFrame:
    """Adds slot: a number without gaps from 0 within each value of a column of few values.

    Rows are dealt by a hash of their id, counted by block and value, and numbered within their block from where the blocks
    before it end. The driver sees one count for each block and value.
    """
    spark = rows.sparkSession
    blocks = max(8, 4 * parts(spark))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
    counts = {(r["block"], r[by]): r["n"] for r in dealt.groupBy("block", by).agg(F.count("*").alias("n")).collect()}
    start, ends = [], dict.fromkeys({k for _, k in counts}, 0)
    for block in range(blocks):
        for k in ends:
            if (block, k) in counts:
                start.append((block, k, ends[k]))
                ends[k] += counts[block, k]
    starts = spark.createDataFrame(start, f"block int, `{by}` int, first bigint")
    order = Window.partitionBy("block", by).orderBy(id_col, *[c for c in rows.columns if c not in (id_col, by)])
    return dealt.join(F.broadcast(starts), ["block", by]).withColumn("slot", F.col("first") + F.row_number().over(order) - 1).drop("block", "first")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
