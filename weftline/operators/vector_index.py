"""An inverted file over vectors that is kept between runs.

k-means cells are learnt on a bounded sample, and every vector lies in the Parquet partition of the cell whose centre it is nearest
to. A search reads the cells next to each query and compares exactly there. A cell's members are no further from its centre than
its radius, so by the triangle inequality of angles a cell has a bound on what it can hold for a query: with exact=True cells that
could still hold one of the first k are read too, and the result is that of a search through everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import USUAL
from ..functions.columns import norm
from ..session import kept
from .retrieval import CORPUS_BLOCK, QUERY_BLOCK, meetings
from .windows import top

#: Vectors that cells are learnt from, and cells, at most. Centres are held by every task that deals vectors out.
MOST_SAMPLED, MOST_CELLS = 100_000, 4_096
#: Rows that the cells read for a query have to hold at least, as a multiple of k.
BREADTH = 8
#: Ids taken out of an index that are met by a broadcast join, at most; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
#: Rows of a cell in one file, about.
ROWS_A_FILE = 200_000
#: Similarities of rows and centres that are made at a time, and bytes of vectors that one task compares, about.
SIMS_STEP, TASK_BYTES = 1 << 17, 64 << 20
SLACK = 1e-9


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def _rows(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _steps(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows times cells is bounded: a row may ask for every cell, and its vector is copied for each."""
    step = max(1, SIMS_STEP // cells)
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class VectorIndex:
    """Opens an index that build() has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.centres = np.array([r["centre"] for r in found], np.float64).reshape(len(found), -1)

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, seed: int = USUAL.seed) -> VectorIndex:
        """An index of rows (n, vector) in a new folder. Cells: the square root of the number of rows, if not given. Null vectors are
        left out, zero vectors are similar to none and lie anywhere. Of no rows an empty index is made, which can be added to."""
        rows = rows.where("vector is not null").select("n", F.col("vector").cast("array<double>").alias("vector"))
        spark, total = rows.sparkSession, rows.count()
        cells = max(1, min(MOST_CELLS, cells or round(total**0.5)))
        draw = F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MOST_SAMPLED / max(total, 1)))
        sample = rows.where(draw & (norm(F.col("vector")) > 0)).select(array_to_vector("vector").alias("x")).persist()
        sampled = sample.count()
        if sampled:
            centres = [list(map(float, c)) for c in KMeans(k=max(2, min(cells, sampled)), featuresCol="x", distanceMeasure="cosine", initMode="random", seed=seed, maxIter=8).fit(sample).clusterCenters()] if cells > 1 and sampled > 1 else [list(map(float, sample.first()["x"]))]
        else:
            centres = [[0.0] * len((rows.first() or {"vector": [0.0]})["vector"])]
        sample.unpersist()
        spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
        out = cls(spark, path)
        out.add(rows)
        return out

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        exists = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if exists else self.spark.createDataFrame([], schema)

    def _sizes(self) -> DataFrame:
        return self._table("sizes", "cell int, batch int, rows long, least double")

    def _vectors(self) -> DataFrame:
        return self._table("vectors", "n long, vector array<double>, batch int, cell int")

    def _next(self) -> int:
        batches = self._sizes().select("batch").unionByName(self._table("removed", "n long, batch int").select("batch"))
        return (batches.agg(F.max("batch")).first()[0] or 0) + 1

    def add(self, rows: DataFrame) -> None:
        """More rows (n, vector), without making the cells anew. An n that is there already has to be removed first."""
        batch, centres = self._next(), self.centres
        unit = _unit(centres).T

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _steps(batches, len(centres)):
                if b.num_rows:
                    sims = _rows(b.column(1)) @ unit
                    cell = sims.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(sims[np.arange(len(cell)), cell])], names=["n", "vector", "cell", "near"])

        source = rows.where("vector is not null").select(F.col("n").cast("long").alias("n"), F.col("vector").cast("array<double>").alias("vector"))
        placed = source.mapInArrow(dealt, "n long, vector array<double>, cell int, near double").withColumn("batch", F.lit(batch)).persist()
        sizes = placed.groupBy("cell", "batch").agg(F.count("*").alias("rows"), F.min("near").alias("least"))
        # A cell may hold any share of the rows: its files are written by as many tasks as its size asks for.
        cuts = sizes.select("cell", (F.col("rows") / ROWS_A_FILE + 1).cast("int").alias("cuts"))
        spread = placed.join(F.broadcast(cuts), "cell").withColumn("cut", F.pmod(F.xxhash64("n"), F.col("cuts")))
        spread.repartition("cell", "cut").select("n", "vector", "batch", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        sizes.write.mode("append").parquet(f"{self.path}/sizes")
        placed.unpersist()

    def remove(self, ids: DataFrame) -> None:
        """Takes rows (n) out that are there by now; what is added later counts again."""
        ids.select(F.col("n").cast("long").alias("n")).distinct().withColumn("batch", F.lit(self._next())).write.mode("append").parquet(f"{self.path}/removed")

    def search(self, queries: DataFrame, k: int, breadth: float = BREADTH, exact: bool = False) -> DataFrame:
        """(q, n, sem, rank) for queries (q, vector): the k most similar rows of the cells next to each query that hold breadth * k
        rows together; with exact those of all rows. Zero vectors have similarity 0 with all. Ties: the smaller n."""
        asked = queries.where("vector is not null").select("q", F.col("vector").cast("array<double>").alias("vector"))
        first = self._found(self._probes(asked.withColumn("least", F.lit(None).cast("double")), breadth * k), k)
        if not exact:
            return top(first, k, "sem")
        near = kept(top(first, k, "sem"), "near")
        least = near.groupBy("q").agg(F.count("*").alias("found"), F.min("sem").alias("least"))
        # Where fewer than k have been found, every cell may hold one of them.
        beyond = asked.join(least, "q", "left").select("q", "vector", F.when(F.col("found") >= k, F.col("least")).otherwise(-2.0).alias("least"))
        return top(near.select("q", "n", "sem").unionByName(self._found(self._probes(beyond, breadth * k), k)), k, "sem")

    def _probes(self, asked: DataFrame, wanted: float) -> DataFrame:
        """(q, vector, cell) for asked (q, vector, least): the cells to read first, or, where least isn't null, the cells beyond them
        whose bound reaches it."""
        stats = {r["cell"]: r for r in self._sizes().groupBy("cell").agg(F.sum("rows").alias("rows"), F.min("least").alias("least")).collect()}  # one row a cell
        held = np.array(sorted(stats), np.int64)
        rows = np.array([stats[c]["rows"] for c in held], np.float64)
        radius = np.arccos(np.clip([stats[c]["least"] for c in held], -1, 1))
        unit = _unit(self.centres[held]).T if len(held) else None

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _steps(batches, max(1, len(held))):
                if unit is None or not b.num_rows:
                    continue
                sims = np.clip(_rows(b.column(1)) @ unit, -1, 1)
                order = np.argsort(-sims, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                early = np.zeros(sims.shape, bool)
                np.put_along_axis(early, order, before < wanted, axis=1)
                least = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                bound = np.cos(np.maximum(0, np.arccos(sims) - radius))
                take = np.where(np.isnan(least), early, ~early & (bound >= least - SLACK))
                at, cell = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(held[cell].astype(np.int32), pa.int32())], names=["q", "vector", "cell"])

        return asked.mapInArrow(chosen, "q long, vector array<double>, cell int")

    def _found(self, probes: DataFrame, k: int) -> DataFrame:
        """(q, n, sem): the best k of each block of each probed cell."""
        probes = kept(probes, "probes")
        wanted = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        sizes = self._sizes().groupBy("cell").agg(F.sum("rows").alias("rows"))
        asking = self.spark.createDataFrame([(c, -(-n // QUERY_BLOCK), n) for c, n in wanted.items()], "cell int, parts int, asked long")
        blocks = F.broadcast(sizes.join(asking, "cell").select("cell", "parts", "asked", "rows", F.ceil(F.col("rows") / CORPUS_BLOCK).cast("int").alias("blocks")))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        part = lambda c, m: F.pmod(F.xxhash64(c), F.col(m))
        of = lambda *cs: (F.xxhash64("cell", F.col(c).cast("long")).alias(x) for x, c in zip("ab", cs, strict=True))
        left = probes.join(blocks, "cell").withColumn("part", part("q", "parts")).withColumn("block", every("blocks")).select("q", "vector", *of("part", "block"))
        right = self._vectors().where(F.col("cell").isin(list(wanted))).join(blocks, "cell").withColumn("block", part("n", "blocks"))
        gone = self._table("removed", "n long, batch int").groupBy("n").agg(F.max("batch").alias("until"))
        n_gone = gone.count()
        if n_gone:
            marked = right.join(F.broadcast(gone) if n_gone <= MOST_BROADCAST else gone, "n", "left")
            right = marked.where("until is null or batch > until").drop("until")
        right = right.withColumn("part", every("parts")).select("n", "vector", *of("part", "block"))
        # As many parts as keep each small, whatever the number of cells that queries ask for.
        sent = blocks.agg(F.sum(F.col("rows") * F.col("parts")).alias("right"), F.sum(F.col("asked") * F.col("blocks")).alias("left")).first()
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n_parts = max(least, -(-((sent["right"] or 0) + (sent["left"] or 0)) * (8 * self.centres.shape[1] + 64) // TASK_BYTES))
        return meetings(left.repartition(n_parts, "a", "b"), right.repartition(n_parts, "a", "b"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact rows (q, n) that are among the found ones."""
    hit = exact.select("q", "n").join(found.select("q", "n", F.lit(1).alias("hit")), ["q", "n"], "left")
    return hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), F.count("*").alias("wanted"), F.try_divide(F.coalesce(F.sum("hit"), F.lit(0)), F.count("*")).alias("recall"))
