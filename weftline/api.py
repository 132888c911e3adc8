"""One object for what a service asks: projects, predictions for single patches, and how good predictions are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import USUAL, Settings
from .operators import evaluation, pools, ranking, rerank, retrieval, training, windows
from .operators.boosting import LambdaMart
from .operators.encoding import Encoder
from .operators.vector_index import VectorIndex
from .session import kept
from .sources import files
from .sources.changes import Client, normalised


class Engine:
    """Projects are tables of patches: n, patch_id, title, description, created_time, files, vector."""

    def __init__(self, projects: dict[str, DataFrame], client: Client | None = None, settings: Settings = USUAL, encoder: Encoder | None = None):
        """encoder is the one that the projects' vectors come from, for patches that are fetched."""
        self.tables, self.client, self.settings, self.encoder = projects, client, settings, encoder

    def projects(self) -> list[str]:
        return sorted(self.tables)

    def details(self, project: str, patch_id: str) -> DataFrame:
        """The patch, no row if it is unknown."""
        return self._table(project).where(F.col("patch_id") == str(patch_id).strip()).limit(1)

    def predict(self, project: str, patch_id: str, top_k: int | str | None = None, window_days: float | str | None = None, strategy: str = "multi_query") -> DataFrame:
        """(patch_id, title, created_on, score, rank) of the patches most likely linked with one. ValueError for an unknown project,
        an empty id or numbers that are none; LookupError if neither the project nor its review system knows the patch."""
        rows, wanted = self._table(project), str(patch_id or "").strip()
        if not wanted:
            raise ValueError("no patch id")
        k, days = int(top_k or self.settings.top_k), float(self.settings.window_days if window_days is None else window_days)
        query = self.details(project, wanted).withColumn("q", F.col("n"))
        if not query.limit(1).count():
            query = self._fetched(project, wanted, rows)
        found = retrieval.retrieve(query, rows, strategy, k, days, self.settings)
        return found.join(rows.select("n", "patch_id", "title", F.date_format("created_time", "yyyy-MM-dd").alias("created_on")), "n").select("patch_id", "title", "created_on", "score", "rank")

    def _table(self, project: str) -> DataFrame:
        key = str(project or "").strip().lower()
        if key not in self.tables:
            raise ValueError(f"unknown project: {key}")
        return self.tables[key]

    def _fetched(self, project: str, patch_id: str, rows: DataFrame) -> DataFrame:
        reply = self.client.fetch(str(project).strip().lower(), patch_id) if self.client else None
        if reply is None:
            raise LookupError(f"unknown patch: {patch_id}")
        spark = rows.sparkSession
        one = normalised(spark.createDataFrame([(patch_id, reply)], "patch_id string, reply string")).where("title is not null")
        if not one.limit(1).count():
            raise LookupError(f"unknown patch: {patch_id}")
        numbers = {"n": F.lit(-1).cast("long"), "q": F.lit(-1).cast("long")}
        if self.encoder:
            return one.join(self.encoder.encode(one), "patch_id").withColumns(numbers)
        # Without an encoder a patch from outside has no vector: a zero vector is like none, so its words alone decide.
        zero = rows.select(F.transform("vector", lambda x: F.lit(0.0)).alias("vector")).limit(1)
        return one.join(F.broadcast(zero)).withColumns(numbers)

    def candidate_pool(self, project: str, queries: DataFrame, strategy: str = "file_boost", index: VectorIndex | None = None) -> DataFrame:
        """(q, n, pool, place): for queries (rows of the project with q) the window, the nearest vectors - from an index, if one is
        given - and retrieval, each candidate where it comes first."""
        rows, s = self._table(project), self.settings
        win = windows.candidates(queries, rows, s.window_days).select("q", "n", F.col("n").alias("place"))
        near = index.search(queries, 3 * s.ann_k + 5) if index else None
        ann = pools.ann_pool(queries, rows, s.ann_k, s.ann_days, near).withColumnRenamed("rank", "place")
        return pools.ordered_union(win, ann, pools.rag_pool(queries, rows, strategy, s.pool_k, s.pool_days).withColumnRenamed("rank", "place"))

    def rank_ml_to_rag(self, project: str, queries: DataFrame, ranker: ranking.Ranker = ranking.PLAIN, candidates: int = 50, top_k: int | None = None) -> DataFrame:
        """(q, n, ml_score, rag_score, score, rank): the model's best of each window, put in order anew by a blend with retrieval."""
        rows = self._table(project)
        pairs = windows.candidates(queries, rows, self.settings.window_days).select("q", "n")
        return ranking.refine(ranking.ml_stage(pairs, rows, ranker, candidates), rows, top_k or self.settings.top_k, self.settings)

    def rank_full(self, project: str, queries: DataFrame, client: Callable[[str], str], model: str, ranker: ranking.Ranker = ranking.PLAIN, candidates: int = 50, top_k: int | None = None, known: DataFrame | None = None) -> DataFrame:
        """(q, n, rank, old_rank, status): rank_ml_to_rag(), and then the heads as an external model orders them."""
        ranked = kept(self.rank_ml_to_rag(project, queries, ranker, candidates, top_k), "refined")
        return rerank.chain(ranked, self._table(project), client, model, known, self.settings.head)

    def train(self, project: str, links: DataFrame) -> LambdaMart:
        """The boosted ranker, learnt from links (source, target) of patches before the split."""
        rows = self._table(project)
        split = pools.split_time(rows, self.settings.test_share).first()["split_micros"]
        _, pairs = training.labelled_pairs(rows, links, split, lambda before: self.candidate_pool(project, before))
        return LambdaMart.fit(pairs, seed=self.settings.seed)

    def compare(self, model: DataFrame, retrieval_only: DataFrame) -> DataFrame:
        """One row for each query: how many of two rankings' rows (q, n) are in both, in the first, in the second."""
        both = model.select("q", "n", F.lit(True).alias("m")).join(retrieval_only.select("q", "n", F.lit(True).alias("r")), ["q", "n"], "full_outer")
        m, r = F.col("m").isNotNull(), F.col("r").isNotNull()
        return both.groupBy("q").agg(F.count_if(m & r).alias("both"), F.count_if(m & ~r).alias("model_only"), F.count_if(r & ~m).alias("retrieval_only"))

    def hydrate(self, project: str, hand_off: DataFrame) -> DataFrame:
        """The texts that hand-off rows need."""
        return files.hydrated(hand_off, self._table(project))

    def rerank(self, hand_off: DataFrame, texts: DataFrame, client: Callable[[str], str], model: str, known: DataFrame | None = None) -> DataFrame:
        """(q, key, order, status, seconds) of hand-off rows, as the external model orders their heads."""
        return rerank.rerank(rerank.payloads(hand_off, texts, self.settings.head), client, model, known, self.settings.head)

    def evaluate(self, ranked: DataFrame, truth: DataFrame) -> DataFrame:
        return evaluation.aggregate(evaluation.per_query(ranked, truth, self.settings.ks), self.settings.ks)
