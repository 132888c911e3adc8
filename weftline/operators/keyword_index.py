"""The keyword index, kept between runs, and searches that read as little of it as bounds allow.

Posting lists are cut into blocks by how often a word comes up in a patch (powers of two), and a small table says of each block
how many postings it has and the highest count. Changes are written as they come: new postings, ids taken out, and what both do to the
counts of words, so that scores are those of an index made anew.

A search finds a score that k patches reach at least. Blocks of a query that, all together, can't lift a patch to it are not read
(MaxScore); patches met in the others whose score could still reach it are then scored in full. Queries of so many words that bounds exclude
little are scored against all patches in blocks instead, with the same result. Weights of very common words are
negative; they lower a score, so their bound is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..session import kept
from .retrieval import keyword_meetings, postings
from .windows import top

#: Postings that a query's strongest blocks have to hold, as a multiple of k, to find a score that k patches reach.
SEED = 8
#: Ids taken out that are met by a broadcast join, at most; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
#: Scores that may differ by less count as equal.
SLACK = 1e-6
#: Where more than this share of the postings would have to be read, as for queries of many words, documents are scored in blocks.
DENSE = 0.5

POSTINGS = "token string, level int, n long, tf long, batch int"
COUNTS = "token string, level int, most long, size long, cf long, batch int"
DOCS = "docs long, batch int"
REMOVED = "n long, batch int"


class KeywordIndex:
    """An index in a folder, which may be empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, rows: DataFrame, path: str) -> KeywordIndex:
        """An index of rows (n, text). Null texts have no words, but count as patches."""
        out = cls(rows.sparkSession, path)
        out.add(rows)
        return out

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        exists = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if exists else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _next(self) -> int:
        return (self._table("docs", DOCS).agg(F.max("batch")).first()[0] or 0) + 1

    @property
    def n_docs(self) -> int:
        return self._table("docs", DOCS).agg(F.sum("docs")).first()[0] or 0

    def postings(self) -> DataFrame:
        """(token, level, n, tf) of the patches that are in the index now."""
        rows, gone = self._table("postings", POSTINGS), self._table("removed", REMOVED)
        n_gone = gone.count()
        if n_gone:
            until = gone.groupBy("n").agg(F.max("batch").alias("until"))
            rows = rows.join(F.broadcast(until) if n_gone <= MOST_BROADCAST else until, "n", "left").where("until is null or batch > until")
        return rows.select("token", "level", "n", "tf")

    def counts(self) -> DataFrame:
        """(token, level, most, size, cf): of each block a bound on tf, the number of its postings, and the sum of their tf."""
        sums = self._table("counts", COUNTS).groupBy("token", "level").agg(F.max("most").alias("most"), F.sum("size").alias("size"), F.sum("cf").alias("cf"))
        return sums.where("size > 0")

    def _count(self, found: DataFrame, sign: int, docs: int, batch: int) -> None:
        sums = found.groupBy("token", "level").agg(F.max("tf").alias("most"), (sign * F.count("*")).alias("size"), (sign * F.sum("tf")).alias("cf"))
        self._write(sums.withColumn("batch", F.lit(batch)), "counts")
        self._write(self.spark.createDataFrame([(sign * docs, batch)], DOCS), "docs")

    def add(self, rows: DataFrame) -> None:
        """More rows (n, text). An n that is there already has to be removed first, or changed by change()."""
        batch = self._next()
        level = F.floor(F.log2("tf") + 1e-9).cast("int")
        found = postings(rows.select("n", "text")).withColumn("level", level).select("token", "level", F.col("n").cast("long").alias("n"), "tf", F.lit(batch).alias("batch"))
        # Files are ordered by word, so that a search which asks for few words skips what has none of them.
        self._write(found.repartitionByRange("token", "level", "n").sortWithinPartitions("token", "level", "n"), "postings")
        self._count(self._table("postings", POSTINGS).where(F.col("batch") == batch), 1, rows.count(), batch)

    def remove(self, ids: DataFrame) -> None:
        """Takes patches (n) out: their postings are left where they are and no longer read, their counts are taken off. The ids have
        to be in the index; postings() tells."""
        gone = kept(ids.select(F.col("n").cast("long").alias("n")).distinct(), "gone")
        n, batch = gone.count(), self._next()
        found = self.postings().join(F.broadcast(gone) if n <= MOST_BROADCAST else gone, "n", "left_semi")
        self._count(found, -1, n, batch)
        self._write(gone.withColumn("batch", F.lit(batch)), "removed")

    def change(self, rows: DataFrame) -> None:
        """Rows (n, text) in place of those of the same n."""
        self.remove(rows.select("n"))
        self.add(rows)

    def compacted(self, path: str) -> KeywordIndex:
        """The same index in another folder, without what has been taken out, and with exact bounds."""
        out = KeywordIndex(self.spark, path)
        out._write(self.postings().withColumn("batch", F.lit(1)).repartitionByRange("token", "level", "n").sortWithinPartitions("token", "level", "n"), "postings")
        out._count(out._table("postings", POSTINGS), 1, self.n_docs, 1)
        return out

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, n, kw, rank) for queries (q, text): the k patches of most kw, as keyword_scores() has it, among those that share a word
        with the query. Exact; ties to nine places go by the smaller n."""
        terms = self._terms(queries)
        live = self.postings()
        least = self._reached(terms, live, k)
        read = self._read(terms, least)
        sizes = read.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("essential"), F.col("size"))).alias("read")).first()
        if (sizes["read"] or 0) > DENSE * (sizes["all"] or 0):
            return top(keyword_meetings(terms.select("q", "token", "w").distinct(), live, k), k, "kw")
        found = self._met(read.where("essential"), live)
        rest = read.where("not essential").groupBy("q").agg(F.max("running").alias("rest"))
        able = found.join(least, "q", "left").join(rest, "q", "left").where(F.col("least").isNull() | (F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("least") - SLACK))
        return top(self._scored(kept(able.select("q", "n"), "able"), terms, live), k, "kw")

    def _terms(self, queries: DataFrame) -> DataFrame:
        """(q, token, level, size, w, bound): the blocks of each query's words, and what a posting in them can add at most."""
        asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("token")).groupBy("q", "token").agg(F.count("*").alias("qtf"))
        blocks = self.counts().withColumn("cf", F.sum("cf").over(Window.partitionBy("token")))
        w = F.col("qtf") * F.ln(F.lit(float(max(self.n_docs, 1))) / (F.col("cf") + 1))
        found = asked.join(blocks, "token").withColumn("w", w)
        return kept(found.select("q", "token", "level", "size", "w", (F.greatest("w", F.lit(0.0)) * F.col("most")).alias("bound")), "terms")

    def _reached(self, terms: DataFrame, live: DataFrame, k: int) -> DataFrame:
        """(q, least): a score that k patches of the query reach; queries that fewer are found for have no row. The patches are those
        that its strongest blocks rank first."""
        strongest = Window.partitionBy("q").orderBy(F.desc("bound"), "size", "token", "level")
        before = F.sum("size").over(strongest) - F.col("size")
        seeds = terms.where("bound > 0").withColumn("before", before).where(F.col("before") < SEED * k)
        first = top(self._met(seeds, live), 2 * k, "part").select("q", "n")
        best = top(self._scored(kept(first, "first"), terms, live), k, "kw")
        return kept(best.groupBy("q").agg(F.count("*").alias("n"), F.min("kw").alias("least")).where(F.col("n") == k).select("q", "least"), "least")

    def _read(self, terms: DataFrame, least: DataFrame) -> DataFrame:
        """terms with running, the sum of what the blocks up to each one can add, the weakest first, and essential: whether that
        reaches the least score. What a patch has in blocks that aren't essential can't lift it there alone."""
        by_level = Window.partitionBy("q", "token").orderBy("level")
        more = F.col("bound") - F.coalesce(F.lag("bound").over(by_level), F.lit(0.0))
        weakest = Window.partitionBy("q").orderBy("bound", "token", "level")
        # Bounds within a word grow with its levels, unless postings of the highest count have been taken out.
        highest = terms.withColumn("bound", F.max("bound").over(by_level))
        running = highest.withColumn("more", more).withColumn("running", F.sum("more").over(weakest))
        essential = F.col("least").isNull() | (F.col("running") >= F.col("least") - SLACK)
        return kept(running.join(least, "q", "left").withColumn("essential", essential).drop("least"), "read")

    @staticmethod
    def _met(terms: DataFrame, live: DataFrame) -> DataFrame:
        """(q, n, part): what these blocks add to the scores of the patches in them."""
        return terms.select("q", "token", "level", "w").join(live, ["token", "level"]).groupBy("q", "n").agg(F.sum(F.col("w") * F.col("tf")).alias("part"))

    @staticmethod
    def _scored(pairs: DataFrame, terms: DataFrame, live: DataFrame) -> DataFrame:
        """(q, n, kw) of pairs (q, n), from all words of both."""
        words = pairs.join(live.select("n", "token", "tf"), "n")
        return words.join(terms.select("q", "token", "w").distinct(), ["q", "token"]).groupBy("q", "n").agg(F.sum(F.col("w") * F.col("tf")).alias("kw"))
