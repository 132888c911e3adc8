"""A corpus from documents: toxicity, near-duplicates, benchmark decontamination, secrets, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents, so columns of other names end there; run() writes each stage's result as Parquet and reads it again as the next one's
docs. Every decision is on a row, not on its id: rows of one id, or of none, that carry different texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe_codec import encode_digests
from weftline.llm.common import dropped, ordered_numbers, scratch, table, written
from weftline.llm.decontamination import contaminated_rows, text_key
from weftline.llm.minhash import components
from weftline.llm.secrets import redacted
from weftline.llm.toxicity import scored, train

#: Documents that are left out by a broadcast join, some 20 bytes each, at most. Beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """docs without the rows that have these keys; nulls are equal."""
    found, rows = rows, written(rows.select(*(F.col(k).alias(f"out {k}") for k in keys)), "left-out")
    dropped(found)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"out {k}"))
    return docs.join(F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier, learnt from the labels of docs, scores 0.5 or more."""
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where("score < 0.5").drop("score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (shingles of five words, similarity 0.8 or more) the document of smallest id stays; of
    rows of one id that of the least text, then of the least lang, source and n_chars. Texts without words have no duplicates."""
    docs = docs.select(*COLUMNS)
    n, distinct = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == distinct:
        return _without(docs, components(docs).where("not kept").select("doc_id").distinct(), "doc_id").select(*COLUMNS)
    # Ids that are null or repeated don't tell rows apart: numbers in their order do.
    rows = ordered_numbers(docs, ["doc_id", "text", "lang", "source", "n_chars"], "row")
    return _without(rows, components(rows, id_col="row").where("not kept").select("row"), "row").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold an item of the benchmark."""
    docs = docs.select(*COLUMNS)
    held = contaminated_rows(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs.withColumn("text_key", text_key(F.col("text"))), held, "doc_id", "text_key").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; all documents stay."""
    return redacted(docs.select(*COLUMNS))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: doc_id, n_tokens and digests of ids and decoded text."""
    return encode_digests(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scans", secret_scans), ("bpe", bpe)]

#: SQL can't express the learnt stages and BPE; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's result and all that its operators have kept are deleted once the next stage is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            own = made.pop()
            if before:
                made.append(before)
            before = own
    return docs
