"""Reordering the heads of rankings by an external model: prompts, replies, orders, the cache of orders."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import USUAL
from ..functions.columns import described, order_key, parsed_reply
from ..session import kept

#: Prompts that are objects of a worker at a time.
PROMPTS_STEP = 256
INSTRUCTION = "Rank the candidate changes by how closely they are linked with the target change. Answer with a JSON list of candidate ids, best first, and nothing else."


def prompt(target: Column, listed: Column) -> Column:
    """The prompt for a described target and a list of (id, described candidate)."""
    shown = F.array_join(F.transform(listed, lambda c: F.concat(F.lit("\n\nid: "), c["id"], F.lit("\n"), c["shown"])), "")
    return F.concat(F.lit(INSTRUCTION), F.lit("\n\ntarget\n"), target, F.lit("\n\ncandidates"), shown)


def payloads(rows: DataFrame, texts: DataFrame, head: int = USUAL.head) -> DataFrame:
    """Hand-off rows with their texts: q, ids (the head), listed, n_missing, prompt. Ids without a text count as missing and are
    shown without one; if no id at all has one, the texts don't belong to the rows and ValueError is raised."""
    shown = texts.select(F.col("patch_id").alias("id"), described(F.col("title"), F.col("description"), F.col("files")).alias("shown"))
    parts = rows.select(F.col("source_patch_id").alias("q"), F.posexplode(F.slice("candidates", 1, head)).alias("place", "id"))
    met = parts.join(shown, "id", "left")
    if not met.where("shown is not null").limit(1).count() and parts.limit(1).count():
        raise ValueError("none of the candidates has a text")
    none = described(F.lit(""), F.lit(""), F.array().cast("array<string>"))
    listed = met.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "id", F.coalesce("shown", none).alias("shown")))).alias("listed"), F.count_if(F.col("shown").isNull()).alias("n_missing"))
    target = shown.select(F.col("id").alias("q"), F.col("shown").alias("target"))
    out = listed.join(target, "q", "left")
    return out.select("q", F.transform("listed", lambda c: c["id"]).alias("ids"), "n_missing", prompt(F.coalesce("target", none), F.col("listed")).alias("prompt"))


def reordered(head: DataFrame, orders: DataFrame) -> DataFrame:
    """(q, n, rank) in a new order: head has q, n, rank; orders q and a list of ids. Unknown and repeated ids are dropped, ids that
    the order forgets follow in their old order: always the same rows. A query without an order keeps its own."""
    new = orders.select("q", F.posexplode("order").alias("place", "n")).groupBy("q", "n").agg(F.min("place").alias("place"))
    placed = head.join(new, ["q", "n"], "left")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("place").asc_nulls_last(), "rank"))
    return placed.select("q", "n", rank.alias("rank"), F.col("rank").alias("old_rank"))


def chain(ranked: DataFrame, rows: DataFrame, client: Callable[[str], str], model: str, known: DataFrame | None = None, head: int = USUAL.head) -> DataFrame:
    """(q, n, rank, old_rank, status): a ranking (q, n, rank) with the head of each query as an external model orders it. rows (n,
    patch_id, title, description, files) have the texts. Where the model fails or its reply can't be read the order stays as it was.
    """
    ids = rows.select(F.col("n"), "patch_id")
    named = ranked.select("q", "n", "rank").join(ids, "n").join(ids.select(F.col("n").alias("q"), F.col("patch_id").alias("source_patch_id")), "q")
    heads = named.where(F.col("rank") <= head).groupBy("q", "source_patch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "patch_id"))), lambda x: x["patch_id"]).alias("candidates"))
    heads = kept(heads, "heads")
    done = kept(rerank(payloads(heads, rows, head), client, model, known, head), "orders")
    of_query = heads.select("q", "source_patch_id")
    placed = done.where("order is not null").select(F.col("q").alias("source_patch_id"), F.posexplode("order").alias("place", "patch_id")).join(ids, "patch_id").join(of_query, "source_patch_id")
    orders = placed.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("order"))
    status = done.select(F.col("q").alias("source_patch_id"), "status").join(of_query, "source_patch_id").select("q", "status")
    return reordered(ranked.select("q", "n", "rank"), orders).join(status, "q", "left")


def rerank(asked: DataFrame, client: Callable[[str], str], model: str, known: DataFrame | None = None, head: int = USUAL.head) -> DataFrame:
    """(q, key, order, status, seconds) for rows with q, ids, prompt: orders known under the key of a row are taken, others asked for, in
    each partition with one client. Status is cached, ok, malformed or failed; only ok may be kept, so an outage is never cached.
    """
    keyed = asked.withColumn("key", order_key(F.lit(model), head, F.col("q"), F.col("ids")))
    out = "q string, key string, reply string, failed boolean, seconds double"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PROMPTS_STEP):  # few prompts at a time are objects, however many a batch has
                part, replies = b.slice(at, PROMPTS_STEP), []
                for p in part.column(2).to_pylist():
                    began = time.monotonic()
                    try:
                        replies.append((client(p), False, time.monotonic() - began))
                    except Exception:  # noqa: BLE001 - any outage leaves the order as it was
                        replies.append((None, True, time.monotonic() - began))
                answers = (pa.array([r[k] for r in replies], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.float64())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *answers], names=["q", "key", "reply", "failed", "seconds"])

    todo = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    answered = todo.select("q", "key", "prompt").mapInArrow(ask, out).withColumn("order", parsed_reply(F.col("reply")))
    status = F.when(F.col("failed"), F.lit("failed")).when(F.col("order").isNull(), F.lit("malformed")).otherwise(F.lit("ok"))
    fresh = answered.select("q", "key", "order", status.alias("status"), "seconds")
    return fresh if known is None else fresh.unionByName(keyed.select("q", "key").join(known.select("key", "order"), "key").select("q", "key", "order", F.lit("cached").alias("status"), F.lit(0.0).alias("seconds")))
