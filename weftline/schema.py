"""Shapes of tables, and the patch view over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import kept

PATCH_CSV = "patch_id string, title string, description string, created_time timestamp_ntz, files string, author_name string, author_email string, author_username string, change_log string, comments string"
HAND_OFF = "source_patch_id string, candidates array<string>, reachable_targets array<string>, n_targets_total int, window_days int, top_k int, llm_applied boolean"
SIDECAR = "patch_id string, title string, description string, files array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_view(table(spark, sf_dir, "documents"))


def patch_view(docs: DataFrame, *more: str) -> DataFrame:
    """Documents as patches: patch_id, title, description, created_time, files; n is the document's number. More columns may follow."""
    return docs.where("doc_id is not null and text is not null").selectExpr(
        "doc_id as n",
        "cast(doc_id as string) as patch_id",
        "substring_index(text, '\\n', 1) as title",
        "concat(if(instr(text, '\\n') > 0, replace(substr(text, instr(text, '\\n') + 1), '\\n', ' '), ''), ' BUG-', 1000 + doc_id % 97) as description",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 7919 % 43200 as int)) as created_time",
        "transform(sequence(0, cast(doc_id % 4 as int)), i -> concat('mod', (doc_id + i * i) % 13, '/sub', (doc_id * 3 + i) % 5, '/f', (doc_id * 7 + i * 11) % 23, '.py')) as files",
        *more,
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that have a vector, with it."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("vector"))
    return patches(spark, sf_dir).join(vectors, "n")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of patches of equal text: source, target. Groups are joined by a digest of the text."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("sha"))
    shared = docs.groupBy("sha").agg(F.count("*").alias("size")).where("size > 1").select("sha")
    some = docs.join(shared, "sha")
    return some.select(F.col("id").alias("source"), "sha").join(some.select(F.col("id").alias("target"), "sha"), "sha").where("source != target").select("source", "target")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, created_time, files, digest) of patches whose text others have too. Those of one digest are linked by ground_truth(), each with each;
    here a patch is one row, however many copies it has."""
    each = kept(patch_view(table(spark, sf_dir, "documents"), "unhex(sha2(text, 256)) as digest").select("n", "created_time", "files", "digest"), "digests")
    return each.join(each.groupBy("digest").agg(F.count("*").alias("size")).where("size > 1").select("digest"), "digest", "left_semi").select("n", "created_time", "files", "digest")


def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, digests): for each patch the digest of its text, or all of them where a number comes with several texts. Two patches of
    unlike number are linked by ground_truth() where they have a digest in common."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    return docs.groupBy(F.col("doc_id").alias("n")).agg(F.collect_set(F.unhex(F.sha2("text", 256))).alias("digests"))


#: The same in DuckDB: common table expressions that the oracles start with.
SQL = r"""
p as (
  select doc_id as n, cast(doc_id as varchar) as patch_id, split_part(text, chr(10), 1) as title,
    case when instr(text, chr(10)) > 0 then replace(substr(text, instr(text, chr(10)) + 1), chr(10), ' ') else '' end || ' BUG-' || (1000 + doc_id % 97) as description,
    timestamp '2024-01-01 00:00:00' + to_minutes(doc_id * 7919 % 43200) as created_time,
    list_transform(range(0, doc_id % 4 + 1), lambda i: 'mod' || ((doc_id + i * i) % 13) || '/sub' || ((doc_id * 3 + i) % 5) || '/f' || ((doc_id * 7 + i * 11) % 23) || '.py') as files
  from documents where text is not null
), e as (
  select p.*, cast(embedding as double[]) as vector from p join embeddings on vec_id = n
), gt as (
  select cast(a.doc_id as varchar) as source, cast(b.doc_id as varchar) as target from documents a join documents b on a.text = b.text and a.doc_id <> b.doc_id
)"""
