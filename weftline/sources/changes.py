"""Changes from a review system: its REST replies, and a tree of JSON files for each change, made into patches and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import without_messages, without_prefix

REVISIONS = "map<string, struct<_number: int, commit: struct<message: string>, files: map<string, string>>>"


def normalised(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Patches from REST replies, with all other columns: title, description (the last revision's message, else the title),
    created_time, files (the first revision's, else the last's). What isn't a reply has null in all of them."""
    plain = without_prefix(F.col(text))
    body = F.from_json(F.when(F.try_parse_json(plain).isNotNull(), plain), f"struct<subject: string, created: string, revisions: {REVISIONS}>")
    with_body = replies.withColumn("body", body).withColumn("sorted", F.array_sort(F.map_values("body.revisions"), lambda a, b: a["_number"] - b["_number"]))
    first, last = F.get("sorted", F.lit(0)), F.get("sorted", F.size("sorted") - 1)
    files = F.coalesce(F.map_keys(F.when(first["_number"] == 1, first["files"])), F.map_keys(last["files"]), F.array().cast("array<string>"))
    return with_body.select(
        *[c for c in replies.columns if c != text],
        F.col("body.subject").alias("title"),
        F.coalesce(F.nullif(last["commit"]["message"], F.lit("")), F.col("body.subject")).alias("description"),
        F.try_to_timestamp(F.substring(F.col("body.created"), 1, 19)).cast("timestamp_ntz").alias("created_time"),
        F.when(F.col("body").isNotNull(), F.array_sort(without_messages(files))).alias("files"),
    )


class Client:
    """Looks single changes up; get takes an address and gives the reply's text or raises."""

    def __init__(self, hosts: dict[str, str], get: Callable[[str], str]):
        self.hosts, self.get = hosts, get

    def fetch(self, project: str, number: str) -> str | None:
        """The reply for a change, None where the host fails; ValueError for an unknown project."""
        if project not in self.hosts:
            raise ValueError(f"unknown project: {project}")
        try:
            return self.get(f"{self.hosts[project]}/changes/{number}/detail?o=ALL_REVISIONS&o=ALL_FILES&o=ALL_COMMITS")
        except OSError:
            return None


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(project, dir, kind, body) of <root>/<project>/<change>/<kind>.json."""
    files = spark.read.text(f"{root}/*/*/*.json", wholetext=True).withColumn("path", F.input_file_name())
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return files.select(part(-3).alias("project"), part(-2).alias("dir"), F.regexp_replace(part(-1), r"\.json$", "").alias("kind"), F.col("value").alias("body"))


def extracted(files: DataFrame) -> DataFrame:
    """Patches from a tree: patch_id, change_id, title, description, created_time, files, author_*, change_log, comments. Changes
    whose metadata don't parse are left out; of patch sets the first counts, else the lowest."""
    meta = "struct<_number: bigint, change_id: string, subject: string, commit_message: string, timestamps: struct<created: string>, created: string, accounts: struct<owner: struct<name: string, email: string, username: string>>, change_log: struct<entries: string>>"
    kinds = files.groupBy("project", "dir").pivot("kind", ["metadata", "patchsets", "comments", "linkages"]).agg(F.first("body"))
    m = kinds.withColumn("m", F.from_json("metadata", meta)).where("m is not null and try_parse_json(metadata) is not null")
    one = "struct<patchset_number: int, modified_file_paths: array<string>>"
    sets = F.coalesce(F.from_json("patchsets", f"array<{one}>"), F.array(F.from_json("patchsets", one)))
    number = lambda s: F.coalesce(s["patchset_number"], F.lit(2**31 - 1))
    chosen = F.get(F.array_sort(F.filter(sets, lambda s: s.isNotNull()), lambda a, b: F.signum(number(a).cast("double") - number(b)).cast("int")), F.lit(0))
    title = F.coalesce("m.subject", F.lit(""))
    return m.select(
        "project", "dir",
        F.coalesce(F.col("m._number").cast("string"), F.nullif("m.change_id", F.lit("")), F.col("dir")).alias("patch_id"),
        F.col("m.change_id").alias("change_id"), title.alias("title"), F.coalesce(F.nullif("m.commit_message", F.lit("")), title).alias("description"),
        F.coalesce(F.nullif("m.timestamps.created", F.lit("")), F.nullif("m.created", F.lit(""))).alias("created_time"),
        F.coalesce(without_messages(chosen["modified_file_paths"]), F.array().cast("array<string>")).alias("files"),
        *(F.coalesce(f"m.accounts.owner.{k}", F.lit("")).alias(f"author_{k}") for k in ("name", "email", "username")),
        F.coalesce("m.change_log.entries", F.lit("[]")).alias("change_log"), F.coalesce("comments", F.lit("{}")).alias("comments"), "linkages",
    )


def flat_comments(changes: DataFrame) -> DataFrame:
    """(patch_id, part, comment) of change_comments and inline_comments, which are lists, one object, or lists by file."""
    parts = changes.select("patch_id", F.explode(F.from_json("comments", "map<string,string>")).alias("part", "body"))
    listed = F.from_json("body", "array<string>")
    by_file = F.flatten(F.transform(F.map_values(F.from_json("body", "map<string,string>")), lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array(v))))
    return parts.where("part in ('change_comments', 'inline_comments')").select("patch_id", "part", F.explode(F.coalesce(listed, by_file)).alias("comment"))


def links_of(changes: DataFrame) -> DataFrame:
    """(patch_id, number, change_id) of a tree's linkages."""
    one = "array<struct<changeNumber: bigint, changeId: string>>"
    return changes.select("patch_id", F.explode(F.from_json("linkages", one)).alias("l")).select("patch_id", F.col("l.changeNumber").cast("string").alias("number"), F.col("l.changeId").alias("change_id"))


def resolved(links: DataFrame, patches: DataFrame) -> DataFrame:
    """links with target, via (number or change_id) and reason: by number, else by change id; target_unknown where the link names
    a change that isn't among the patches, unresolvable where it names none, self for a link of a patch with itself, else ok."""
    by_number = patches.select(F.col("patch_id").alias("number"), F.col("patch_id").alias("t1"))
    by_change = patches.where("change_id is not null").groupBy("change_id").agg(F.min("patch_id").alias("t2"))
    both = links.join(by_number, "number", "left").join(by_change, "change_id", "left").withColumn("target", F.coalesce("t1", "t2"))
    named = F.coalesce(F.col("number"), F.nullif("change_id", F.lit(""))).isNotNull()
    reason = F.when(F.col("target") == F.col("patch_id"), F.lit("self")).when(F.col("target").isNotNull(), F.lit("ok")).when(named, F.lit("target_unknown")).otherwise(F.lit("unresolvable"))
    via = F.when(F.col("t1").isNotNull(), F.lit("number")).when(F.col("t2").isNotNull(), F.lit("change_id"))
    return both.select("patch_id", "number", "change_id", "target", via.alias("via"), reason.alias("reason"))


def link_stats(resolved_links: DataFrame, patches: DataFrame) -> DataFrame:
    """One row of counters: of changes with a file of links, and without any in it; of links by what became of them, those kept
    by what they were found by."""
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    kept = lambda v: F.count_if((F.col("reason") == "ok") & (F.col("via") == v)).alias(f"via_{v}")
    seen = resolved_links.agg(F.count("*").alias("links"), *(count(r) for r in ("ok", "self", "target_unknown", "unresolvable")), *(kept(v) for v in ("number", "change_id")), F.count_distinct(F.when(F.col("reason") == "ok", F.struct("patch_id", "target"))).alias("distinct_links"), F.count_distinct("patch_id").alias("sources"))
    some = F.col("linkages").isNotNull()
    none = F.coalesce(F.size(F.from_json("linkages", "array<string>")), F.lit(0)) <= 0
    changes = patches.agg(F.count("*").alias("patches"), F.count_if(some).alias("with_file"), F.count_if(some & none).alias("with_no_links"))
    return seen.crossJoin(changes)  # one row each
