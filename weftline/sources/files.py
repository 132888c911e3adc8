"""Reading and writing of patches, links, hand-off rows and texts; all with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_list, ticket_refs
from ..schema import HAND_OFF, PATCH_CSV, SIDECAR

_CSV = {"header": "true", "multiLine": "true", "escape": '"'}


def read_patches(spark: SparkSession, path: str, tickets: bool = False) -> DataFrame:
    """Patches from CSV: rows without id or time are dropped, texts that are null are empty, file lists parsed."""
    raw = spark.read.options(**_CSV).schema(PATCH_CSV).csv(path)
    return cleaned(raw, tickets)


def cleaned(raw: DataFrame, tickets: bool = False) -> DataFrame:
    out = raw.dropna(subset=["patch_id", "created_time"]).fillna("", subset=["title", "description"]).withColumn("files", parse_list(F.col("files")))
    return out.withColumn("tickets", ticket_refs(F.concat_ws(" ", "title", "description"))) if tickets else out


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) from CSV, whatever its first two columns are called, or from a JSON list of pairs or objects."""
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", "array<string>")).alias("x"))
        as_list = F.from_json("x", "array<string>")
        as_map = F.map_values(F.from_json("x", "map<string,string>"))
        both = F.coalesce(as_list, as_map)
        return rows.select(F.get(both, 0).alias("source"), F.get(both, 1).alias("target")).where("source is not null and target is not null")
    raw = spark.read.options(**_CSV).csv(path)
    a, b = raw.columns[:2]
    for names in (("source_patch_id", "target_patch_id"), ("patch_id", "related_patch_id")):
        if set(names) <= set(raw.columns):
            a, b = names
    return raw.select(F.col(f"`{a}`").cast("string").alias("source"), F.col(f"`{b}`").cast("string").alias("target"))


def read_hand_off(spark: SparkSession, path: str) -> DataFrame:
    """Hand-off rows from JSON lines; candidates are ids, or objects with one."""
    text = spark.read.text(path)
    return parsed_hand_off(text)


def parsed_hand_off(lines: DataFrame) -> DataFrame:
    row = F.from_json("value", HAND_OFF)
    rows = lines.where("trim(value) != ''").select(row.alias("r")).select("r.*")
    one = lambda c: F.coalesce(F.get_json_object(c, "$.patch_id"), c)
    return rows.withColumn("candidates", F.transform("candidates", one))


def needed_ids(hand_off: DataFrame) -> DataFrame:
    """Distinct ids of sources and candidates."""
    return hand_off.select(F.col("source_patch_id").alias("patch_id")).unionByName(hand_off.select(F.explode("candidates").alias("patch_id"))).distinct()


def hydrated(hand_off: DataFrame, patches: DataFrame) -> DataFrame:
    """The texts of all patches that hand-off rows need, each once, by id. Only the four columns are read."""
    texts = patches.select("patch_id", "title", "description", "files")
    return one_of_each(texts.join(needed_ids(hand_off), "patch_id", "left_semi"), "patch_id")


def one_of_each(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Of rows of one key the last by an order, as a lookup that is filled row by row ends up with; without an order the least by
    all other columns, so the same one each time."""
    others = [c for c in rows.columns if c != key]
    whole = F.struct(*others)
    pick = F.min(whole) if order is None else F.max_by(whole, F.struct(order, whole))
    return rows.groupBy(key).agg(pick.alias("picked")).select(key, *(F.col("picked")[c].alias(c) for c in others)).select(*rows.columns)


def missing(hand_off: DataFrame, texts: DataFrame) -> DataFrame:
    return needed_ids(hand_off).join(texts.select("patch_id"), "patch_id", "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Lists are written as JSON."""
    plain = [F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f.name) for f in df.schema.fields]
    df.select(*plain).write.options(header="true", escape='"').csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts by patch_id from JSON lines; FileNotFoundError, which says how they are made, where there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SIDECAR).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no texts at {path}: hydrated() makes them from hand-off rows, write_json() keeps them") from e


def cache_misses(patches: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Patches without a vector in the cache for their text and the model."""
    from ..operators.evaluation import fingerprint

    known = cache.where(F.col("model") == model).select("patch_id", "text_sha1")
    return fingerprint(patches).join(known, ["patch_id", "text_sha1"], "left_anti")
