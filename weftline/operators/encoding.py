"""Encoders of patches: what makes a vector of a text."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import l2_normalised, payload, tokens


class Encoder(Protocol):
    name: str

    def encode(self, patches: DataFrame) -> DataFrame:
        """(patch_id, vector)."""


class Precomputed:
    """Vectors that are at hand, by patch_id; patches without one are left out."""

    name = "precomputed"

    def __init__(self, known: DataFrame):
        self.known = known

    def encode(self, patches: DataFrame) -> DataFrame:
        return patches.select("patch_id").join(self.known.select("patch_id", "vector"), "patch_id")


class Hashing:
    """Signed counts of words by hash, of length 1: the same everywhere, without a model. Texts without words are the zero vector."""

    def __init__(self, size: int = 64):
        self.size, self.name = size, f"hashing-{size}"

    def encode(self, patches: DataFrame) -> DataFrame:
        words = patches.select("patch_id", F.explode_outer(tokens(payload(F.col("title"), F.col("description")))).alias("w"))
        h = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long")
        cells = words.select("patch_id", F.pmod(h, F.lit(self.size)).cast("int").alias("cell"), F.when(F.shiftright(h, 16) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"), F.col("w"))
        sums = cells.groupBy("patch_id", "cell").agg(F.sum(F.when(F.col("w").isNotNull(), F.col("sign")).otherwise(0.0)).alias("x"))
        by_cell = sums.groupBy("patch_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "x")))).alias("m"))
        full = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
        return by_cell.select("patch_id", l2_normalised(full).alias("vector"))
