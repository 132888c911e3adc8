"""Joins and filters by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros

DAY = 86_400_000_000


def within(a: Column, b: Column, days: float) -> Column:
    """Whether two times are at most so many days apart; always where days is 0."""
    return F.lit(True) if not days else F.abs(micros(a) - micros(b)) <= int(days * DAY)


#: Buckets to a window: more of them make a task's share of the right side smaller, and copies of the left side more.
BUCKETS = 8


def bucketed(rows: DataFrame, time: str, days: float, around: bool = False) -> DataFrame:
    """rows with a bucket of time, a fraction of the window wide; with around once for every bucket that its window reaches."""
    width = max(1, int(days * DAY) // BUCKETS)
    reach = -(-int(days * DAY) // width)
    own = F.floor(micros(F.col(time)) / F.lit(width))
    return rows.withColumn("bucket", F.explode(F.sequence(own - reach, own + reach)) if around else own)


def band_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, days: float) -> DataFrame:
    """Pairs of rows whose times are at most so many days apart.

    An equi-join on time buckets of an eighth of the window: a row on the left, the smaller side, stands in every bucket that its
    window reaches, a row on the right in its own, so no pair comes up twice and few are tried that are further apart.
    """
    pairs = bucketed(left, left_time, days, around=True).join(bucketed(right, right_time, days), "bucket")
    return pairs.where(within(F.col(left_time), F.col(right_time), days)).drop("bucket")


#: Rows of a run, of a share of a bucket on the right and on the left, and pairs of a task, about.
RUN_ROWS, RIGHT_ROWS, LEFT_ROWS, TASK_PAIRS = 256, 8_192, 65_536, 100_000_000


def candidates(queries: DataFrame, rows: DataFrame, days: float, apart: str | None = None, larger: bool = False, gaps: bool = False) -> DataFrame:
    """(q, n): for each query all other rows in its window; with gaps also how far apart both are (apart_micros). Both have n and created_time. With
    apart, a column of both with arrays, pairs that have one of these in common are left out; with larger those whose n is
    not the larger number.

    Rows of a bucket of time are dealt into shares, and these into runs of equal length. A merge join gives a run to all queries of its
    bucket one after another, those of a time together. So pairs come as runs that repeat, at places that an encoding in groups of eight
    finds again, and a compressed file holds them in a small share of what long ones take; a pair is no row before it is written.
    Shares are bounded on both sides, and there are as many tasks as their pairs ask for.
    """
    span, spark = int(days * DAY), rows.sparkSession
    marks = F.col(apart) if apart else F.array().cast("array<bigint>")
    of = lambda df, key, around: bucketed(df.select(F.col("n").alias(key), micros(F.col("created_time")).alias(f"{key}_at"), "created_time", marks.alias(f"{key}_marks")), "created_time", days, around).drop("created_time")
    q, c = of(queries, "q", True), of(rows, "n", False)
    count = lambda df, name: df.groupBy("bucket").agg(F.count("*").alias(name))
    sizes = count(q, "left").join(count(c, "right"), "bucket")  # not kept: a query's result would be stored for it
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((sizes.agg(F.sum(F.col("left") * F.col("right"))).first()[0] or 0) // TASK_PAIRS))
    parts = sizes.select("bucket", F.ceil(F.col("left") / F.lit(LEFT_ROWS)).cast("int").alias("of_a"), F.ceil(F.col("right") / F.lit(RIGHT_ROWS)).cast("int").alias("of_b"))
    share = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    by = ["bucket", "a", "b"]
    left = q.join(parts, "bucket").withColumn("a", share("q", "of_a")).withColumn("b", every("of_b")).drop("of_a", "of_b")
    left = left.repartition(tasks, *by).sortWithinPartitions(*by, "q_at", "q")
    # Rows of a share in the order of time, or of their numbers where these decide, cut into runs.
    row = F.struct("n", "n_at", "n_marks") if larger else F.struct("n_at", "n", "n_marks")
    whole = c.join(parts, "bucket").groupBy("bucket", share("n", "of_b").alias("b"), "of_a").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(RUN_ROWS))
    runs = whole.select("bucket", "b", every("of_a").alias("a"), F.transform(starts, lambda i: F.slice("rows", i, RUN_ROWS)).alias("runs")).withColumn("rows", F.explode("runs"))
    runs = runs.select(*by, "rows", F.col("rows.n").alias("numbers"), F.array_min("rows.n_at").alias("first"), F.array_max("rows.n_at").alias("last"), F.array_min("rows.n").alias("least"), F.array_max("rows.n").alias("most"), F.flatten("rows.n_marks").alias("marks"))
    runs = runs.repartition(tasks, *by).sortWithinPartitions(*by, "first", "least")
    met = runs.hint("merge").join(left, by)
    near = lambda at: F.abs(F.col("q_at") - at) <= span if days else F.lit(True)
    if days:
        met = met.where((F.col("first") - F.col("q_at") <= span) & (F.col("q_at") - F.col("last") <= span))
    # Most runs are taken whole; of the others each row is looked at.
    whole, fits = near(F.col("first")) & near(F.col("last")), lambda r: near(r["n_at"]) & (r["n"] != F.col("q"))
    if larger:
        met = met.where(F.col("most") > F.col("q"))
        whole, fits = whole & (F.col("least") > F.col("q")), lambda r: near(r["n_at"]) & (r["n"] > F.col("q"))
    else:
        whole = whole & ((F.col("q") < F.col("least")) | (F.col("q") > F.col("most")) | ~F.array_contains("numbers", F.col("q")))
    if apart:
        usual = (F.size("q_marks") == 1) & ~F.array_contains("marks", F.get("q_marks", F.lit(0)))
        whole, its = whole & usual, fits
        fits = lambda r: its(r) & ~F.arrays_overlap("q_marks", r["n_marks"])
    some = F.filter("rows", fits)
    if not gaps:
        return met.select("q", F.explode(F.when(whole, F.col("numbers")).otherwise(F.transform(some, lambda r: r["n"]))).alias("n"))
    found = met.select("q", "q_at", F.inline(F.when(whole, F.col("rows")).otherwise(some)))
    return found.select("q", "n", F.abs(F.col("q_at") - F.col("n_at")).alias("apart_micros"))


def top(rows: DataFrame, k: int, score: str = "score", by: str | list[str] = "q", tie: str = "n", rank: str = "rank") -> DataFrame:
    """The k best of each query, ranked from 1: by score to nine places, then by the smaller candidate."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), tie)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def permuted(rows: DataFrame, seed: int, by: str = "q", item: str = "n", place: str = "place") -> DataFrame:
    """rows with a place from 1 in a random order of each group, the same for the same seed: by MD5 of seed, group and item."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string"), F.col(item).cast("string")).cast("binary"))
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(h, item)))
