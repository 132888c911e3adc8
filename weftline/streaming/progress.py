"""Progress of streams: what has been seen so far, with a running MRR, without a second pass over the rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.formats import progress

NAME = "running"


def observed(rows: DataFrame, reciprocal_rank: str = "reciprocal_rank") -> DataFrame:
    """rows, each micro-batch of which reports its count, its sum of reciprocal ranks and, where rows have a status and seconds of a
    call, how many were asked for, failed or found in the cache, and how long the calls took."""
    called = F.col("status") != "cached" if "status" in rows.columns else F.lit(False)
    failed = F.col("status") == "failed" if "status" in rows.columns else F.lit(False)
    cached = F.col("status") == "cached" if "status" in rows.columns else F.lit(False)
    seconds = F.when(called, F.col("seconds")) if "seconds" in rows.columns else F.lit(None).cast("double")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.observe(NAME, F.count(F.lit(1)).alias("n"), total(reciprocal_rank).alias("rr"), F.count_if(called).alias("calls"), F.count_if(failed).alias("failed"), F.count_if(cached).alias("cached"), total(seconds).alias("seconds"))


class Progress(StreamingQueryListener):
    """Adds up what observed() streams report and says so after each micro-batch. Six numbers are held, however long a stream runs."""

    def __init__(self, total: int | None = None, say: Callable[[str], None] = print):
        self.total, self.say, self.began = total, say, time.monotonic()
        self.spark = SparkSession.active()  # reports come in a thread that has none
        self.seen: dict[str, float] = dict.fromkeys(("n", "rr", "calls", "failed", "cached", "seconds"), 0)

    @property
    def n(self) -> int:
        return self.seen["n"]

    @property
    def mrr(self) -> float | None:
        return self.seen["rr"] / self.n if self.n else None

    def line(self) -> str:
        """What progress() makes of the numbers."""
        s, now = self.seen, time.monotonic() - self.began
        values = [s["n"], self.total, self.mrr, now, s["calls"], s["failed"], s["cached"], float(s["seconds"])]
        kinds = ["long", "long", "double", "double", "long", "long", "long", "double"]
        shown = progress(*(F.lit(v).cast(k) for v, k in zip(values, kinds, strict=True)))
        return self.spark.range(1).select(shown).first()[0]

    def onQueryStarted(self, event) -> None:
        self.began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(NAME)
        if found is not None:
            self.seen = {k: v + found[k] for k, v in self.seen.items()}
            self.say(self.line())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
