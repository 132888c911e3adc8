"""Quality rules: decision lists learnt by sequential covering, and the statistics that they hold thresholds on.

Conjunctions of thresholds that cover low-quality rows are grown one condition at a time on one part of the labelled rows and
pruned on another; the rows that a finished rule covers are set aside and the next one is grown. The list becomes one ordered
conditional expression. All statistics and counts are Spark aggregates; the driver sees sums for each statistic and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, let, table, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Fewest words, and largest percentage of words in repeated windows, that a text may have.
LEAST_WORDS, MOST_REPEATED = 10, 20


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """How many of the words of an array lie in windows of n words that the array holds twice or more.

    Windows are told apart by 64-bit hashes. Where all differ, nothing else is done; else equal ones are brought together by a
    sort, and their places are merged in order: n log n in the number of words.
    """
    windows = F.when(F.size(w) > n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))

    def places(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True))
        return F.sort_array(F.transform(let(paired, twice), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x)

    return F.coalesce(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs the columns of keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and upper_chars.

    Null and empty texts have 0 of everything. Whole texts of any length are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    split = docs.select(*keep, text.alias("text of"), words(F.col(text_col)).alias("words of"), lines.alias("lines of"))
    w, t, ln = F.col("words of"), F.col("text of"), F.col("lines of")
    return split.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("long").alias("upper_chars"),
    )


#: What conditions are put on: shares of counts, so that they hold for texts of any length. In thousandths, or whole.
MEASURES = {
    "symbols per 1000 characters": lambda: 1000 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "repeated per 1000 words": lambda: 1000 * F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "capitals per 1000 characters": lambda: 1000 * F.col("upper_chars") / F.greatest(F.col("word_chars"), F.lit(1)),
    "characters per 1000 words": lambda: 1000 * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "words": lambda: F.col("n_words"),
    "repeated lines": lambda: F.col("n_dup_lines"),
}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: int

    def holds(self) -> Column:
        m = F.floor(MEASURES[self.measure]())
        return m >= self.threshold if self.above else m < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true where no rule rejects a row."""
    out = None
    for r in rules:
        out = F.when(covers(r), F.lit(False)) if out is None else out.when(covers(r), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(stats: DataFrame, label_col: str = "quality", bins: int = 24, least_precision: float = 0.8, least_rows: int = 5, least_share: float = 0.005) -> list[Rule]:
    """A decision list from statistics() with a label, 0 for low quality; rows without a label don't count.

    Two thirds of the rows, by a hash of their values, grow rules and the rest prune them. Candidate thresholds are the bounds
    of equal-frequency bins. A rule is grown until it covers rows of low quality alone or no condition gains anything. Covering goes
    on while a rule holds for least_rows rows and least_share of those of low quality, of all that it covers least_precision are of
    low quality, and of what it covers among the pruning rows, if anything, half. Ties go to the measure listed first, then the
    lower threshold. No labelled rows, or none of low quality: no rules.
    """
    names = list(MEASURES)
    rows = written(stats.where(F.col(label_col).isNotNull()).select((F.col(label_col) == 0).cast("int").alias("bad"), F.pmod(F.xxhash64(*[c for c in stats.columns]), F.lit(3)).alias("part"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper_chars"), "labelled")
    try:
        low = rows.where("bad = 1").count()
        if not low:
            return []
        quantiles = [(k + 1) / bins for k in range(bins - 1)]
        bounds_row = rows.agg(*(F.percentile_approx(F.floor(m()).cast("long"), quantiles, 10_000).alias(f"m{k}") for k, m in enumerate(MEASURES.values()))).first()
        bounds = [sorted({int(x) for x in bounds_row[f"m{k}"]} | {int(x) + 1 for x in bounds_row[f"m{k}"]}) for k in range(len(names))]
        spread = F.stack(F.lit(len(names)), *(x for k, m in enumerate(MEASURES.values()) for x in (F.lit(k), F.floor(m()).cast("long"))))

        def histogram(where: Column) -> list[dict[int, tuple[int, int]]]:
            """For each measure and bin the number of bad and of all rows; a bin is the number of bounds up to the value."""
            long = rows.where(where).select("bad", spread.alias("measure", "value"))
            bin_of = F.lit(0)
            cases = [F.when(F.col("measure") == k, F.size(F.filter(F.array(*map(F.lit, b)), lambda x: x <= F.col("value")))) for k, b in enumerate(bounds) if b]
            if cases:
                bin_of = F.coalesce(*cases, F.lit(0))
            out: list[dict[int, tuple[int, int]]] = [{} for _ in names]
            for r in long.groupBy("measure", bin_of.alias("bin")).agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect():
                out[r["measure"]][r["bin"]] = (r["bad"], r["n"])
            return out

        def counts(rule: Rule, where: Column) -> tuple[int, int]:
            r = rows.where(where & covers(rule)).agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
            return int(r[0]), int(r[1])

        rules: list[Rule] = []
        while True:
            left = verdict(rules)
            growing, pruning = left & (F.col("part") > 0), left & (F.col("part") == 0)
            rule: Rule = ()
            while True:
                hist = histogram(growing & covers(rule))
                all_bad, all_n = (sum(x[i] for x in hist[0].values()) for i in (0, 1))
                if not all_bad or all_bad == all_n:
                    break
                best, prior = None, math.log2(all_bad / all_n)
                for k, b in enumerate(bounds):
                    under_bad = under_n = 0
                    for j, t in enumerate(b):
                        bad, n = hist[k].get(j, (0, 0))
                        under_bad, under_n = under_bad + bad, under_n + n
                        for above, p, m in ((True, all_bad - under_bad, all_n - under_n), (False, under_bad, under_n)):
                            if p and m >= least_rows:
                                gain = p * (math.log2(p / m) - prior)  # FOIL's measure
                                if best is None or gain > best[0] + 1e-9:
                                    best = gain, Condition(names[k], above, t)
                if best is None or best[0] <= 1e-9:
                    break
                rule = (*rule, best[1])
            if not rule:
                break
            # Prune: drop last conditions while the worth on the pruning rows doesn't fall.
            worth = []
            for k in range(1, len(rule) + 1):
                p, n = counts(rule[:k], pruning)
                worth.append(((2 * p - n) / (n + 1), -k))
            rule = rule[: -max(worth)[1]]
            held, taken = counts(rule, pruning), counts(rule, left)
            if taken[1] < least_rows or taken[0] < least_share * low or taken[0] < least_precision * taken[1] or (held[1] and held[0] < 0.5 * held[1]):
                break
            rules.append(rule)
        return rules
    finally:
        dropped(rows)



def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """statistics() of docs with base_failed and kept, and the rules that were learnt from labels (id, quality).

    Statistics are made once and kept in the shared folder. Labels of one id that differ count each; labels without a document
    and documents without a label are of no account to learning.
    """
    stats = written(statistics(docs, text_col, (id_col,)), "statistics")
    known = labels.select(id_col, F.col("quality"))
    rules = learn(stats.join(known, id_col))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
