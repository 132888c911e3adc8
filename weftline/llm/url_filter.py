"""URL filters: stated rules on hosts and paths, and rules mined by FP-growth from labelled URLs.

A URL is a set of typed tokens (scheme, host labels and their words, path words, query keys). Frequent sets that hold a label give
rules from token combinations to the label, pruned by support, confidence and redundancy. Rules are found for a URL through an
inverted index: each rule is listed under the rarest of its tokens, and the best rule whose tokens the URL has all decides. The index
is sent to all tasks while it is small; beyond, rules and distinct sets of tokens are shuffled and meet at those tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, parts, table, tidied, written

#: Rules that are sent to all tasks, at most; of more, sets of tokens and rules meet in parts of so many of either, at most.
MOST_RULES, PART_SETS, PART_RULES = 20_000, 20_000, 20_000
#: Frequent tokens that are broadcast, at most; beyond, both sides are shuffled.
MOST_BROADCAST = 200_000
LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What lies between the first :// and the next of / ? #, with A-Z in lower case; empty without :// or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? or #; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct typed tokens of a URL; none without :// or for null. Numbers in paths and hosts count as one token each kind."""

    def typed(kind: str, words: Column) -> Column:
        return F.transform(F.array_remove(F.array_distinct(words), ""), lambda w: F.concat(F.lit(f"{kind}:"), w))

    def worded(text: Column) -> Column:
        return F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[^\\p{L}\\p{M}0]+")

    name = F.regexp_replace(F.regexp_replace(host(url), "^.*@", ""), ":[0-9]*$", "")
    asked = F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1)
    keys = F.transform(F.split(asked, "[&;]"), lambda kv: F.lower(F.regexp_extract(kv, "^([^=]*)", 1)))
    labels = F.split(name, "\\.")
    kinds = [typed("scheme", F.array(F.lower(F.regexp_extract(url, "^(.*?)://", 1)))), typed("label", labels), typed("ending", F.slice(labels, -1, 1)), typed("word", worded(name)), typed("path", worded(path(url))), typed("query", keys)]
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(F.concat(*kinds))).otherwise(F.array().cast("array<string>"))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and ruled: of the rules (verdict, host, path) that fit, the longest, written as host and path, and
    its verdict; null where none fits. A rule fits its host and all subdomains where the URL's path begins with its path.

    rules is a short stated list: it becomes one conditional expression. Null and odd URLs have an empty host, which no rule fits.
    Columns of these names are replaced; all other columns stay.
    """
    out = pages.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    rule = verdict = None
    for says, at, under in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]))):
        fits = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(under)
        rule = F.when(fits, at + under) if rule is None else rule.when(fits, at + under)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return out.withColumns({"rule": nothing if rule is None else rule, "ruled": nothing if verdict is None else verdict})


def transactions(labelled: DataFrame, min_support: float) -> tuple[DataFrame, DataFrame]:
    """From labelled (url, label): sets of items, each with its label's item, and the items: item, tokens, n (URLs that have it) and
    only (the one label that all of these have, or null).

    Items are the tokens that at least a share of min_support of the URLs have, but not all. Tokens that always come together are
    one item, so a URL repeated in a third of the rows doesn't make a set for each combination of its tokens. Items of one label are
    a rule each that no further item makes surer, so the sets are made without them; all other items of a URL are in its set.
    """
    rows = written(labelled.where("label is not null").select(tokens(F.col("url")).alias("tokens"), "label", F.monotonically_increasing_id().alias("row")), "labelled")
    total = rows.count()
    each = rows.select("row", "label", F.explode("tokens").alias("token"))
    prints = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"print{k}") for k in (0, 1)]  # which rows have a token
    per_token = each.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("first label"), F.max("label").alias("last label"), *prints)
    frequent = per_token.where((F.col("n") >= min_support * total) & (F.col("n") < total))
    only = F.when(F.min("first label") == F.max("last label"), F.min("first label"))
    grouped = frequent.groupBy("n", "print0", "print1").agg(F.array_sort(F.collect_set("token")).alias("tokens"), only.alias("only"))
    items = written(grouped.select(F.element_at("tokens", 1).alias("item"), "tokens", "n", "only"), "items")
    few = items.count() <= MOST_BROADCAST
    seen = items.where("only is null").select(F.col("item").alias("token"), "item")  # one token stands for all that come with it
    met = each.join(F.broadcast(seen) if few else seen, "token")
    sets = met.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    sets = rows.select("row", "label").join(sets, "row", "left")
    return sets.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit(LABEL), "label"))).alias("items")), items


@tidied
def mined(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """Rules from labelled (url, label), both strings: tokens (the rarest first), label, confidence, support.

    Support is the share of all labelled URLs that have the tokens and the label, confidence the share of the label among those that
    have the tokens. Left out are rules of less than these, and rules from which a token can be taken without loss of confidence. Null
    labels aren't learnt from; null URLs have no tokens but count. Equal rows count each. Without labelled rows there are no rules.
    """
    spark = labelled.sparkSession
    schema = "tokens array<string>, label string, confidence double, support double"
    sets, items = transactions(labelled, min_support)
    sets = written(sets, "sets")
    total = sets.count()
    if not total:
        return spark.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=parts(spark)).fit(sets).associationRules
    to_label = found.where(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda i: i.startswith(LABEL)))
    label = F.substr(F.col("consequent")[0], F.lit(len(LABEL) + 1))
    alone = items.where("only is not null").select(F.array("item").alias("items"), F.col("only").alias("label"), F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    rules = written(to_label.select(F.array_sort("antecedent").alias("items"), label.alias("label"), "confidence", "support").unionByName(alone), "rules")
    one_less = F.transform(F.col("items"), lambda i: F.array_remove("items", i))
    wider = rules.where(F.size("items") > 1).select("items", "label", "confidence", F.explode(one_less).alias("wider"))
    surer = rules.select(F.col("items").alias("wider"), "label", F.col("confidence").alias("its confidence"))
    needless = wider.join(surer, ["wider", "label"]).where(F.col("its confidence") >= F.col("confidence")).select("items", "label")
    kept = rules.join(needless, ["items", "label"], "left_anti")
    # An item stands for all tokens that always came with it; the rarest item's come first.
    whole = kept.select("items", "label", "confidence", "support", F.explode("items").alias("item")).join(items.select("item", "tokens", "n"), "item")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "item", "tokens"))), lambda x: x["tokens"]))
    return whole.groupBy("items", "label", "confidence", "support").agg(listed.alias("tokens")).select("tokens", "label", "confidence", "support")


def index_of(rules: DataFrame) -> tuple[list, dict]:
    """The model that judges: rules (tokens, label, confidence) in order of preference - surer, then better supported, then of more
    tokens - and for each token the places of the rules whose rarest token it is. All rules pass the driver: judged_by() takes this
    way for MOST_RULES at most."""
    order = [F.desc("confidence"), F.desc("support"), F.desc(F.size("tokens")), "label", "tokens"]
    best = [(r["tokens"], r["label"], r["confidence"]) for r in rules.orderBy(*order).collect()]
    return best, _listed(best)


def _listed(rules: list) -> dict[str, list[int]]:
    """For each token the places of the rules whose first, rarest token it is."""
    index: dict[str, list[int]] = {}
    for k, (of, *_) in enumerate(rules):
        index.setdefault(of[0], []).append(k)
    return index


def looked_up(have: list[str], rules: list, index: dict) -> int | None:
    """The place of the first rule whose tokens are all there."""
    all_of, best = set(have), None
    for token in have:
        for k in index.get(token, ()):
            if best is not None and k > best:
                break
            if all_of.issuperset(rules[k][0]):
                best = k
                break
    return best


def judged(pages: DataFrame, model: tuple[list, dict], default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with mined_verdict, mined_rule (its tokens, blanks between; null if none fits) and confidence (null then).

    The verdict is the label of the best rule that fits, or default. Every row keeps its place and columns; those of these names are
    replaced. Null and odd URLs have no tokens and get the default. There is no shuffle.
    """
    rules, index = model
    others = [f for f in pages.schema.fields if f.name not in ("mined_verdict", "mined_rule", "confidence")]
    rows = pages.select(tokens(F.col(url_col)).alias("its tokens"), F.struct(*(F.col(f"`{f.name}`") for f in others)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [looked_up(have, rules, index) for have in b.column(0).to_pylist()]
            columns = [
                pa.array([default if k is None else rules[k][1] for k in at], pa.string()),
                pa.array([None if k is None else " ".join(rules[k][0]) for k in at], pa.string()),
                pa.array([None if k is None else rules[k][2] for k in at], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, b.column(1)], names=["mined_verdict", "mined_rule", "confidence", "row"])

    schema = T.StructType([T.StructField("mined_verdict", T.StringType()), T.StructField("mined_rule", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("row", T.StructType(others))])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col("row").getField(f.name).alias(f.name) for f in others), "mined_verdict", "mined_rule", "confidence")


@tidied
def best_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(its tokens, label, tokens, confidence): for each of the distinct sets (its tokens) that any rule fits, the best one of rules
    (tokens, label, confidence, support), in the order of index_of().

    Sets and rules meet at the rarest token of a rule, in parts that are bounded on both sides; a part hands on one rule for each
    set at most, so pairs of sets and rules are no rows.
    """
    sets = written(sets.select(F.monotonically_increasing_id().alias("set"), "its tokens"), "sets")
    left = sets.select("set", "its tokens", F.explode("its tokens").alias("token"))
    right = rules.select("tokens", "label", "confidence", "support", F.get("tokens", F.lit(0)).alias("token"))
    count = lambda df, name, most: df.groupBy("token").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    sizes = written(count(left, "of_a", PART_SETS).join(count(right, "of_b", PART_RULES), "token"), "sizes")
    share = lambda of, *c: F.pmod(F.xxhash64(*c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = left.join(sizes, "token").withColumn("a", share("of_a", "set")).withColumn("b", every("of_b")).drop("of_a", "of_b")
    right = right.join(sizes, "token").withColumn("b", share("of_b", "tokens", "label")).withColumn("a", every("of_a")).drop("of_a", "of_b")
    schema = pa.schema([("set", pa.int64()), ("label", pa.string()), ("tokens", pa.list_(pa.string())), ("confidence", pa.float64()), ("support", pa.float64())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        columns = (b[c].to_pylist() for c in ("tokens", "label", "confidence", "support"))
        best = sorted(zip(*columns, strict=True), key=lambda r: (-r[2], -r[3], -len(r[0]), r[1], r[0]))
        index, found = _listed(best), []
        for batch in a.select(["set", "its tokens"]).to_batches(max_chunksize=1_000):
            for of, have in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (k := looked_up(have, best, index)) is not None:
                    found.append({"set": of, "tokens": best[k][0], "label": best[k][1], "confidence": best[k][2], "support": best[k][3]})
        return pa.Table.from_pylist(found, schema)

    by = ("token", "a", "b")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "set bigint, label string, tokens array<string>, confidence double, support double")
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("tokens"), F.col("label"), F.col("tokens"))
    first = found.groupBy("set").agg(F.min_by(F.struct("label", "tokens", "confidence"), order).alias("rule"))
    return sets.join(first, "set").select("its tokens", "rule.label", "rule.tokens", "rule.confidence")


def judged_by(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """As judged(), by all of the rules (tokens, label, confidence, support), however many. Few are sent to all tasks; of many,
    each distinct set of tokens is judged once, and pages are joined with their sets."""
    if rules.limit(MOST_RULES + 1).count() <= MOST_RULES:
        return judged(pages, index_of(rules), default, url_col)
    others = [c for c in pages.columns if c not in ("mined_verdict", "mined_rule", "confidence")]
    rows = pages.select(F.array_sort(tokens(F.col(url_col))).alias("its tokens"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    found = rows.join(best_rules(rows.select("its tokens").distinct(), rules), "its tokens", "left")
    return found.select(*(F.col("row").getField(c).alias(c) for c in others), F.coalesce("label", F.lit(default)).alias("mined_verdict"), F.array_join("tokens", " ").alias("mined_rule"), "confidence")


#: The rules of the query: verdict, host, path.
STATED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; URLs that the stated rules decide are the labelled ones that the others' rules are mined from."""
    pages = ruled(table(spark, sf_dir, "pages").select("page_id", "url"), STATED)
    rules = mined(pages.where("ruled is not null").select("url", F.col("ruled").alias("label")))
    out = judged_by(pages, rules)
    dropped(rules)
    own = F.col("ruled").isNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "mined_verdict").alias("verdict"), F.when(own, F.col("mined_rule")).alias("mined_rule"), F.when(own, F.col("confidence")).alias("confidence"))
