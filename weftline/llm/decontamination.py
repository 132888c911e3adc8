"""Benchmark decontamination by template canonicalisation, in DataFrame operations alone.

Numbers, units behind them and names become typed placeholders, so a question with other parameters keeps its template. A name
is a capitalised word; as words that begin sentences need not be names, texts meet in three forms (FORMS). Windows of five template words of every document meet those of the benchmark in a hash join. Where a match runs over
placeholders, the values in them have to map one to one within an occurrence, or the windows without placeholders have to suffice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidied, written

WINDOW = 5
#: Share of an item's windows, or words of one unbroken run, from which on a document holds the item.
LEAST_SHARE, LEAST_RUN = 0.5, 13
#: Windows of the benchmark, and documents whose values are compared, up to which they are sent to all executors: some 40 bytes
#: each. Beyond, both sides are shuffled.
MOST_BROADCAST = 500_000
#: Units that are a placeholder behind a number.
UNITS = (
    "kilometres", "kilometers", "kilograms", "kilogrammes", "centimetres", "centimeters", "millimetres", "millimeters", "metres", "meters", "grams", "litres", "liters", "miles", "inches", "feet", "yards", "pounds", "ounces", "dollars", "euros", "cents", "percent",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "degrees", "km", "kg", "cm", "mm", "ml", "mg", "mph", "kmh", "hz", "kb", "mb", "gb", "tb", "ft", "lb", "oz", "g", "m", "l", "s", "h",
)
#: Signs that are not part of a template word.
SIGNS = ".,;:!?\"'()[]{}#*$%&|<>"
#: Signs that are part of a word within it, and no word where they stand alone.
DASHES = "-–—"
_OPEN = re.escape(SIGNS)
#: What stands before a run of dashes is looked at only where there is one.
NO_WORD = f"[{_OPEN}]|[{DASHES}]++(?<![^{DASHES} {_OPEN}][{DASHES}]{{1,99}})(?![^ {_OPEN}])"


#: A capitalised word: "Anna", "O'Brien" and "Jean-Paul" are one each.
NAME = "(\\p{Lu}\\p{L}*(?:[-'’]\\p{Lu}\\p{L}*)*)"
#: What counts as a name: capitalised words behind a lower-case letter, comma, semicolon or placeholder and a blank; all capitalised
#: words, those that begin sentences too; none, for copies in another case.
FORMS = (f"(?<=[\\p{{Ll}},;⟩] ){NAME}", f"(?<!\\p{{L}}){NAME}", None)
WITHIN, ALL, NONE = range(len(FORMS))


def numbered(text: Column) -> Column:
    """The text with ⟨n:..⟩ and ⟨u:..⟩ around numbers and units, its white space as single blanks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[ ⟨⟩\\t\\n\\x0B\\f\\r]+", " ")
    numbers = F.regexp_replace(t, "([0-9]+([.,:/][0-9]+)*)", "⟨n:$1⟩")
    units = F.regexp_replace(numbers, f"(⟩ ?)({'|'.join(UNITS)})([^\\p{{L}}]|$)", "$1⟨u:$2⟩$3")
    return F.when(t.rlike("[0-9]"), units).otherwise(t)


def named(numbered_text: Column, form: int) -> Column:
    """A numbered text with ⟨p:..⟩ around the names of a form; its words stay as many."""
    return F.regexp_replace(numbered_text, FORMS[form], "⟨p:$1⟩") if FORMS[form] else numbered_text


def bare(numbered_text: Column) -> Column:
    """A numbered text without the values of its placeholders."""
    return F.when(F.contains(numbered_text, F.lit("⟨")), F.regexp_replace(numbered_text, "⟨(.):[^⟩]*⟩", "⟨$1⟩")).otherwise(numbered_text)


def marked(bare_text: Column) -> Column:
    """The words of a bare text, without case and signs; names within sentences as ⟨qname⟩, other capitalised words as ⟨pword⟩, so
    that one split serves all forms. What is empty without its signs is no word: a sign that stands alone, or white space at the
    text's ends, doesn't part words that follow each other."""
    every = F.regexp_replace(bare_text, FORMS[ALL], "⟨p$1⟩")
    within = F.regexp_replace(every, "⟨p(?<=[\\p{Ll},;]⟩? ⟨p)", "⟨q")  # as FORMS[WITHIN] has it
    return F.array_remove(F.split(F.regexp_replace(F.lower(within), NO_WORD, ""), " "), "")


def hashed(words: Column) -> Column:
    """For each marked word a struct of its hash in each form; null where that is the first one's."""

    def forms(w: Column) -> Column:
        same = F.struct(*((F.xxhash64(w) if k == 0 else F.lit(None).cast("long")).alias(f"form{k}") for k in range(len(FORMS))))
        in_form = {
            WITHIN: F.regexp_replace(F.regexp_replace(w, "⟨p([^⟩]+)⟩", "$1"), "⟨q[^⟩]+⟩", "⟨p⟩"),
            ALL: F.regexp_replace(w, "⟨[pq][^⟩]+⟩", "⟨p⟩"),
            NONE: F.regexp_replace(w, "⟨[pq]([^⟩]+)⟩", "$1"),
        }
        return F.when(F.contains(w, F.lit("⟨")), F.struct(*(F.xxhash64(in_form[k]).alias(f"form{k}") for k in range(len(FORMS))))).otherwise(same)

    return F.transform(words, forms)


def _beside(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, w, size): each template word's hashes beside those of the four that follow, null where the text ends, so that
    hashing windows is compiled code; size is that of the text in words."""
    texts = rows.where(F.col(text_col).rlike("[^ \\t\\n\\x0B\\f\\r]")).select(F.col(id_col), numbered(F.col(text_col)).alias("numbered"))
    # Each step is a column of its own and used twice, so the optimiser leaves it alone: what stands inside transform() is interpreted.
    split = texts.select(id_col, marked(bare(F.col("numbered"))).alias("marked"))
    words = split.select(id_col, hashed(F.col("marked")).alias("words"), F.size("marked").alias("size"))
    zipped = F.arrays_zip(*(F.slice("words", i + 1, F.size("words")) if i else F.col("words") for i in range(WINDOW)))
    return words.select(id_col, "size", F.posexplode(zipped).alias("at", "w"))


def _window(width: int, form: int) -> Column:
    """The hash of the first words beside each other, null where there are fewer."""
    word = lambda i: F.col("w")[str(i) if i else "words"]
    return F.when(word(width - 1).isNotNull(), F.xxhash64(*(F.coalesce(word(i)[f"form{form}"], word(i)["form0"]) for i in range(width))))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, item_at, form, window, width): hashes of each five template words in a row; of all words where there are fewer."""
    each = _beside(items, id_col, text_col).withColumn("width", F.least(F.col("size"), F.lit(WINDOW)))
    forms = F.array(*(F.coalesce(*(F.when(F.col("width") == n, _window(n, k)) for n in range(1, WINDOW + 1))) for k in range(len(FORMS))))
    return each.select(id_col, F.col("at").alias("item_at"), "width", F.posexplode(forms).alias("form", "window")).where("window is not null")


def document_windows(docs: DataFrame, id_col: str, text_col: str, widths: list[int]) -> DataFrame:
    """(id, at, window): hashes in all forms of so many template words in a row, those that are the same in all forms once."""
    each = _beside(docs, id_col, text_col)
    of = [F.array(*(_window(n, k) for k in range(len(FORMS)))) for n in widths]
    each = each.select(id_col, "at", *(a.alias(f"width{n}") for n, a in zip(widths, of, strict=True)))
    one = lambda a: F.when((a[0] == a[1]) & (a[1] == a[2]), F.slice(a, 1, 1)).otherwise(a)
    found = [one(F.col(f"width{n}")) for n in widths]
    return each.select(id_col, "at", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("window")).where("window is not null")


@tidied
def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: doc id, item id, n_windows (the item's), n_matched, run_words and
    verbatim (no placeholder's value differs).

    Held means, in one of the forms of names, and in all of the document or one of the places where matches may belong together
    (_places): half of the item's windows, or an unbroken run of 13 template words, and one-to-one values in placeholders or half
    of the windows without any. Other occurrences and stray matches elsewhere don't count against one that holds. Where all
    capitalised words are names, those that differ have to be no more than half of the words. n_matched and run_words are those
    of the best place. Null and blank texts and items hold nothing and are held by nothing. An item of fewer words than a window
    is held by a document that has all of them in a row. Signs that stand alone and white space at the ends of a text are no words. Rows of one id are texts, or items, of their own, and the best of them
    counts; ids that are null are left out. Empty tables give no rows.
    """
    found = _found(docs.where(F.col(id_col).isNotNull()), benchmark.where(F.col(item_col).isNotNull()), id_col, text_col, item_col, item_text)
    counts = (F.max(c).alias(c) for c in ("n_windows", "n_matched", "run_words"))
    return found.groupBy(F.col("doc.id").alias(id_col), F.col("item.id").alias(item_col)).agg(*counts, F.max("verbatim").alias("verbatim"))


def text_key(text: Column) -> Column:
    """What tells apart the texts of one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@tidied
def contaminated_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_key) of each row of docs that holds an item, as contaminated() has it, whatever its id is, null too."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text)
    return found.select(F.col("doc.id").alias(id_col), F.col("doc.text").alias("text_key")).distinct()


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(doc, item, n_windows, n_matched, run_words, verbatim) for each text and item by form and place; doc and item are structs of
    an id and what tells apart its texts."""
    key_of = lambda i, t: F.struct(F.col(i).alias("id"), text_key(F.col(t)).alias("text"))
    items = benchmark.select(key_of(item_col, item_text).alias("item"), F.col(item_text).alias("item text"))
    docs = docs.select(key_of(id_col, text_col).alias("doc"), F.col(text_col).alias("doc text"))
    of_items = written(item_windows(items, "item", "item text").distinct(), "windows")
    size = written(of_items.groupBy("item").agg(F.countDistinct("item_at").alias("n_windows"), F.max("width").alias("width")), "items")
    few = of_items.count() <= MOST_BROADCAST
    widths = sorted(r[0] for r in size.select("width").distinct().collect()) or [WINDOW]  # five at most
    of_docs = document_windows(docs, "doc", "doc text", widths)
    of_items = of_items.select("item", "item_at", "form", "window")
    met = of_docs.join(F.broadcast(of_items) if few else of_items, "window")
    # What matches is small beside the documents: it is kept, and all else works on it.
    met = written(met.select("doc", "item", "form", "at", "item_at").distinct(), "met")
    shifted = met.withColumn("shift", F.col("at") - F.col("item_at"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("doc", "item", "form", "shift").orderBy("at"))
    runs = shifted.withColumn("island", island).groupBy("doc", "item", "form", "shift", "island").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.min("item_at").alias("item_at"))
    share = met.groupBy("doc", "item", "form").agg(F.countDistinct("item_at").alias("n_matched"))
    unbroken = runs.groupBy("doc", "item", "form").agg(F.max("n").alias("run"))
    words_of = F.col("run") + F.col("width") - 1
    long = (F.col("n_matched") >= LEAST_SHARE * F.col("n_windows")) | (F.col("run_words") >= LEAST_RUN)
    held = share.join(unbroken, ["doc", "item", "form"]).join(size, "item").withColumn("run_words", words_of).where(long)
    held = written(held, "held")
    found = lambda rows, verbatim: rows.select("doc", "item", "n_windows", "n_matched", "run_words", verbatim.alias("verbatim"))

    # Values in placeholders, for pairs that are held and items that have any.
    of_form = lambda k: _values(items, "item", "item text", k).select("item", F.lit(k).alias("form"), F.col("at").alias("item_at"), F.col("value").alias("item_value"))
    item_values = of_form(WITHIN).unionByName(of_form(ALL)).unionByName(of_form(NONE))
    item_values = written(item_values.join(held.select("item").distinct(), "item", "left_semi"), "values")
    if not item_values.limit(1).count():
        return found(held, F.lit(True))
    key = ["doc", "item", "form"]
    placed = written(runs.join(held.select(*key, "n_windows", "width"), key), "runs")
    some = written(held.join(item_values.select("item").distinct(), "item", "left_semi").select("doc").distinct(), "with-values")
    of_some = docs.join(F.broadcast(some) if some.count() <= MOST_BROADCAST else some, "doc", "left_semi")
    in_runs = lambda rows, more: rows.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") + more - 1).cast("int")))).withColumns({"at": F.col("at") + F.col("k"), "item_at": F.col("item_at") + F.col("k")})
    # A word that has a placeholder in any form has it where all capitalised words are names.
    slots = in_runs(placed, F.col("width") - 1).join(item_values, ["item", "form", "item_at"]).join(_values(of_some, "doc", "doc text", ALL), ["doc", "at"])
    slots = written(slots.select(*key, "n_windows", "width", "shift", "item_at", "item_value", "value").distinct(), "slots")
    # Without names a text matches in fewer places; values that other places gainsay don't map one to one there either.
    slots = slots.unionByName(slots.where(F.col("form") == WITHIN).withColumn("form", F.lit(NONE)))
    over_values = item_values.select("item", "form", F.explode(F.sequence(F.greatest(F.col("item_at") - (WINDOW - 1), F.lit(0)), F.col("item_at"))).alias("item_at"), F.lit(True).alias("over")).distinct()

    def judged(runs: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
        """Of matches taken together by some columns those that are long enough, and whether their values agree."""
        one = lambda a, b: slots.groupBy(*by, a).agg(F.countDistinct(b).alias("n")).groupBy(*by).agg(F.max("n").alias(f"most_{b}"))
        differs = F.col("item_value") != F.col("value")
        other = slots.groupBy(*by).agg(F.max(differs).alias("differs"), F.countDistinct(F.when(differs & F.contains("value", F.lit("⟨p")), F.col("item_at"))).alias("n_other"))
        values = one("item_value", "value").join(one("value", "item_value"), by).join(other, by)
        met_once = in_runs(runs, F.lit(0)).groupBy(*by, "item_at").agg(*(F.max(c).alias(c) for c in ("n", "n_windows", "width")))
        counts = F.count("*").alias("n_matched"), F.count_if(F.col("over").isNull()).alias("n_plain"), (F.max("n") + F.max("width") - 1).alias("run_words"), F.max("n_windows").alias("n_windows"), F.max("width").alias("width")
        out = met_once.join(over_values, ["item", "form", "item_at"], "left").groupBy(*by).agg(*counts).where(long).join(values, by, "left")
        likely = (F.col("form") != ALL) | (F.col("n_other") <= LEAST_SHARE * (F.col("n_matched") + F.col("width") - 1))
        return out.withColumn("agree", F.coalesce((F.col("most_value") == 1) & (F.col("most_item_value") == 1) & likely, F.lit(True)))

    whole = written(judged(placed, slots, key), "whole")
    # Where all of a document's matches agree, no part of them says more.
    settled = whole.where("agree").select("doc", "item").distinct()
    parts = lambda rows: rows.join(settled, ["doc", "item"], "left_anti").withColumn("place", F.explode(_places()))
    out = whole.unionByName(judged(parts(placed), parts(slots), [*key, "place"]).drop("place"))
    out = out.where(F.col("agree") | (F.col("n_plain") >= LEAST_SHARE * F.col("n_windows")))
    return found(out, ~F.coalesce("differs", F.lit(False)))


def _places() -> Column:
    """Where a run of matches may be part of an occurrence of its item, other than all of the document: stretches of shifts as wide as the
    item in two grids (an occurrence with words put in or left out, and no other whole one, is in a stretch of either), its
    shift alone."""
    words = F.col("n_windows") + F.col("width") - 1
    of = lambda kind, group: F.struct(F.lit(kind).alias("kind"), group.cast("long").alias("group"))
    return F.array(of(1, F.floor(F.col("shift") / words)), of(2, F.floor(F.col("shift") / words + 0.5)), of(3, F.col("shift")))


def _values(rows: DataFrame, id_col: str, text_col: str, form: int) -> DataFrame:
    """(id, at, value): the words that have placeholders in a form, with their values, by their place."""
    split = F.split(named(numbered(F.col(text_col)), form), " ")
    words = rows.select(id_col, F.posexplode(F.filter(split, lambda w: F.translate(w, SIGNS + DASHES, "") != "")).alias("at", "value"))
    return words.where(F.contains("value", F.lit("⟨"))).withColumn("value", F.lower(F.translate("value", SIGNS.replace(":", ""), "")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
