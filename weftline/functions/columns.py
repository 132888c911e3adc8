"""Column expressions: text, lists, paths, vectors and pairs of patches. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import USUAL

#: With Unicode's word characters, as most languages' regular expressions have them by default.
WORDS, ASCII_WORDS = r"(?U)[a-z0-9_\w]{3,}", "[A-Za-z0-9_]+"  # usual characters are named, as they are looked up faster
#: What a ticket reference looks like, and paths that are no files of a patch.
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-\d+|#\d{3,7})\b"
NOT_FILES = ("/COMMIT_MSG", "/MERGE_LIST")
_LIST = {"allowSingleQuotes": "true"}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def payload(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-cased words of three or more characters, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ASCII_WORDS), F.lit(0)), F.lower))


def ticket_refs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TICKET), F.lit(1)), F.upper))


def parse_list(text: Column) -> Column:
    """A list written as Python or JSON writes it; anything else is the empty list."""
    return F.coalesce(F.from_json(text, "array<string>", _LIST), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """As jaccard(), of arrays without repeats: one set operation for each pair."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.trim(path), "/"), lambda s: s != "")


def top_segments(files: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(files, lambda f: F.get(segments(f), 0)), lambda s: s.isNotNull()))


def without_messages(files: Column) -> Column:
    return F.filter(files, lambda f: ~f.isin(*NOT_FILES))


def _agreements(a: Column, b: Column) -> Column:
    """Positions at which two arrays agree, over the size of the longer."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return same / F.greatest(F.size(a), F.size(b), F.lit(1))


def path_scores(a: Column, b: Column, backwards: bool = False) -> Column:
    """For all pairs of paths of two lists of segment lists: the share of positions that agree, from the front or the back."""
    turn = F.reverse if backwards else (lambda x: x)
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _agreements(turn(x), turn(y)))))


def mean(values: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)), F.lit(0.0))


def largest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalised(v: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_apart(a: Column, b: Column) -> Column:
    return F.abs(micros(a) - micros(b)) / F.lit(3_600_000_000)


def pair_features(a: str, b: str) -> dict[str, Column]:
    """The 14 features of a pair of rows, whose columns start with a and b; each is the same with the two exchanged.

    Rows have files (list), set (without repeats), tops (their first segments), parts (segments of each file), vector, words (set), created_time and tickets.
    """
    c = lambda side, name: F.col(f"{side}{name}")
    fa, fb, pa, pb = c(a, "files"), c(b, "files"), c(a, "parts"), c(b, "parts")
    front, back = path_scores(pa, pb), path_scores(pa, pb, backwards=True)
    return {
        "jaccard": set_jaccard(c(a, "set"), c(b, "set")),
        "nb_shared": F.size(F.array_intersect(c(a, "set"), c(b, "set"))),
        "abs_delta_files": F.abs(F.size(fa) - F.size(fb)),
        "min_len_files": F.least(F.size(fa), F.size(fb)),
        "max_len_files": F.greatest(F.size(fa), F.size(fb)),
        "same_component": F.coalesce(F.arrays_overlap(c(a, "tops"), c(b, "tops")), F.lit(False)).cast("int"),
        "lcp_mean": mean(front),
        "lcp_max": largest(front),
        "lcsuff_mean": mean(back),
        "lcsuff_max": largest(back),
        "sim_cosine": cosine(c(a, "vector"), c(b, "vector")),
        "token_jaccard": set_jaccard(c(a, "words"), c(b, "words")),
        "delta_time_hours": hours_apart(c(a, "created_time"), c(b, "created_time")),
        "shares_ticket_ref": F.coalesce(F.arrays_overlap(c(a, "tickets"), c(b, "tickets")), F.lit(False)).cast("int"),
    }


def strip_fences(text: Column) -> Column:
    """A reply without the fence of a code block around it."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), "^(```json|```)", ""), "```$", ""))


def parsed_reply(text: Column) -> Column:
    """A reply's list of ids, or null where it isn't a JSON list of strings alone."""
    json = F.try_parse_json(strip_fences(text))
    ids = F.from_json(strip_fences(text), "array<string>")
    sound = F.schema_of_variant(json).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(ids, lambda x: x.isNull())
    return F.when(F.coalesce(sound, F.lit(False)), ids)


def clip(text: Column, limit: int) -> Column:
    """At most limit characters; nothing at all is n/a."""
    t = stripped(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit("n/a")).when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+$", ""), F.lit(" [...]")))


def files_summary(files: Column, limit: int = USUAL.files_listed) -> Column:
    shown = F.array_join(F.slice(files, 1, limit), ", ")
    more = F.concat(shown, F.lit(", ... (+"), (F.size(files) - limit).cast("string"), F.lit(" more)"))
    return F.when(F.coalesce(F.size(files), F.lit(0)) == 0, F.lit("n/a")).when(F.size(files) > limit, more).otherwise(shown)


def described(title: Column, description: Column, files: Column) -> Column:
    """A patch as a prompt shows it."""
    return F.concat(F.lit("title: "), clip(title, USUAL.title_chars), F.lit("\nfiles: "), files_summary(files), F.lit("\ntext: "), clip(description, USUAL.text_chars))


def path_query(files: Column) -> Column:
    """Words of a query made from a patch's first files: parts of their paths that are long enough, in order."""
    some = F.flatten(F.transform(F.slice(files, 1, USUAL.path_files), lambda f: F.filter(F.split(f, "/"), lambda s: (F.length(s) > USUAL.path_part_above) & ~s.startswith("."))))
    return F.array_join(F.slice(some, 1, USUAL.path_tokens), " ")


def json_string(text: Column) -> Column:
    """A string of plain ASCII as JSON writes it."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def order_key(model: Column, head: int, target: Column, ids: Column) -> Column:
    """The key that a reranked order is kept under: SHA-1 of JSON with sorted names."""
    listed = F.array_join(F.transform(ids, json_string), ", ")
    return F.sha1(F.concat(F.lit('{"ids": ['), listed, F.lit(f'], "llm_top_k": {head}, "model": '), json_string(model), F.lit(', "target": '), json_string(target), F.lit("}")).cast("binary"))


def change_of_url(url: Column) -> tuple[Column, Column]:
    """Project and change number of a review page's address; null where it is none."""
    project = F.when(F.contains(url, F.lit("opendev")), F.lit("openstack")).when(F.contains(url, F.lit("android")), F.lit("android")).when(F.contains(url, F.lit("qt-project")), F.lit("qt"))
    number = F.nullif(F.regexp_extract(url, r"/c/(?:.*/)?\+?/(\d+)", 1), F.lit(""))
    return project, number


def without_prefix(text: Column) -> Column:
    """A REST reply without the characters that keep browsers from running it."""
    return F.regexp_replace(text, r"^\)\]\}'", "")


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)
