"""Queries that apply one function or source to whole tables, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.formats import duration, latency, progress
from ..operators import evaluation as E
from ..session import new_folder
from ..schema import SQL, embedded, ground_truth, patches, table
from ..sources import changes as G
from ..sources import files as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def over_p(select: str, more: str = "") -> str:
    return f"with {SQL}{more} {select}"


@query(over_p("select patch_id, title, description, strftime(created_time, '%Y-%m-%d %H:%M:%S') as created, len(files)::integer as n_files, array_to_string(files, ',') as files from p"))
def load_patches(spark: SparkSession, sf: str) -> DataFrame:
    raw = patches(spark, sf).withColumn("files", F.concat(F.lit("['"), F.array_join("files", "', '"), F.lit("']")))
    out = S.cleaned(raw)
    return out.select("patch_id", "title", "description", F.date_format("created_time", "yyyy-MM-dd HH:mm:ss").alias("created"), F.size("files").alias("n_files"), F.array_join("files", ",").alias("files"))


@query(over_p(r"select patch_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(title || ' ' || description, '\b([A-Z][A-Z0-9]{1,9}-\d+|#\d{3,7})\b', 1), lambda x: upper(x)))), ',') as tickets from p"))
def load_patches_train(spark: SparkSession, sf: str) -> DataFrame:
    raw = patches(spark, sf).withColumn("files", F.to_json("files"))
    return S.cleaned(raw, tickets=True).select("patch_id", F.array_join(F.array_sort("tickets"), ",").alias("tickets"))


@query(over_p("select source, target from gt"))
def ground_truth_load(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "links")
    S.write_csv(ground_truth(spark, sf).toDF("source_patch_id", "target_patch_id"), path)
    return S.read_links(spark, path)


@query(over_p("select patch_id, title, description, array_to_string(files, ',') as files from p"))
def sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as JSON lines and read again."""
    path = new_folder(spark, "texts")
    S.write_json(patches(spark, sf).select("patch_id", "title", "description", "files"), path)
    return S.read_texts(spark, path).withColumn("files", F.array_join("files", ","))


_clock = "case when s >= 3600 then (s // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') else (s // 60)::varchar end || ':' || lpad((s % 60)::varchar, 2, '0')"


@query(over_p(f"select patch_id, {_clock} as took, case when n * 7 % 20000 < 10000 then (n * 7 % 20000) || 'ms' else (n * 7 % 20000 // 1000) || '.' || (n * 7 % 1000 // 100) || 's' end as latency from (select *, n * 37 % 100000 as s from p)"))
def durations(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("patch_id", duration(F.col("n") * 37 % 100000 + F.lit(0.5)).alias("took"), latency((F.col("n") * 7 % 20000).cast("decimal(12,3)") / 1000).alias("latency"))


@query(over_p("select day, done || '/' || total || ', ' || (1000 * done // total // 10) || '.' || (1000 * done // total % 10) || '%, mrr ' || printf('%.4f', floor(10000 * (rr / done)) / 10000) || ', per second ' || printf('%.2f', floor(100 * (done / 60.0)) / 100) || ', left ' || " + _clock.replace("s ", "left_s ") + " || ', answered ' || (calls - failed) || ', cached ' || cached || ', failed ' || failed || ', mean call ' || coalesce((500 * calls // nullif(calls, 0)) || 'ms', '-') as shown from (select *, floor((total - done) / (done / 60.0))::bigint as left_s from (select strftime(created_time, '%Y-%m-%d') as day, count(*) as done, (select count(*) from p) as total, sum(0.25 * (n % 4)) as rr, count(*) filter (n % 3 > 0) as calls, count(*) filter (n % 3 = 2) as failed, count(*) filter (n % 3 = 0) as cached from p group by 1))"))
def progress_of_days(spark: SparkSession, sf: str) -> DataFrame:
    """A line of progress for each day, as if its patches had been ranked in a minute, two thirds of them by calls of half a second."""
    p = patches(spark, sf)
    each = p.groupBy(F.date_format("created_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("done"), F.sum(0.25 * (F.col("n") % 4)).alias("rr"), F.count_if(F.col("n") % 3 > 0).alias("calls"), F.count_if(F.col("n") % 3 == 2).alias("failed"), F.count_if(F.col("n") % 3 == 0).alias("cached"))
    of = each.crossJoin(F.broadcast(p.agg(F.count("*").alias("total"))))  # one row
    return of.select("day", progress(F.col("done"), F.col("total"), F.col("rr") / F.col("done"), F.lit(60.0), F.col("calls"), F.col("failed"), F.col("cached"), 0.5 * F.col("calls")).alias("shown"))


@query(over_p("select patch_id, printf('%.1f', (n % 1000) / 10.0) || '%' as shown from p"))
def percent(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("patch_id", C.percent(F.col("n") % 1000 / 1000).alias("shown"))


@query(over_p("select cast(n % 100 as varchar) as patch_id, max_by(title, n) as title, max(n) as n from p group by 1"))
def id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that come several times: the last one counts."""
    rows = patches(spark, sf).select((F.col("n") % 100).cast("string").alias("patch_id"), "title", "n")
    return S.one_of_each(rows, "patch_id", "n")


@query(over_p("select count(*) as n_rows, count(distinct patch_id) as n_ids from e"))
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Patches and their vectors, one for each."""
    rows = embedded(spark, sf)
    both = E.aligned(rows.select("patch_id", "title"), rows.select("patch_id", "vector"), "patch_id")
    return both.agg(F.count("*").alias("n_rows"), F.count_distinct("patch_id").alias("n_ids"))


@query(over_p("select patch_id, title || ' ' || description as text from p"))
def text_payload(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("patch_id", C.payload(F.col("title"), F.col("description")).alias("text"))


@query(r"select doc_id, len(w)::integer as n_tokens, array_to_string(w, ' ') as tokens from (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 2) as w from documents)")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    w = C.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query("select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)))), ' ') as tokens from documents")
def token_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(C.token_set(F.col("text"))), " ").alias("tokens"))


@query(over_p(r"select patch_id, array_to_string(list_sort(list_distinct(regexp_extract_all(title || ' fix#' || (n + 1000) || ' CVE-2020-1234 ' || description, '\b([A-Z][A-Z0-9]{1,9}-\d+|#\d{3,7})\b', 1))), ',') as tickets from p"))
def ticket_refs(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("title", F.lit(" fix#"), (F.col("n") + 1000).cast("string"), F.lit(" CVE-2020-1234 "), "description")
    return patches(spark, sf).select("patch_id", F.array_join(F.array_sort(C.ticket_refs(text)), ",").alias("tickets"))


@query(over_p("select patch_id, f as path, array_to_string(list_filter(string_split(trim(f), '/'), lambda s: s <> ''), '>') as segments, list_filter(string_split(trim(f), '/'), lambda s: s <> '')[1] as top from (select patch_id, unnest(list_transform(files, lambda x: ' /' || x || '/ ')) as f from p)"))
def path_segments(spark: SparkSession, sf: str) -> DataFrame:
    each = patches(spark, sf).select("patch_id", F.explode(F.transform("files", lambda x: F.concat(F.lit(" /"), x, F.lit("/ ")))).alias("path"))
    return each.select("patch_id", "path", F.array_join(C.segments(F.col("path")), ">").alias("segments"), F.get(C.segments(F.col("path")), 0).alias("top"))


@query(over_p("select patch_id, case when n % 7 = 0 then '' else array_to_string(files, '|') end as files from p"))
def parse_list_literal(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.concat(F.lit("['"), F.array_join("files", "', '"), F.lit("']"))
    text = F.when(F.col("n") % 7 == 0, F.lit("not a list")).otherwise(quoted)
    return patches(spark, sf).select("patch_id", F.array_join(C.parse_list(text), "|").alias("files"))


@query(over_p("select patch_id, array_to_string(list_filter(list_concat(['/COMMIT_MSG', '/MERGE_LIST'], files), lambda f: f not in ('/COMMIT_MSG', '/MERGE_LIST')), ',') as files from p"))
def exclude_paths(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat(F.array(*map(F.lit, C.NOT_FILES)), F.col("files"))
    return patches(spark, sf).select("patch_id", F.array_join(C.without_messages(both), ",").alias("files"))


@query(over_p("select count(*) as n_patches, count(*) filter (length(title) > 300) as titles, count(*) filter (length(description) > 1500) as descriptions, count(*) filter (len(files) > 25) as files from p"))
def oversized_counts(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).agg(F.count("*").alias("n_patches"), F.count_if(F.length("title") > 300).alias("titles"), F.count_if(F.length("description") > 1500).alias("descriptions"), F.count_if(F.size("files") > 25).alias("files"))


@query(
    r"""select page_id, case when u like '%opendev%' then 'openstack' when u like '%android%' then 'android' when u like '%qt-project%' then 'qt' end as project,
    nullif(regexp_extract(u, '/c/(?:.*/)?\+?/(\d+)', 1), '') as number
    from (select page_id, url || case page_id % 4 when 0 then '/review.opendev.org/c/nova/+/' when 1 then '/android-review/c/platform/art/+/' when 2 then '/codereview.qt-project/c/' else '' end || page_id as u from pages)"""
)
def parse_change_url(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 4
    middle = F.when(k == 0, "/review.opendev.org/c/nova/+/").when(k == 1, "/android-review/c/platform/art/+/").when(k == 2, "/codereview.qt-project/c/").otherwise("")
    pages = table(spark, sf, "pages").select("page_id", F.concat("url", middle, F.col("page_id").cast("string")).alias("u"))
    project, number = C.change_of_url(F.col("u"))
    return pages.select("page_id", project.alias("project"), number.alias("number"))


@query(over_p(r"select patch_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^(```json|```)', ''), '```$', ''), '^\s+', ''), '\s+$', '') as reply from (select patch_id, case n % 3 when 0 then '  ```json' || chr(10) || title || chr(10) || '```  ' when 1 then '```' || title || '```' else title end as t from p)"))
def strip_fences(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n") % 3
    text = F.when(k == 0, F.concat(F.lit("  ```json\n"), "title", F.lit("\n```  "))).when(k == 1, F.concat(F.lit("```"), "title", F.lit("```"))).otherwise(F.col("title"))
    return patches(spark, sf).select("patch_id", C.strip_fences(text).alias("reply"))


@query(over_p("select patch_id, case n % 5 when 0 then patch_id || ',9' when 1 then null when 2 then null when 3 then null else '' end as ids from p"))
def parse_rerank_response(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n") % 5
    text = F.when(k == 0, F.concat(F.lit('```json\n["'), "patch_id", F.lit('", "9"]\n```'))).when(k == 1, F.concat(F.lit("["), "patch_id", F.lit("]"))).when(k == 2, F.concat(F.lit('{"id": "'), "patch_id", F.lit('"}'))).when(k == 3, F.lit("here is the list")).otherwise(F.lit("[]"))
    return patches(spark, sf).select("patch_id", F.array_join(C.parsed_reply(text), ",").alias("ids"))


@query(over_p(r"select patch_id, case when s = '' then 'n/a' when length(s) <= 60 then s else regexp_replace(substr(s, 1, 60), '\s+$', '') || ' [...]' end as clipped from (select patch_id, regexp_replace(case when n % 11 = 0 then '  ' else description end, '^\s+|\s+$', '', 'g') as s from p)"))
def clip_text(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("patch_id", C.clip(F.when(F.col("n") % 11 == 0, F.lit("  ")).otherwise(F.col("description")), 60).alias("clipped"))


@query(over_p("select patch_id, case when n % 9 = 0 then 'n/a' when len(files) > 2 then array_to_string(files[1:2], ', ') || ', ... (+' || (len(files) - 2) || ' more)' else array_to_string(files, ', ') end as files from p"))
def files_summary(spark: SparkSession, sf: str) -> DataFrame:
    files = F.when(F.col("n") % 9 != 0, F.col("files"))
    return patches(spark, sf).select("patch_id", C.files_summary(files, 2).alias("files"))


@query(over_p("select patch_id, array_to_string(flatten(list_transform(files[1:5], lambda f: list_filter(string_split(f, '/'), lambda s: length(s) > 3 and not starts_with(s, '.'))))[1:20], ' ') as words from p"))
def path_query(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("patch_id", C.path_query(F.col("files")).alias("words"))


@query(over_p("""select patch_id, sha1('{"ids": ["' || array_to_string(files, '", "') || '"], "llm_top_k": 10, "model": "small", "target": "' || patch_id || '"}') as key from p"""))
def llm_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("patch_id", C.order_key(F.lit("small"), 10, F.col("patch_id"), F.col("files")).alias("key"))


@query(over_p("select patch_id, sha1(title || ' ' || description) as text_sha1 from p"))
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return E.fingerprint(patches(spark, sf))


@query(over_p("select patch_id, sha1(title || ' ' || description) as text_sha1 from p where n % 3 = 0 or n % 5 = 0"))
def embedding_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    p = patches(spark, sf)
    # A cache without every third patch, where every fifth text has changed since and some vectors are another model's.
    cache = E.fingerprint(p.where("n % 3 != 0")).withColumn("text_sha1", F.when(F.col("patch_id").cast("long") % 5 == 0, F.lit("old")).otherwise(F.col("text_sha1"))).withColumn("model", F.lit("m1"))
    return S.cache_misses(p, cache.unionByName(E.fingerprint(p.where("n % 3 = 0")).withColumn("model", F.lit("m2"))), "m1")


@query(over_p("select n as vec_id, round(list_sum(list_transform(vector, lambda x: 3 * x / sqrt(list_sum(list_transform(vector, lambda y: 9 * y * y))))), 6) as total, round(sqrt(list_sum(list_transform(vector, lambda x: x * x)) / list_sum(list_transform(vector, lambda y: y * y))), 6) as norm from e"))
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = C.l2_normalised(F.transform("vector", lambda x: 3 * x))
    return embedded(spark, sf).select(F.col("n").alias("vec_id"), v.alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(C.norm(F.col("v")), 6).alias("norm"))


@query(over_p("select patch_id, case when n % 2 = 0 then patch_id when n % 3 = 0 then 'I' || n else 'dir' || n end as id from p"))
def extract_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    meta = F.when(n % 2 == 0, F.concat(F.lit('{"_number": '), "patch_id", F.lit("}"))).when(n % 3 == 0, F.concat(F.lit('{"change_id": "I'), "patch_id", F.lit('"}'))).otherwise(F.lit('{"subject": "x"}'))
    p = patches(spark, sf).select(F.lit("x").alias("project"), F.concat(F.lit("dir"), "patch_id").alias("dir"), F.lit("metadata").alias("kind"), meta.alias("body"))
    return G.extracted(p).select(F.substring("dir", 4, 99).alias("patch_id"), F.col("patch_id").alias("id"))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """REST replies of two revisions for each patch; every tenth is no reply."""
    revision = lambda k, extra: F.concat(F.lit(f'"r{k}": {{"_number": {k}, "commit": {{"message": "message {k} of '), "patch_id", F.lit('"}, "files": {"/COMMIT_MSG": {}, "'), F.array_join("files", '": {}, "'), F.lit(f'": {{}}, "{extra}": {{}}}}}}'))
    body = F.concat(F.lit(")]}'\n"), F.lit('{"subject": "change '), "patch_id", F.lit('", "created": "2024-01-02 03:04:05.000000000", "revisions": {'), revision(2, "b.py"), F.lit(", "), revision(1, "a.py"), F.lit("}}"))
    return patches(spark, sf).select("patch_id", F.when(F.col("n") % 10 != 0, body).otherwise(F.lit("down")).alias("reply"))


@query(over_p("select patch_id, case when n % 10 <> 0 then 'change ' || patch_id end as title, case when n % 10 <> 0 then 'message 2 of ' || patch_id end as description, case when n % 10 <> 0 then '2024-01-02 03:04:05' end as created, case when n % 10 <> 0 then array_to_string(list_sort(list_distinct(list_append(files, 'a.py'))), ',') end as files from p"))
def gerrit_normalize(spark: SparkSession, sf: str) -> DataFrame:
    out = G.normalised(_replies(spark, sf))
    return out.select("patch_id", "title", "description", F.date_format("created_time", "yyyy-MM-dd HH:mm:ss").alias("created"), F.array_join("files", ",").alias("files"))


@query(over_p("select patch_id, case when n % 2 = 0 then array_to_string(files, ',') else 'low.py' end as files from p"))
def pick_patchset(spark: SparkSession, sf: str) -> DataFrame:
    files = F.to_json("files")
    sets = F.when(F.col("n") % 2 == 0, F.concat(F.lit('[{"patchset_number": 2, "modified_file_paths": ["x"]}, {"patchset_number": 1, "modified_file_paths": '), files, F.lit("}]"))).otherwise(F.lit('[{"patchset_number": 7, "modified_file_paths": ["x"]}, {"patchset_number": 3, "modified_file_paths": ["/COMMIT_MSG", "low.py"]}]'))
    p = patches(spark, sf)
    part = lambda kind, body: p.select(F.lit("x").alias("project"), F.col("patch_id").alias("dir"), F.lit(kind).alias("kind"), body.alias("body"))
    return G.extracted(part("metadata", F.concat(F.lit('{"_number": '), "patch_id", F.lit("}"))).unionByName(part("patchsets", sets))).select("patch_id", F.array_join("files", ",").alias("files"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of changes: every patch links to the next by number, and some by change id, to none, or to nothing known."""
    p = patches(spark, sf)
    n = F.col("n")
    meta = F.concat(F.lit('{"_number": '), "patch_id", F.lit(', "change_id": "I'), "patch_id", F.lit('", "subject": "s"}'))
    link = F.when(n % 4 == 0, F.concat(F.lit('[{"changeNumber": '), (n + 1).cast("string"), F.lit("}]"))).when(n % 4 == 1, F.concat(F.lit('[{"changeId": "I'), (n - 1).cast("string"), F.lit('"}]'))).when(n % 4 == 2, F.lit('[{"changeNumber": 99999999}, {}]')).otherwise(F.concat(F.lit('[{"changeNumber": '), "patch_id", F.lit("}]")))
    link = F.when(n % 11 == 1, F.lit("[]")).when(n % 11 != 0, link)
    comments = F.concat(F.lit('{"change_comments": ["c1", "c2"], "inline_comments": {"a.py": ["i'), "patch_id", F.lit('"], "b.py": "one"}}'))
    part = lambda kind, body: p.select(F.lit("x").alias("project"), F.col("patch_id").alias("dir"), F.lit(kind).alias("kind"), body.alias("body"))
    return G.extracted(part("metadata", meta).unionByName(part("linkages", link).where("body is not null")).unionByName(part("comments", comments)))


LINKS = """, links as (
  select patch_id, n, case when n % 4 = 0 then n + 1 when n % 4 = 1 then n - 1 when n % 4 = 2 then 99999999 else n end as t, case when n % 4 = 1 then 'I' || (n - 1) end as cid, case when n % 4 <> 1 then true else false end as by_number from p where n % 11 > 1
  union all select patch_id, n, null, null, false from p where n % 4 = 2 and n % 11 > 1
), res as (
  select l.patch_id, case when by_number then cast(t as varchar) end as number, cid as change_id, x.patch_id as target,
    case when x.patch_id = l.patch_id then 'self' when x.patch_id is not null then 'ok' when t is not null then 'target_unknown' else 'unresolvable' end as reason,
    case when x.patch_id is null then null when by_number then 'number' else 'change_id' end as via
  from links l left join p x on x.n = l.t
)"""


@query(over_p("select * from res", LINKS))
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    tree = _tree(spark, sf)
    return G.resolved(G.links_of(tree), tree)


@query(over_p("""select count(*) as links, count(*) filter (reason = 'ok') as ok, count(*) filter (reason = 'self') as "self", count(*) filter (reason = 'target_unknown') as target_unknown, count(*) filter (reason = 'unresolvable') as unresolvable,
  count(*) filter (reason = 'ok' and via = 'number') as via_number, count(*) filter (reason = 'ok' and via = 'change_id') as via_change_id, (select count(*) from p where n % 11 <> 0) as with_file, (select count(*) from p where n % 11 = 1) as with_no_links,
  count(distinct case when reason = 'ok' then patch_id || '>' || target end) as distinct_links, count(distinct patch_id) as sources, (select count(*) from p) as patches from res""", LINKS))
def link_stats(spark: SparkSession, sf: str) -> DataFrame:
    tree = _tree(spark, sf)
    return G.link_stats(G.resolved(G.links_of(tree), tree), tree)


@query(over_p("select patch_id, patch_id as id, 'I' || patch_id as change_id, 's' as title, 's' as description from p"))
def etl_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select(F.col("dir").alias("patch_id"), F.col("patch_id").alias("id"), "change_id", "title", "description")


@query(over_p("select patch_id, part, c as comment from (select patch_id, 'change_comments' as part, unnest(['c1', 'c2']) as c from p union all select patch_id, 'inline_comments', unnest(['i' || patch_id, 'one']) from p)"))
def flatten_comments(spark: SparkSession, sf: str) -> DataFrame:
    return G.flat_comments(_tree(spark, sf))


def hand_off(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-off rows, read from their lines: each patch has the next three as candidates, one of them unknown at the table's end;
    every second row has objects in place of ids."""
    n = F.col("n")
    ids = F.transform(F.array(n + 1, n + 2, n + 3), lambda x: x.cast("string"))
    shown = F.when(n % 2 == 0, F.concat(F.lit('["'), F.array_join(ids, '", "'), F.lit('"]'))).otherwise(F.concat(F.lit('[{"patch_id": "'), F.array_join(ids, '"}, {"patch_id": "'), F.lit('"}]')))
    line = F.concat(F.lit('{"source_patch_id": "'), "patch_id", F.lit('", "candidates": '), shown, F.lit(', "n_targets_total": 1, "window_days": 14, "top_k": 3, "llm_applied": false}'))
    return S.parsed_hand_off(patches(spark, sf).select(line.alias("value")))


HAND = ", h as (select patch_id as source_patch_id, [cast(n + 1 as varchar), cast(n + 2 as varchar), cast(n + 3 as varchar)] as candidates from p), need as (select source_patch_id as patch_id from h union select unnest(candidates) from h)"


@query(over_p("select source_patch_id, array_to_string(candidates, ',') as candidates, 14 as window_days, 3 as top_k, false as llm_applied from h", HAND))
def handoff_scan(spark: SparkSession, sf: str) -> DataFrame:
    return hand_off(spark, sf).select("source_patch_id", F.array_join("candidates", ",").alias("candidates"), "window_days", "top_k", "llm_applied")


@query(over_p("select patch_id, title, description, array_to_string(files, ',') as files from p where patch_id in (select patch_id from need)", HAND))
def hydrate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return S.hydrated(hand_off(spark, sf), patches(spark, sf)).withColumn("files", F.array_join("files", ","))


@query(over_p("select patch_id from need where patch_id not in (select patch_id from p)", HAND))
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return S.missing(hand_off(spark, sf), patches(spark, sf))


@query(over_p("select patch_id, title, description, strftime(created_time, '%Y-%m-%d') as created_on, array_to_string(files, ',') as files from p where n % 50 = 0"))
def patch_details(spark: SparkSession, sf: str) -> DataFrame:
    asked = patches(spark, sf).where("n % 50 = 0").select("patch_id")
    found = S.one_of_each(patches(spark, sf).join(asked, "patch_id", "left_semi"), "patch_id")
    return found.select("patch_id", "title", "description", F.date_format("created_time", "yyyy-MM-dd").alias("created_on"), F.array_join("files", ",").alias("files"))


@query(over_p(r"""select patch_id, 'Rank the candidate changes by how closely they are linked with the target change. Answer with a JSON list of candidate ids, best first, and nothing else.' || chr(10) || chr(10) || 'target' || chr(10) || target || chr(10) || chr(10) || 'candidates' || listed as prompt from (
    select t.patch_id, any_value(t.shown) as target, string_agg(chr(10) || chr(10) || 'id: ' || c.id || chr(10) || coalesce(x.shown, 'title: n/a' || chr(10) || 'files: n/a' || chr(10) || 'text: n/a'), '' order by c.place) as listed
    from (select source_patch_id, unnest(candidates) as id, generate_subscripts(candidates, 1) as place from h) c join shown t on t.patch_id = c.source_patch_id left join shown x on x.patch_id = c.id group by t.patch_id)""", HAND + r""", trimmed as (select patch_id, regexp_replace(title, '^\s+|\s+$', '', 'g') as t, regexp_replace(description, '^\s+|\s+$', '', 'g') as d, files from p),
  shown as (select patch_id, 'title: ' || case when t = '' then 'n/a' when length(t) <= 300 then t else regexp_replace(substr(t, 1, 300), '\s+$', '') || ' [...]' end || chr(10) || 'files: ' || array_to_string(files, ', ') || chr(10) || 'text: ' || case when length(d) <= 1500 then d else regexp_replace(substr(d, 1, 1500), '\s+$', '') || ' [...]' end as shown from trimmed)"""))
def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rerank import payloads

    return payloads(hand_off(spark, sf), patches(spark, sf)).select(F.col("q").alias("patch_id"), "prompt")


@query(over_p("select source_patch_id as q, array_to_string(candidates, ',') as ids, (select count(*) from unnest(candidates) u(c) where c not in (select patch_id from p))::bigint as n_missing from h", HAND))
def assemble_payload(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rerank import payloads

    return payloads(hand_off(spark, sf), patches(spark, sf)).select("q", F.array_join("ids", ",").alias("ids"), "n_missing")


@query(over_p("select source as source_patch_id, count(*)::bigint as n_targets, string_agg(target, ',' order by target) as targets from gt group by source"))
def targets_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return ground_truth(spark, sf).groupBy(F.col("source").alias("source_patch_id")).agg(F.count("*").alias("n_targets"), F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"))
