import hashlib
import itertools
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_in_middle, prefix_trie, registry, url_filter

TURNS = "conv_id long, turn long, role string, text string"
LONG = "wörd 😀 " * 40_000

# --- 11


def brute_trie(rows, group=5, most=9):
    """Nodes by plain dictionaries of whole prefixes."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % most
        made[c] = tuple(own.get(c - c % group, [])[:h] + turns[h:])
    members: dict = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for node, of in members.items():
        below = [k for k in members if k[: len(node)] == node]
        leaf = [k for k in below if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in members)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in of if made[c] == node)))
        out.add((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), sum(len(k) == len(node) + 1 for k in below), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(spark, rows):
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("pos", "node", "item", "bytes", "depth", "n_convs", "seq", "row")})
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(turns)))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "IDS_TOGETHER", 4)
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(60), 40):
        if rnd.random() < 0.9:
            for turn in range(rnd.choice([1, 3, 8, 20, 45])):
                rows.append((c, rnd.choice([turn, turn, turn, None, 2]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "b", "é", None, ""])))
    rows += rows[:7] + [(None, 1, "user", "a"), (None, None, None, None)]
    got = [tuple(r[c] for c in COLUMNS) for r in nodes_of(spark, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_many_copies_and_of_turnless_conversations(spark):
    same = [(c, t, "user", f"text {t}") for c in range(5, 700) for t in range(3)]
    far = next(c for c in range(10_001, 10_200) if c % 5 and crc32(str(c).encode()) % 9 > 0)  # takes its turns from one that isn't there
    rows = same + [(far, 0, "user", LONG)]
    got = {tuple(r[c] for c in COLUMNS) for r in nodes_of(spark, rows).collect()}
    assert got == brute_trie(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 696 and root[7] != hashlib.sha256(b"").hexdigest()


def test_roles_and_texts_do_not_run_into_each_other(spark):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "a", "bc"), (15, 0, None, "abc"), (20, 0, "a:b", "c"), (25, 0, "1:a", "bc")]
    assert {tuple(r[c] for c in COLUMNS) for r in nodes_of(spark, rows).collect()} == brute_trie(rows)


def test_no_conversations_no_nodes(spark):
    assert nodes_of(spark, []).count() == 0 and nodes_of(spark, [(None, 1, "user", "a")]).count() == 0


def test_rounds_of_the_rollup_are_logarithmic(spark, monkeypatch):
    made, write = [], prefix_trie.written
    monkeypatch.setattr(prefix_trie, "written", lambda df, name: made.append(name) or write(df, name))
    chain = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string").cast("binary")).alias("parent"), F.col("id").alias("depth"), F.lit(1).cast("long").alias("n"))
    got = {int(r["node"]): r["n"] for r in prefix_trie.rolled_up(chain, ["n"]).collect()}
    assert got == {i: 1000 - i for i in range(1000)}
    assert made.count("state") == 11


# --- 12


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def brute_rule(host, path):
    fits = [r for r in url_filter.STATED if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (None, None) if best is None else (best[1] + best[2], best[0])


ODD_URLS = [None, "", "no scheme", "http://", "://x.org/es/", "HTTP://WWW.EXAMPLE.ORG/es/1?x#y", "http://example.org/en/12", "http://example.org/EN/12", "http://notexample.org/es/", "http://a.example.org?/es/", "http://org/", "http://org", "http://x.com#/de/", "http://u@x.com:80/de/", "http://x.com/de/1://y.org/", "http://ÀÉ.org/fr/", "x\ny://b.com/fr/\n?q", "http://x.net/" + "a/" * 5000]


def test_hosts_paths_and_stated_rules(spark, sf):
    urls = ODD_URLS + [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    for r in url_filter.ruled(pages, url_filter.STATED).collect():
        want = brute_parts(r["url"])
        assert (r["host"], r["path"]) == want
        assert (r["rule"], r["ruled"]) == brute_rule(*want)


def brute_rules(labelled, min_support, min_confidence):
    """Every combination of tokens of every URL, counted; those that always come together as one."""
    n, has = len(labelled), {}
    for k, (have, _) in enumerate(labelled):
        for t in have:
            has.setdefault(t, set()).add(k)
    groups: dict = {}
    for t, of in has.items():
        if min_support * n <= len(of) < n:
            groups.setdefault(frozenset(of), []).append(t)
    ok, labels = {}, {y for _, y in labelled}
    for size in range(1, len(groups) + 1):
        for pick in itertools.combinations(groups, size):
            rows = frozenset.intersection(*pick)
            for y in labels:
                hits = sum(labelled[k][1] == y for k in rows)
                if rows and hits >= min_support * n and hits >= min_confidence * len(rows) - 1e-12:
                    ok[frozenset(pick), y] = (hits / len(rows), hits / n)
    out = set()
    for (pick, y), (sure, often) in ok.items():
        if not any((w := (pick - {g}, y)) in ok and ok[w][0] >= sure for g in pick):
            out.add((frozenset(t for g in pick for t in groups[g]), y, round(sure, 9), round(often, 9)))
    return out


def test_mined_rules_equal_all_combinations(spark):
    rnd = random.Random(4)
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['www.', 'm.', ''])}{rnd.choice(['cheap-pills', 'news', 'blog'])}.example.{rnd.choice(['com', 'net'])}/{rnd.choice(['de', 'fr'])}/{rnd.randint(1, 99)}" for _ in range(150)]
    labels = ["block" if ("pills" in u and rnd.random() < 0.9) or ("/de/" in u and ".net" in u) else "allow" for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, labels, strict=True)) + [("http://x.org/", None)], "url string, label string").withColumn("items", F.lit("clash"))
    rows = [(r["t"], r["label"]) for r in labelled.where("label is not null").select(url_filter.tokens(F.col("url")).alias("t"), "label").collect()]
    got = url_filter.mined(labelled, 0.05, 0.8).collect()
    assert {(frozenset(r["tokens"]), r["label"], round(r["confidence"], 9), round(r["support"], 9)) for r in got} == brute_rules(rows, 0.05, 0.8)
    assert len(got) > 3 and any("word:pills" in r["tokens"] and r["label"] == "block" for r in got)


def test_all_frequent_items_of_a_url_are_mined(spark):
    """Seventeen items a URL and more, of which those that make the rule tell least about the label, one by one."""
    rnd = random.Random(9)
    rows = []
    for _ in range(240):
        words = [f"w{chr(97 + k)}" for k in range(16) if rnd.random() < 0.9]
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words += ["xa"] * a + ["xb"] * b
        label = "block" if a != b else "allow"
        if label == "block" and rnd.random() < 0.8:
            words = [w for w in words if w not in ("wa", "wb")]
        rows.append((f"http://e.net/{'/'.join(words)}", label))
    labelled = spark.createDataFrame(rows, "url string, label string")
    have = [(r["t"], r["label"]) for r in labelled.select(url_filter.tokens(F.col("url")).alias("t"), "label").collect()]
    got = {(frozenset(r["tokens"]), r["label"], round(r["confidence"], 9), round(r["support"], 9)) for r in url_filter.mined(labelled, 0.1, 0.8).collect()}
    assert got == brute_rules(have, 0.1, 0.8)
    assert any({"path:xa", "path:xb"} <= r[0] and r[1] == "allow" and r[2] == 1 for r in got)


def test_index_finds_what_trying_every_rule_finds():
    rnd, words = random.Random(5), [f"t{k}" for k in range(12)]
    rules = [(rnd.sample(words, rnd.randint(1, 4)), rnd.choice(["allow", "block"]), 0.9) for _ in range(60)]
    index: dict = {}
    for k, r in enumerate(rules):
        index.setdefault(r[0][0], []).append(k)
    for _ in range(300):
        have = rnd.sample(words, rnd.randint(0, 6))
        assert url_filter.looked_up(have, rules, index) == next((k for k, r in enumerate(rules) if set(r[0]) <= set(have)), None)


def test_one_url_in_a_third_of_the_rows_makes_no_explosion(spark):
    long = "http://a.example.net/" + "/".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300))
    rows = [(long, "block")] * 200 + [(f"http://b{k % 7}.example.com/p/{k}", "allow") for k in range(400)]
    rules = url_filter.mined(spark.createDataFrame(rows, "url string, label string")).collect()
    assert any(len(r["tokens"]) > 300 and r["label"] == "block" and r["confidence"] == 1 for r in rules) and len(rules) < 100


def test_unlabelled_empty_and_odd_pages(spark):
    assert url_filter.mined(spark.createDataFrame([("http://a.com/", None)], "url string, label string")).count() == 0
    pages = spark.createDataFrame([(None if k % 2 else k, u) for k, u in enumerate(ODD_URLS * 2)], "page_id long, url string").withColumns({"its tokens": F.lit(1), "row": F.lit(2), "confidence": F.lit(3)})
    got = url_filter.judged(pages, ([(["ending:org"], "block", 1.0)], {"ending:org": [0]})).collect()
    assert len(got) == 2 * len(ODD_URLS)
    for r in got:
        assert (r["mined_verdict"] == "block") == brute_parts(r["url"])[0].endswith("org")
    assert url_filter.judged(pages.limit(0), ([], {})).count() == 0


def test_no_rule_of_a_large_model_is_left_out(spark):
    """Of 25,000 rules the least sure judges too, whichever way rules come to the pages."""
    rules = spark.range(25_000).select(F.array(F.concat(F.lit("query:k"), "id")).alias("tokens"), F.lit("block").alias("label"), (1 - F.col("id") / 250_000).alias("confidence"), F.lit(0.1).alias("support"))
    pages = spark.createDataFrame([(k, f"http://a.net/?k{k}=1") for k in (0, 19_999, 20_000, 24_999, 25_000)], "page_id long, url string")
    want = {(k, "block" if k < 25_000 else "allow") for k in (0, 19_999, 20_000, 24_999, 25_000)}
    for got in (url_filter.judged_by(pages, rules), url_filter.judged(pages, url_filter.index_of(rules))):
        assert {(r["page_id"], r["mined_verdict"]) for r in got.collect()} == want


def test_rules_that_are_joined_judge_as_those_that_are_sent(spark, monkeypatch):
    rnd, words = random.Random(12), [f"query:k{k}" for k in range(9)]
    made = {tuple(rnd.sample(words, rnd.randint(1, 4))): (rnd.choice(["allow", "block"]), rnd.choice([0.8, 0.9, 1.0]), rnd.choice([0.1, 0.2])) for _ in range(80)}
    rules = spark.createDataFrame([(list(t), *r) for t, r in made.items()], "tokens array<string>, label string, confidence double, support double")
    urls = [f"http://a.net/?{'&'.join(f'k{k}=1' for k in rnd.sample(range(12), rnd.randint(0, 6)))}" for _ in range(200)] + ODD_URLS
    pages = spark.createDataFrame([(None if k % 9 == 4 else k, u) for k, u in enumerate(urls * 2)], "page_id long, url string").withColumns({"its tokens": F.lit(1), "row": F.lit(2), "label": F.lit("x"), "tokens": F.lit("y"), "confidence": F.lit(3)})
    by = lambda df: (df.columns, sorted(map(repr, df.collect())))
    sent = by(url_filter.judged_by(pages, rules))
    assert len({r.split("mined_rule=")[1] for r in sent[1]}) > 10
    for name, most in (("MOST_RULES", 3), ("PART_SETS", 5), ("PART_RULES", 2)):
        monkeypatch.setattr(url_filter, name, most)
        assert by(url_filter.judged_by(pages, rules)) == sent


def test_query_of_urls(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = registry.queries()["op12_url_filter"](spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    labelled, judged = [], []
    for r in rows:
        host, path = brute_parts(pages[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule is None:
            judged.append(r)
        else:
            assert r["verdict"] == verdict and r["mined_rule"] is None
            labelled.append((r["page_id"], verdict))
    tokens = {r["page_id"]: set(r["t"]) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect()}
    for r in judged:  # what a mined rule says is what the labelled URLs with its tokens say
        if r["mined_rule"] is None:
            assert r["verdict"] == "allow"
        else:
            of = set(r["mined_rule"].split(" "))
            same = [v for p, v in labelled if of <= tokens[p]]
            assert of <= tokens[r["page_id"]] and same.count(r["verdict"]) / len(same) == pytest.approx(r["confidence"]) and r["confidence"] >= 0.8


# --- 13


def brute_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_outputs_equal_brute_force_and_are_reversible(spark):
    rnd = random.Random(6)
    texts = [None, "", " ", "a", "é", "😀", "<P>", "x<M>y", "<", "<<S", "<P", "M>", LONG, LONG, *("".join(rnd.choice("ab<PSM> \né😀\x00") for _ in range(rnd.randint(0, 40))) for _ in range(400))]
    rows = [(None if k % 50 == 7 else k, t) for k, t in enumerate(texts)] + [(3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "form", "output", "h0", "restored", "row")})
    got = fill_in_middle.restored(fill_in_middle.filled(docs)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got))) == sorted(map(repr, ((i, *brute_fim(i, t), t or "") for i, t in rows)))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.filled(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["words", "lines", "code_points"])
def test_units(unit):
    rnd = random.Random(7)
    for _ in range(300):
        text = "".join(rnd.choice("ab \t\né") for _ in range(rnd.randint(0, 30)))
        if unit == "words":
            starts = [k for k, c in enumerate(text) if c not in " \t\n" and (k == 0 or text[k - 1] in " \t\n")]
            bounds = [0, *starts[1:], len(text)] if text else [0]
        elif unit == "lines":
            bounds = [0, *(k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)), len(text)] if text else [0]
        else:
            bounds = list(range(len(text) + 1))
        raw = text.encode()
        marks = fill_in_middle.ends(raw, unit)
        assert marks.bit_count() == len(bounds) - 1
        for k, b in enumerate(bounds):
            assert fill_in_middle.cut(raw, marks, k) == len(text[:b].encode())


def test_outputs_of_any_shape_are_restored(spark):
    odd = spark.createDataFrame([(1, None, "psm"), (2, "x", None), (3, None, None)], "`a b` long, output string, form string")
    assert {r["a b"]: r["restored"] for r in fill_in_middle.restored(odd).collect()} == {1: "", 2: "x", 3: ""}
