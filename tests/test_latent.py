import random

import numpy as np
from pyspark.sql import functions as F

from weftline.api import Engine
from weftline.operators.latent import Latent
from weftline.schema import embedded
from weftline.sources import store
from weftline.sources.changes import Client

ROWS = "patch_id string, title string, description string"


def made(n, seed, topics=6):
    """Texts of a few topics, each with words of its own and some that all share."""
    rnd = random.Random(seed)
    text = lambda t, k: " ".join(rnd.choice([f"topic{t}word{rnd.randint(0, 15)}", f"common{rnd.randint(0, 9)}"]) for _ in range(k))
    return [(str(k), text(k % topics, 5), text(k % topics, 30)) for k in range(n)]


def matrix(rows, words, idf):
    out = np.zeros((len(rows), len(words)))
    at = {w: k for k, w in enumerate(words)}
    for i, (_, title, text) in enumerate(rows):
        for w in f"{title or ''} {text or ''}".lower().split():
            if w in at:
                out[i, at[w]] += 1
    out = np.where(out > 0, 1 + np.log(np.maximum(out, 1)), 0) * idf
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def test_vectors_are_those_of_a_whole_decomposition(spark):
    rows = made(120, 1)
    df = spark.createDataFrame(rows, ROWS)
    model = Latent.fit(df, 6, passes=6)
    a = matrix(rows, model.words, model.idf)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.strength, s[:6], rtol=1e-3)
    want = a @ vt[:6].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r["patch_id"]: r["vector"] for r in model.encode(df).collect()}
    got = np.array([got[r[0]] for r in rows])
    assert np.allclose(got @ got.T, want @ want.T, atol=0.02)
    same = np.array([[i % 6 == j % 6 for j in range(120)] for i in range(120)])
    sims = got @ got.T
    assert sims[same].mean() > 0.8 and sims[~same].mean() < 0.4


def test_few_words_nulls_and_no_texts(spark):
    df = spark.createDataFrame([("1", "alpha beta", None), ("2", None, "alpha beta"), ("3", None, None), ("4", "unknown", "")], ROWS)
    got = {r["patch_id"]: r["vector"] for r in Latent.fit(df, 5).encode(df).collect()}
    assert np.allclose(got["1"], got["2"]) and abs(np.linalg.norm(got["1"]) - 1) < 1e-9 and len(got["1"]) == 5
    assert got["3"] == got["4"] == [0.0] * 5
    empty = Latent.fit(df.where("false"), 5)
    assert empty.encode(df).where(F.exists("vector", lambda x: x != 0)).count() == 0


def test_fetched_patches_have_vectors(spark, sf, tmp_path):
    rows = embedded(spark, sf).drop("vector")
    encoder = Latent.fit(rows, 8)
    known = rows.join(store.vectors(rows, encoder, str(tmp_path / "v")), "patch_id")
    of = known.where("n = 4").first()
    reply = ")]}'\n" + '{"subject": %s, "created": "2024-01-10 00:00:00.000", "revisions": {"a": {"_number": 1, "commit": {"message": %s}, "files": {"mod1/x.py": {}}}}}'
    import json

    client = Client({"docs": "https://host"}, lambda url: reply % (json.dumps(of["title"]), json.dumps(of["description"])) if "/777777/" in url else "nothing")
    e = Engine({"docs": known}, client, encoder=encoder)
    got = e.predict("docs", "777777", top_k=3, window_days=0, strategy="semantic").collect()
    best = max(got, key=lambda r: r["score"])
    assert best["score"] >= 0.6 and len(got) == 3
