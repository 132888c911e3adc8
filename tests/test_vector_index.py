import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import retrieval as R
from weftline.operators import vector_index as V
from weftline.operators.vector_index import VectorIndex, recall
from weftline.schema import embedded

ROWS = "n long, vector array<double>"


def clustered(n, width, groups, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, width))


def rows_of(spark, m, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in v]) for k, v in enumerate(m)], ROWS)


def asked_of(rows, every=20):
    return rows.where(f"n % {every} = 0").withColumn("q", F.col("n"))


def of(df):
    return {(r["q"], r["n"], round(r["sem"], 9), r["rank"]) for r in df.collect()}


def test_recall_of_the_nearest_cells(spark, sf, tmp_path):
    for name, rows in (("made", rows_of(spark, clustered(4000, 32, 60, 1))), ("given", embedded(spark, sf).select("n", "vector"))):
        index = VectorIndex.build(rows, str(tmp_path / name))
        asked = asked_of(rows)
        k = min(155, rows.count() // 8)
        found = recall(index.search(asked, k), R.nearest(asked, rows, k)).first()
        assert found["wanted"] == asked.count() * k and found["recall"] >= 0.9, (name, found)
    assert len(index.centres) > 1


def test_exact_search_equals_a_search_through_everything(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(V, "CORPUS_BLOCK", 50)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    m = clustered(900, 8, 12, 2)
    m[:5] = 0
    m[100:140] = m[100]
    rows = rows_of(spark, m)
    index = VectorIndex.build(rows, str(tmp_path / "i"))
    asked = asked_of(rows, 15)
    for k in (1, 10, 155, 900, 2000):
        assert of(index.search(asked, k, breadth=1, exact=True)) == of(R.nearest(asked, rows, k))
    # Cells that can't hold any of the first are not read.
    sure = VectorIndex.build(rows_of(spark, clustered(900, 8, 12, 3, 0.02)), str(tmp_path / "s"))
    once = sure._probes(asked_of(sure._vectors(), 15).select("q", "vector", F.lit(0.9).alias("least")), 10).count()
    assert once < 60 * len(sure.centres) / 2


def test_added_rows_are_found_and_removed_ones_are_not(spark, tmp_path):
    m = clustered(700, 8, 9, 4)
    first, more = rows_of(spark, m[:500]), rows_of(spark, m[500:], 500)
    index = VectorIndex.build(first, str(tmp_path / "i"))
    cells = index.centres.copy()
    index.add(more)
    again = VectorIndex(spark, str(tmp_path / "i"))
    assert (again.centres == cells).all()
    whole = first.unionByName(more)
    asked = asked_of(whole)
    assert of(again.search(asked, 30, exact=True)) == of(R.nearest(asked, whole, 30))
    again.remove(whole.where("n % 3 = 0").select("n"))
    left = whole.where("n % 3 != 0")
    assert of(again.search(asked, 30, exact=True)) == of(R.nearest(asked, left, 30))
    turned = whole.where("n % 3 = 0 and n < 300").withColumn("vector", F.reverse("vector"))
    again.add(turned)
    assert of(again.search(asked, 30, exact=True)) == of(R.nearest(asked, left.unionByName(turned), 30))


def test_empty_and_odd_indexes(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    index = VectorIndex.build(none, str(tmp_path / "none"))
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], ROWS)
    assert index.search(one.withColumn("q", F.col("n")), 3).count() == 0
    index = VectorIndex.build(one, str(tmp_path / "one"))
    assert of(index.search(one.withColumn("q", F.col("n")), 5, exact=True)) == {(1, 1, 1.0, 1), (1, 3, 0.0, 2), (3, 1, 0.0, 1), (3, 3, 0.0, 2)}
    assert index.search(none.withColumn("q", F.col("n")), 3).count() == 0


@pytest.mark.parametrize("take", [1, 3, 10])
def test_ties_at_the_last_place_go_by_the_smaller_row(take):
    rng = np.random.default_rng(5)
    sims, n = rng.integers(0, 4, size=(20, 10)) / 4, rng.permutation(10)
    want = np.stack([np.lexsort((n, -s))[:take] for s in sims])
    assert (R._first(sims, n, take) == want).all()


def test_rows_that_ask_for_every_cell_are_handed_on_in_small_steps():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["q"])
    for cells in (1, 784, 4096, 10**7):
        parts = list(V._steps(iter([batch, batch.slice(0, 0)]), cells))
        assert pa.Table.from_batches(parts).column("q").to_pylist() == list(range(10_000))
        assert max(p.num_rows for p in parts) * cells <= max(V.SIMS_STEP, cells)
