import os

import pytest

from weftline.plans import registry
from weftline.session import kept, new_folder, scratch, tidied


def folder(spark):
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://")


def test_tables_go_with_their_scope(spark):
    before = set(os.listdir(folder(spark)))
    with scratch(spark):
        kept(spark.range(3), "inner")
        spark.range(2).write.parquet(new_folder(spark, "folder"))
        assert len(set(os.listdir(folder(spark))) - before) == 2
    assert set(os.listdir(folder(spark))) == before
    with pytest.raises(ValueError), scratch(spark):
        kept(spark.range(3), "inner")
        raise ValueError
    assert set(os.listdir(folder(spark))) == before


def test_only_the_result_stays(spark):
    @tidied
    def inner():
        return kept(spark.range(5), "first").where("id > 1")

    @tidied
    def outer():
        return inner().union(kept(spark.range(2), "second"))

    before = set(os.listdir(folder(spark)))
    assert sorted(r["id"] for r in outer().collect()) == [0, 1, 2, 3, 4]
    (left,) = set(os.listdir(folder(spark))) - before
    assert left.startswith("weftline-outer-")
    assert tidied(lambda: spark.range(1))().count() == 1


@pytest.mark.parametrize("name", ["aggregate_metrics", "strategy_multi_query", "ground_truth_load", "rerank_counters", "window_coverage"])
def test_queries_leave_their_result_alone(spark, sf, name):
    before = set(os.listdir(folder(spark)))
    registry.queries()[name](spark, sf).count()
    assert len(set(os.listdir(folder(spark))) - before) <= 1
