"""The vector store object."""

import pytest

from citesift.sinks.store import get_store


def test_upsert_replaces_and_scoped_query(spark, tmp_path):
    store = get_store("table", spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.vectors()
    cols = "id long, s int, embedding array<double>"
    store.upsert(spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, [5.0, 5.0]), (3, 1, [0.0, 0.0])], cols))
    store.upsert(spark.createDataFrame([(2, 0, [0.0, 0.1]), (4, 1, [9.0, 9.0])], cols))
    q = spark.createDataFrame([(7, 0, [0.0, 0.0])], "qid long, s int, embedding array<double>")
    assert [r["id"] for r in store.query(q, 2, query_keys=["qid"], scope="s").orderBy("rank").collect()] == [2, 1]
    assert [r["id"] for r in store.query(q, 2, query_keys=["qid"]).orderBy("rank").collect()] == [3, 2]
    with pytest.raises(ValueError):
        get_store("nowhere", spark, "x")


def test_bucket_store_finds_the_nearest(spark, tmp_path):
    store = get_store("buckets", spark, str(tmp_path / "b"))
    store.upsert(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<double>"))
    q = spark.createDataFrame([(1, [3.0, 1.0])], "qid long, embedding array<double>")
    assert store.query(q, 1, query_keys=["qid"], dim=2).first()["id"] == 3
