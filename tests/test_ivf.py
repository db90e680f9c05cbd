import numpy as np

from citesift.operators.ivf import IvfIndex, nearest_lists, recall
from citesift.operators.knn import knn_join
from citesift.sinks.store import get_store


def _table(spark, n, seed, first=0, groups=12):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).standard_normal((groups, 16)) * 3
    v = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, 16))
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, embedding array<float>")


def test_recall_floor_with_few_candidates(spark, tmp_path):
    corpus = _table(spark, 2000, 1)
    asked = _table(spark, 60, 2).withColumnRenamed("id", "q")
    index = IvfIndex(spark, str(tmp_path)).build(corpus)
    assert 40 <= len(index.centres) <= 45 and index.vectors().count() == 2000
    got = index.tune(asked, 5, query_keys=["q"])
    assert got >= 0.95 and index.probes < len(index.centres) / 2
    exact = knn_join(asked, corpus, 5, query_keys=["q"], corpus_key="id")
    assert recall(index.search(asked, 5, query_keys=["q"]), exact, ["q"]) >= 0.9
    every = index.search(asked, 5, query_keys=["q"], probes=len(index.centres), round_digits=9)
    want = knn_join(asked, corpus, 5, query_keys=["q"], corpus_key="id", round_digits=9)
    assert sorted((r.q, r.rank, r.id, r.distance) for r in every.collect()) == sorted((r.q, r.rank, r.id, r.distance) for r in want.collect())


def test_upsert_replaces_rows_in_whatever_list_they_were(spark, tmp_path):
    corpus = _table(spark, 300, 3)
    index = IvfIndex(spark, str(tmp_path)).build(corpus, lists=9)
    moved = _table(spark, 40, 4)
    new = _table(spark, 10, 5, first=1000)
    index.upsert(moved.unionByName(new))
    index.upsert(_table(spark, 3, 6, first=1000).unionByName(spark.createDataFrame([(5000, None)], "id bigint, embedding array<float>")))
    want = {r.id: r.embedding for r in corpus.collect()} | {r.id: r.embedding for r in moved.unionByName(new).collect()}
    want |= {r.id: r.embedding for r in _table(spark, 3, 6, first=1000).collect()}
    rows = IvfIndex(spark, str(tmp_path)).vectors().collect()
    assert len(rows) == 310 and {r.id: r.embedding for r in rows} == want


def test_an_upsert_without_its_marker_is_not_there(spark, tmp_path, monkeypatch):
    from citesift.operators import ivf

    index = IvfIndex(spark, str(tmp_path)).build(_table(spark, 50, 1), lists=4)

    def lost(*a):
        raise RuntimeError("lost")
    monkeypatch.setattr(ivf, "commit_epoch", lost)
    try:
        index.upsert(_table(spark, 50, 2))
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert {r.id: r.embedding for r in index.vectors().collect()} == {r.id: r.embedding for r in _table(spark, 50, 1).collect()}
    index.upsert(_table(spark, 20, 2))
    assert index.vectors().count() == 50


def test_empty_one_row_and_null_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id bigint, embedding array<float>")
    asked = _table(spark, 3, 2).withColumnRenamed("id", "q")
    index = IvfIndex(spark, str(tmp_path / "a")).build(none)
    assert index.tune(asked, 5, query_keys=["q"]) == 1.0 and index.search(asked, 5, query_keys=["q"]).count() == 0
    one = IvfIndex(spark, str(tmp_path / "b")).build(_table(spark, 1, 1))
    assert one.search(asked, 5, query_keys=["q"]).count() == 3


def test_nearest_lists_are_in_order_of_distance(spark):
    centres = np.array([[0.0, 0], [10, 0], [3, 0]])
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [9.0, 1.0])], "id bigint, embedding array<float>")
    got = {r.id: r.l for r in df.select("id", nearest_lists(centres, 2)("embedding").alias("l")).collect()}
    assert got == {1: [0, 2], 2: [1, 2]}


def test_store_by_name(spark, tmp_path):
    store = get_store("lists", spark, str(tmp_path))
    store.upsert(_table(spark, 200, 1))
    store.upsert(_table(spark, 5, 9, first=500))
    asked = _table(spark, 4, 2).withColumnRenamed("id", "q")
    assert store.query(asked, 3, query_keys=["q"]).count() == 12 and store.vectors().count() == 205


def test_working_memory_of_a_cell_is_bounded():
    """A cell of a full block needs a few bounded matrices, not several of 8 million doubles."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from citesift.operators.knn import _block_kernel

    rng = np.random.default_rng(3)
    corpus = pd.DataFrame({"id": np.arange(40000), "embedding": list(rng.random((40000, 8), dtype=np.float32))})
    asked = pd.DataFrame({"q": np.arange(300), "embedding": list(rng.random((300, 8), dtype=np.float32))})
    for metric in ("l2sq", "cosine"):
        kernel = _block_kernel(["q"], "id", "embedding", 5, metric, [])
        tracemalloc.start()
        kernel(asked, corpus)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64e6


def test_all_lists_are_dealt_without_python(spark, tmp_path):
    from pyspark.sql import functions as F

    from citesift.operators import ivf

    rows = spark.range(60).select("id", F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"))
    index = ivf.IvfIndex(spark, str(tmp_path / "lists")).build(rows, lists=6)

    def never(*_):
        raise AssertionError("an order of all lists was asked for")
    kept, ivf.nearest_lists = ivf.nearest_lists, never
    try:
        got = index.search(rows.withColumnRenamed("id", "q"), 1, query_keys=["q"], probes=6).collect()
    finally:
        ivf.nearest_lists = kept
    assert sorted((r["q"], r["id"]) for r in got) == [(i, i) for i in range(60)]
