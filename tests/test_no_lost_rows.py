"""Cases in which rows were once lost or ranked wrongly."""

import numpy as np
import pytest

from citesift.operators import budget
from citesift.operators.knn import knn_join
from citesift.operators.lsh import knn_lsh
from citesift.sinks import snapshot


def test_null_and_negative_budgets(spark):
    rows = [("none", i, None) for i in range(8)] + [("small", i, 300) for i in range(8)] + [("minus", i, -5) for i in range(3)]
    calls = spark.createDataFrame(rows, "claim string, n int, budget int")
    gated = budget.sequential_gate(calls, ["claim"], ["n"], budget=calls["budget"])
    got = {r["claim"]: (r["calls_made"], r["refused_at"]) for r in budget.gate_outcome(gated, ["claim"]).collect()}
    assert got == {"none": (7, 7), "small": (2, 2), "minus": (1, 1)}
    alone = calls.where("claim = 'minus'")
    assert budget.sequential_gate(alone, ["claim"], ["n"], budget=alone["budget"]).count() == 1
    assert budget.sequential_gate(alone, ["claim"], ["n"], budget=-5).count() == 1


def _frames(spark, corpus, queries):
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)], "id long, embedding array<double>")
    q = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(queries)], "qid long, embedding array<double>")
    return q, c


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_ranks_do_not_depend_on_the_vectors_size(spark, scale):
    rng = np.random.default_rng(5)
    corpus, queries = rng.standard_normal((200, 8)) * scale, rng.standard_normal((10, 8)) * scale
    q, c = _frames(spark, corpus, queries)
    got = {(r["qid"], r["rank"]): r["id"] for r in knn_join(q, c, 5, query_keys=["qid"], corpus_block_rows=50).collect()}
    for j, v in enumerate(queries):
        d = ((corpus - v) ** 2).sum(axis=1)
        assert [got[j, r] for r in range(1, 6)] == np.lexsort((np.arange(200), d))[:5].tolist()


def test_a_cell_emits_k_rows_of_equal_vectors(spark):
    from citesift.operators.knn import _block_kernel
    import pandas as pd

    q = pd.DataFrame({"qid": [0, 1], "embedding": [np.zeros(4), np.ones(4)]})
    c = pd.DataFrame({"id": range(500)[::-1], "embedding": [np.ones(4)] * 500})
    out = _block_kernel(["qid"], "id", "embedding", 5, "l2sq", [])(q, c)
    assert out["id"].tolist() == [0, 1, 2, 3, 4] * 2
    zero = _block_kernel(["qid"], "id", "embedding", 2, "cosine", [])(q, c)
    assert zero["distance"].tolist() == [1.0, 1.0, 0.0, 0.0]


def test_lsh_gives_k_distinct_hits_with_exact_distances(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((10, 16))
    corpus = np.concatenate([c + 0.05 * rng.standard_normal((30, 16)) for c in centre])
    queries = centre + 0.05 * rng.standard_normal((10, 16))
    q, c = _frames(spark, corpus, queries)
    c = c.union(spark.createDataFrame([(9999, None)], c.schema))
    rows = knn_lsh(q, c, 5, query_keys=["qid"], dim=16).collect()
    hits = 0
    for j, v in enumerate(queries):
        mine = sorted((r["rank"], r["id"], r["distance"]) for r in rows if r["qid"] == j)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and len({m[1] for m in mine}) == 5
        d = ((corpus - v) ** 2).sum(axis=1)
        assert all(abs(m[2] - d[m[1]]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & set(np.argsort(d)[:5].tolist()))
    assert hits >= 0.8 * 50


def test_an_unfinished_snapshot_is_never_live_nor_overwritten(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    df = spark.createDataFrame([(1,)], "v int")
    assert snapshot.write_snapshot(df, root) == 1

    def stop(*_):
        raise RuntimeError("lost between the folder and its marker")

    with monkeypatch.context() as m:
        m.setattr(snapshot, "_commit", stop)
        with pytest.raises(RuntimeError):
            snapshot.write_snapshot(spark.createDataFrame([(2,)], "v int"), root)
    assert snapshot.current_snapshot(spark, root) == 1 and snapshot.read_snapshot(spark, root).first()["v"] == 1
    assert snapshot.write_snapshot(spark.createDataFrame([(3,)], "v int"), root) == 3
    assert snapshot.read_snapshot(spark, root).first()["v"] == 3
