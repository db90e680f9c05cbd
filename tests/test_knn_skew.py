"""Blocked k-NN against brute force; skew-safe ordinal and hot-key share."""

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from citesift.operators.knn import knn_join
from citesift.operators.ordinal import ordinal_within
from citesift.operators.skew import hot_key_share, skewed_assignment


def _vectors(rng, n, dim=8):
    return [[float(x) for x in rng.standard_normal(dim)] for _ in range(n)]


def test_blocked_knn_equals_brute_force_with_hot_scope(spark):
    rng = np.random.default_rng(3)
    cv, qv = _vectors(rng, 300), _vectors(rng, 25)
    scope = [0 if i < 150 else i % 5 for i in range(300)]  # scope 0 holds half of the corpus
    corpus = spark.createDataFrame([(i, scope[i], v) for i, v in enumerate(cv)], "id long, s int, embedding array<double>")
    queries = spark.createDataFrame([(j, j % 5, v) for j, v in enumerate(qv)], "qid long, s int, embedding array<double>")
    for s_col in (None, "s"):
        got = knn_join(queries, corpus, 4, query_keys=["qid"], scope_col=s_col, corpus_block_rows=16,
                       query_block_rows=4)
        got = {(r["qid"], r["rank"]): r["id"] for r in got.collect()}
        C = np.array(cv)
        for j, q in enumerate(qv):
            ok = [i for i in range(300) if s_col is None or scope[i] == j % 5]
            d = ((C[ok] - np.array(q)) ** 2).sum(1)
            want = [ok[i] for i in sorted(range(len(ok)), key=lambda i: (round(d[i], 9), ok[i]))[:4]]
            assert [got[(j, r)] for r in range(1, 5)] == want


def test_ordinal_with_hot_key(spark):
    rows = [(0 if i % 3 == 0 else i % 17, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    o = ordinal_within(df, ["k"], ["v"], max_window_rows=0)  # force the range-partitioned path
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    assert o.join(ref, ["k", "v"]).where(F.col("ordinal") != F.col("rn")).count() == 0
    assert o.count() == 3000


def test_ordinal_null_and_compound_keys(spark):
    # a null key is its own group; a two-column key with a hot value spread over several range partitions
    rows = [(None if i % 5 == 0 else i % 3, 7 if i % 2 == 0 else i % 4, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long, v long")
    o = ordinal_within(df, ["a", "b"], ["v"], num_partitions=6, max_window_rows=0)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("a", "b").orderBy("v")))
    got = {(r["a"], r["b"], r["v"]): r["ordinal"] for r in o.collect()}
    want = {(r["a"], r["b"], r["v"]): r["rn"] for r in ref.collect()}
    assert got == want


def test_ordinal_size_check_picks_window(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(400)], "k long, v long")
    o = ordinal_within(df, ["k"], ["v"])
    assert "Window" in o._jdf.queryExecution().optimizedPlan().toString()
    assert {r["ordinal"] for r in o.where("k = 1").collect()} == set(range(1, 101))
    big = ordinal_within(df, ["k"], ["v"], group_bound=101, max_window_rows=100)
    assert "Window [row_number" not in big._jdf.queryExecution().optimizedPlan().toString()


def test_skewed_share(spark):
    rows = spark.range(5000).withColumnRenamed("id", "row")
    a = skewed_assignment(rows, "row", 100, seed=42)
    share = hot_key_share(a, "slot").first()
    assert share["n_hot"] == 5 and abs(share["hot_share"] - 0.6) <= 0.05


def _brute(cv, qv, k):
    C = np.array(cv)
    d = [((C - np.array(q)) ** 2).sum(1) for q in qv]
    return {(j, r): int(i) for j, x in enumerate(d) for r, i in enumerate(np.lexsort((np.arange(len(C)), x))[:k], 1)}


def test_cells_meet_however_many_partitions_they_are_dealt_to(spark):
    """Both sides of a cell land in one task, also where small partitions are not put together."""
    rng = np.random.default_rng(8)
    cv, qv = _vectors(rng, 400), _vectors(rng, 30)
    corpus = spark.createDataFrame(list(enumerate(cv)), "id long, embedding array<double>")
    queries = spark.createDataFrame(list(enumerate(qv)), "qid long, embedding array<double>")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        for blocks in ({}, {"corpus_block_rows": 16, "query_block_rows": 4}):
            got = knn_join(queries, corpus, 4, query_keys=["qid"], **blocks)
            assert {(r["qid"], r["rank"]): r["id"] for r in got.collect()} == _brute(cv, qv, 4)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_small_blocks_make_no_more_copies(spark):
    """Blocks travel in groups: a query is not copied once for every block of the corpus."""
    rng = np.random.default_rng(9)
    cv, qv = _vectors(rng, 3000), _vectors(rng, 40)
    corpus = spark.createDataFrame(list(enumerate(cv)), "id long, embedding array<double>")
    queries = spark.createDataFrame(list(enumerate(qv)), "qid long, embedding array<double>")
    hits = knn_join(queries, corpus, 3, query_keys=["qid"], corpus_block_rows=8, query_block_rows=2)
    groups = [int(n) for n in re.findall(r"sequence\(0, (\d+)", hits._jdf.queryExecution().logical().toString())]
    copies = 40 * (groups[0] + 1) + 3000 * (groups[1] + 1)
    assert len(groups) == 2 and copies < 4 * 3000 and (groups[0] + 1) * (groups[1] + 1) >= spark.sparkContext.defaultParallelism
    assert {(r["qid"], r["rank"]): r["id"] for r in hits.collect()} == _brute(cv, qv, 3)


def test_cells_of_a_group_give_what_one_cell_gives():
    import pandas as pd

    from citesift.operators.knn import _block_kernel

    rng = np.random.default_rng(10)
    # many equal vectors and vectors of length 0
    C, Q = rng.integers(-1, 2, (90, 3)).astype(float), rng.integers(-1, 2, (17, 3)).astype(float)
    c, q = pd.DataFrame({"id": rng.permutation(90), "embedding": list(C)}), pd.DataFrame({"qid": range(17), "embedding": list(Q)})
    for metric in ("l2sq", "cosine"):
        whole = _block_kernel(["qid"], "id", "embedding", 5, metric, [])(q, c)
        for cell in ((1, 1), (4, 7), (100, 100)):
            pd.testing.assert_frame_equal(_block_kernel(["qid"], "id", "embedding", 5, metric, [], cell)(q, c), whole)
