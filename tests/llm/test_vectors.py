import math
from collections import defaultdict

import numpy as np
from pyspark.sql import types as T

from citesift.llm.norm_buckets import top_products
from citesift.llm.projection_passes import near_vectors
from tests.conftest import SF_MID

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("item", T.StringType())])


def ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, cosine=0.98):
    good = [i for i, (k, v, lab, *_) in enumerate(rows) if k is not None and lab is not None and ok(v) and any(v)]
    links, parent = defaultdict(set), {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = defaultdict(list)
    for i in good:
        groups[rows[i][2], len(rows[i][1])].append(i)
    for at in groups.values():
        x = np.asarray([rows[i][1] for i in at], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            links[at[a]].add(at[b])
            links[at[b]].add(at[a])
            r, s = sorted((find(at[a]), find(at[b])), key=lambda i: rows[i][0])
            parent[s] = r
    out = []
    for i, r in enumerate(rows):
        members = [rows[j][0] for j in good if find(j) == find(i)] if i in set(good) else [r[0]]
        out.append((r[0], len(links[i]), min((m for m in members), default=None) if r[0] is not None else None))
    return out


def brute_top(rows, every=50, k=5):
    whole = [(key, [math.floor(256 * float(x)) for x in v]) for key, v, *_ in rows if ok(v)]
    queries = {}
    for key, v in whole:
        if key is not None and key % every == 0:
            queries[key] = v
    out = []
    for q, a in queries.items():
        scores = [(-sum(x * y for x, y in zip(a, b)), key is None, key) for key, b in whole if key != q and len(b) == len(a)]
        out += [(q, n + 1, s[2], -s[0]) for n, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(out)


def vectors(seed=1):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(260):
        rows.append((i, rnd.standard_normal(12).tolist(), int(rnd.integers(0, 3)), ""))
    base = rnd.standard_normal(12)
    for i in range(260, 460):
        rows.append((i, (base + 0.02 * rnd.standard_normal(12)).tolist(), 1, ""))
    for i in range(460, 560):
        rows.append((i, [0.5] * 12, 2 if i % 10 else 0, ""))
    for i in range(560, 700):
        j = int(rnd.integers(0, 260))
        rows.append((i, (np.asarray(rows[j][1]) * 3 + 0.01 * rnd.standard_normal(12)).tolist(), rows[j][2], ""))
    rows += [(700, None, 1, ""), (701, [0.0] * 12, 1, ""), (702, [float("nan")] * 12, 1, ""), (703, [1.0] * 3, 1, ""),
             (704, [1.0] * 11 + [None], 1, ""), (705, [1.0] * 12, None, ""), (750, [1e-20] * 12, 2, ""), (800, [], 1, ""),
             (706, [1e18] * 3 + [0.0] * 9, 0, ""), (None, [0.5] * 12, 2, ""), (450, rows[450][1], 1, "")]
    f32 = lambda v: None if v is None else [None if x is None else float(np.float32(x)) for x in v]
    return [(k, f32(v), lab, s) for k, v, lab, s in rows]


def test_links_that_no_window_shows_are_found(spark, monkeypatch):
    """One narrow pass leaves most links open; blocks are so small that labels are cut along the direction."""
    from citesift.llm import projection_passes as P

    rows = vectors(3)
    want = sorted(brute_links(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for block, part in ((40, 16), (P.BLOCK, P.SLICE)):
        monkeypatch.setattr(P, "BLOCK", block)
        monkeypatch.setattr(P, "SLICE", part)
        got = near_vectors(spark.createDataFrame(rows, SCHEMA), passes=1, bits=4, neighbours=2).collect()
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert got == want


def test_pairs_of_a_label_with_a_common_direction(spark):
    """Vectors at a mean cosine of about 0.8, in which windows of sign patterns fill with unlinked ones."""
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((3000, 64)) + 2.0 * rnd.standard_normal(64)
    near = x[:1500] / np.linalg.norm(x[:1500], axis=1, keepdims=True) + 0.19 * rnd.standard_normal((1500, 64)) / 8
    x = np.concatenate([x, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    close = u @ u.T >= 0.98
    np.fill_diagonal(close, False)
    assert 0.7 < (u @ u.T).mean() < 0.9 and close.any(axis=1).sum() > 1500
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert [got[i][0] for i in range(len(x))] == close.sum(axis=1).tolist()
    assert all(got[a][1] == got[b][1] for a, b in zip(*np.nonzero(close)))


def test_links_components_and_kept_equal_brute_force(spark):
    rows = vectors()
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), neighbours=16).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute_links(rows), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_group_is_counted_in_chunks(spark, monkeypatch):
    from citesift.llm import projection_passes as P

    monkeypatch.setattr(P, "CHUNK", 50)
    rows = vectors(2)
    got = P.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute_links(rows), key=key)


def test_top_products_equal_brute_force(spark, monkeypatch):
    from citesift.llm import norm_buckets as N

    monkeypatch.setattr(N, "BUCKET_ROWS", 64)
    monkeypatch.setattr(N, "BLOCK_ROWS", 5)
    rows = [r for r in vectors() if r[0] != 706]
    got = N.top_products(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: r[:2]
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=key) == sorted(brute_top(rows), key=key)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors(empty).count() == 0 and top_products(empty).count() == 0


def test_queries_over_the_whole_table(spark):
    from citesift.llm.queries import op2_projection_passes, op9_norm_buckets

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op2_projection_passes(spark, SF_MID).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute_links(rows))
    top = op9_norm_buckets(spark, SF_MID).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top) == brute_top(rows)
