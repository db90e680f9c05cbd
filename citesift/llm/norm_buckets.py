"""Exact top-k inner products from buckets of vectors of similar length.

Vectors are ordered by length and cut into buckets.  A first look at the longest bucket gives each query a
score that its k-th best cannot fall below.  That score, the query's length and a bucket's greatest length
give a local cosine threshold: above 1 the whole bucket is skipped for the query; where it is high, the query's
strongest coordinates bound the same coordinates of any vector that could still qualify; where it is low, only
vectors long enough are kept.  What is left is verified by the product itself, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.llm.shared import Tables
from citesift.llm.vectors import pack, unpack, usable

BUCKET_ROWS = 8192
BLOCK_ROWS = 1024
HIGH = 0.4
EXACT = float(1 << 53)


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, begin, end = usable(batch.column("v"))
            whole = np.floor(scale * values)
            take = np.flatnonzero(begin >= 0)
            rows = [whole[begin[i]:end[i]] for i in take]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(take)), pack(rows, "<i8"), pa.array([len(r) for r in rows], pa.int32()),
                 pa.array([math.sqrt(float(r @ r)) for r in rows], pa.float64())], names=["vec_id", "v", "dim", "length"])

    return run


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them exactly unless the components are very large."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)))
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return q @ c.T
    return (q.astype(np.int64) @ c.astype(np.int64).T).astype(np.int64)


def _candidates(q: np.ndarray, q_len: float, floor: float, lens: np.ndarray, order: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Rows of a bucket (longest first) whose product with query ``q`` may reach ``floor``."""
    if floor <= 0:
        return np.arange(len(lens))
    if q_len == 0 or lens[0] == 0:
        return np.zeros(0, np.int64)
    cos = floor / (q_len * lens[0]) * (1 - 1e-9)
    if cos > 1:
        return np.zeros(0, np.int64)
    if cos < HIGH:
        # the coordinate bounds would let too many pass: length alone decides
        return np.arange(int(np.searchsorted(-lens, -floor / q_len * (1 - 1e-9), side="right")))
    # the angles of query and candidate to an axis differ by no more than the angle between the two
    unit, reach = q / q_len, math.acos(cos)
    found = None
    for f in np.argsort(-np.abs(unit))[:2]:
        angle = math.acos(max(-1.0, min(1.0, unit[f])))
        low, high = math.cos(min(math.pi, angle + reach)) - 1e-9, math.cos(max(0.0, angle - reach)) + 1e-9
        a, b = np.searchsorted(ranked[f], [low, high])
        if found is None or b - a < len(found):
            found = order[f, a:b]
    return np.sort(found)


def _search(k: int):
    def run(queries: pa.Table, bucket: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and bucket.num_rows:
            c = unpack(bucket.column("v").combine_chunks(), "<i8")
            ids = np.asarray(bucket.column("vec_id").fill_null(np.iinfo(np.int64).max))
            gone = np.asarray(bucket.column("vec_id").is_null())
            lens = np.asarray(bucket.column("length"))
            by_len = np.lexsort((ids, -lens))
            c, ids, lens, gone = c[by_len], ids[by_len], lens[by_len], gone[by_len]
            units = c / np.maximum(lens, 1e-300)[:, None]
            order = np.argsort(units, axis=0, kind="stable").T if c.shape[1] else np.zeros((0, len(c)), np.int64)
            ranked = np.take_along_axis(units.T, order, axis=1) if c.shape[1] else order
            q = unpack(queries.column("v").combine_chunks(), "<i8")
            floors = np.asarray(queries.column("floor").fill_null(-math.inf))
            q_lens = np.asarray(queries.column("length"))
            for i, q_id in enumerate(queries.column("vec_id").to_pylist()):
                rows = _candidates(q[i], float(q_lens[i]), float(floors[i]), lens, order, ranked)
                rows = rows[(ids[rows] != q_id) | gone[rows]]
                if not len(rows):
                    continue
                scores = _products(q[i:i + 1], c[rows])[0]
                keep = np.lexsort((ids[rows], -scores))[:k]
                keep = keep[scores[keep] >= floors[i]]
                out += [(q_id, None if gone[rows[j]] else int(ids[rows[j]]), int(scores[j])) for j in keep]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, vector: str = "embedding",
                 key: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best integer inner products of each query.

    Components become ``floor(scale * x)``.  Queries are the rows whose key is divisible by ``every``, each
    key once (of repeated keys the smallest vector asks); candidates are all rows but those with the query's
    key.  Ties go to the smaller key, a null key last.  Vectors that are null or hold null or non-finite
    components take no part, and vectors of different lengths have no product.  An empty vector's products
    are 0.  Columns not named are not read.  An empty table gives an empty result.
    """
    tables = Tables(vectors.sparkSession, "norm_buckets")
    packed = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("v")).mapInArrow(
        _quantised(scale), "vec_id bigint, v binary, dim int, length double")
    packed = tables.write(packed, "packed")
    n = packed.count()
    parts = max(1, math.ceil(n / BUCKET_ROWS))
    buckets = tables.write(packed.repartitionByRange(parts, F.desc("length"), "vec_id", F.xxhash64("v")).withColumn(
        "bucket", F.spark_partition_id()), "buckets")
    bounds = tables.write(buckets.groupBy("bucket", "dim").agg(F.max("length").alias("longest")), "bounds")

    asked = packed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("v", "dim", "length")).alias("x")).select("vec_id", "x.*")
    blocks = max(1, math.ceil(n / every / BLOCK_ROWS))
    asked = tables.write(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "asked")
    schema = "query_id bigint, vec_id bigint, score bigint"

    def meet(queries: DataFrame) -> DataFrame:
        """Each block of queries against each bucket that one of its queries may find something in."""
        cells = queries.select("block", "bucket", "dim").distinct().toDF("block", "bucket", "dim")
        shown = buckets.join(cells, ["bucket", "dim"])
        cell = ["block", "bucket", "dim"]
        return queries.groupBy(*cell).cogroup(shown.groupBy(*cell)).applyInArrow(_search(k), schema)

    first = bounds.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    seen = meet(asked.withColumn("floor", F.lit(None).cast("double")).join(first, "dim"))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floors = tables.write(seen.withColumn("n", F.row_number().over(nth)).where(F.col("n") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")), "floors")
    # one row per query and bucket that its bound does not rule out
    live = asked.join(floors, "vec_id", "left").join(bounds, "dim").where(
        F.col("floor").isNull() | (F.col("longest") * F.col("length") * (1 + 1e-9) >= F.col("floor")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return meet(live.drop("longest")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
