"""Approximate nearest neighbours by random-hyperplane hashing (JON-3).

Each vector gets ``n_tables`` bucket keys, one per table of ``n_bits`` random hyperplanes (sign pattern of
its dot products).  Queries and corpus rows meet only inside equal buckets, and inside a bucket the same
blocked exact kernel as :func:`citesift.operators.knn.knn_join` ranks them — so a crowded bucket is split
into corpus blocks instead of pairing all its rows.  Hits found in several tables are merged by corpus id.
The hyperplanes depend only on (seed, dim, tables, bits), never on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.operators.knn import knn_join


def hyperplanes(dim: int, n_tables: int, n_bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n_tables, n_bits, dim))


def bucket_udf(dim: int, n_tables: int = 4, n_bits: int = 6, seed: int = 7):
    planes = hyperplanes(dim, n_tables, n_bits, seed)
    weights = 1 << np.arange(n_bits)

    @F.pandas_udf("array<string>")
    def buckets(vecs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vecs:
            if s.empty:
                yield pd.Series([], dtype=object)
                continue
            m = np.stack(s.to_numpy()).astype(np.float64)
            codes = (np.einsum("nd,tbd->ntb", m, planes) > 0).astype(np.int64) @ weights  # (rows, tables)
            yield pd.Series([[f"{t}:{c}" for t, c in enumerate(row)] for row in codes])

    return buckets


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int, *, query_keys: list[str], corpus_key: str = "id",
            vector_col: str = "embedding", dim: int, n_tables: int = 4, n_bits: int = 6, seed: int = 7) -> DataFrame:
    """Approximate top-k per query: exact ranking restricted to shared-bucket candidates."""
    fn = bucket_udf(dim, n_tables, n_bits, seed)
    queries, corpus = (df.where(F.col(vector_col).isNotNull()) for df in (queries, corpus))
    qb = queries.select(*query_keys, vector_col, F.explode(fn(F.col(vector_col))).alias("_bucket"))
    cb = corpus.select(corpus_key, vector_col, F.explode(fn(F.col(vector_col))).alias("_bucket"))
    # the cut to k comes per bucket first: copies of one id found in several tables must not use up the k
    qb = qb.withColumn("_in", F.col("_bucket"))
    per_bucket = knn_join(qb, cb, k, query_keys=[*query_keys, "_in"], corpus_key=corpus_key, vector_col=vector_col,
                          scope_col="_bucket")
    merged = per_bucket.groupBy(*query_keys, corpus_key).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy(*query_keys).orderBy(F.col("distance"), F.col(corpus_key))
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_at_k(approx: DataFrame, exact: DataFrame, query_keys: list[str], corpus_key: str = "id") -> DataFrame:
    """Per query: share of the exact top-k that the approximate top-k found."""
    a = approx.select(*query_keys, corpus_key).withColumn("_found", F.lit(1))
    j = exact.select(*query_keys, corpus_key).join(a, [*query_keys, corpus_key], "left")
    return j.groupBy(*query_keys).agg(F.round(F.avg(F.coalesce("_found", F.lit(0)).cast("double")), 4)
                                      .alias("recall_at_k"))
