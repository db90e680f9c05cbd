"""Approximate nearest neighbours by inverted lists (JON-3, UDF-4).

A coarse quantiser (k-means centres, trained on a bounded sample) deals every vector into the list of its nearest
centre.  A query is searched in the ``probes`` lists whose centres are nearest, inside each by the exact blocked kernel of
:func:`citesift.operators.knn.knn_join`, so a crowded list is split like any other scope.  A query's candidates are
the rows of its probes: about ``probes / lists`` of the table.

How many probes are needed is measured, not guessed: :meth:`IvfIndex.tune` compares a bounded set of queries with the exact
search and doubles the probes until the recall floor holds (all lists are the exact search).

Rows are stored in the order of their lists, one folder per upsert, so a list is a run of row groups and a long one may span
files.  An upsert writes its own rows and the keys of the rows they replace; nothing that is stored is rewritten, and a
folder counts only once its marker is there.  The centres are stored too, so an index can be opened again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citesift.operators.knn import knn_join
from citesift.session import cut_lineage
from citesift.sinks.snapshot import committed_epochs, commit_epoch

# bounds: rows the quantiser is trained on, lists, and queries that recall is measured with
TRAIN_ROWS = 1 << 16
MOST_LISTS = 4096
TUNE_QUERIES = 256


def train_centres(vectors: DataFrame, lists: int, *, key: str = "id", vector_col: str = "embedding", rows: int = TRAIN_ROWS, seed: int = 7) -> np.ndarray:
    """``lists`` k-means centres (fewer if there are fewer different vectors) of at most about ``rows`` vectors, chosen by a hash of their key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    chosen = vectors if n <= rows else vectors.where(F.pmod(F.xxhash64(key), F.lit(math.ceil(n / rows))) == 0)
    points = cut_lineage(chosen.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")))
    if points.isEmpty():
        return np.zeros((0, 0))
    if lists < 2:
        from pyspark.ml.stat import Summarizer

        return np.asarray([points.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()])
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(points)
    return np.stack(model.clusterCenters())


def nearest_lists(centres: np.ndarray, probes: int):
    """A column function: the numbers of the ``probes`` nearest centres, nearest first."""
    norms = np.einsum("ij,ij->i", centres, centres)
    probes = min(probes, len(centres))

    @F.pandas_udf("array<int>")
    def lists(vecs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vecs:
            if s.empty:
                yield pd.Series([], dtype=object)
                continue
            out = []
            # distances to all centres of a bounded number of rows at a time
            step = max(1, (1 << 20) // len(centres))
            for a in range(0, len(s), step):
                m = np.stack(s.iloc[a:a + step].to_numpy()).astype(np.float64)
                far = norms - 2.0 * (m @ centres.T)
                near = np.argpartition(far, probes - 1, axis=1)[:, :probes]
                order = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
                out += list(np.take_along_axis(near, order, axis=1).astype(np.int32))
            yield pd.Series(out)

    return lists


class IvfIndex:
    """Vectors ``id, embedding`` in inverted lists under ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, key: str = "id", vector_col: str = "embedding"):
        self.spark, self.root, self.key, self.vector_col = spark, root, key, vector_col
        self.probes: int | None = None
        self.centres: np.ndarray | None = None
        if committed_epochs(spark, root):
            rows = spark.read.parquet(f"{root}/centres").collect()
            self.centres = np.array([r["centre"] for r in sorted(rows, key=lambda r: r["list"])])

    def build(self, vectors: DataFrame, lists: int | None = None) -> IvfIndex:
        """Train the quantiser on ``vectors`` and store all of them; null vectors are not stored."""
        given = vectors.where(F.col(self.vector_col).isNotNull())
        if lists is None:
            lists = max(1, min(MOST_LISTS, round(math.sqrt(given.count()))))
        self.centres = train_centres(given, lists, key=self.key, vector_col=self.vector_col)
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centres)], "list int, centre array<double>").write.mode(
            "overwrite").parquet(f"{self.root}/centres")
        self.upsert(given)
        return self

    def upsert(self, rows: DataFrame) -> int:
        """Add ``rows``, or replace the stored rows of the same key; returns the number of the upsert.

        Rows of ``rows`` that share a key are all stored, as one table of vectors would have them.
        """
        done = committed_epochs(self.spark, self.root)
        n = max(done, default=0) + 1
        rows = cut_lineage(rows.where(F.col(self.vector_col).isNotNull()).select(self.key, self.vector_col))
        if done:
            gone = self._rows().select(self.key, "epoch").join(rows.select(self.key).distinct(), self.key, "left_semi")
            gone.distinct().write.mode("overwrite").parquet(f"{self.root}/replaced/by={n}")
        order = ["list", self.key]
        self._dealt(rows).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.root}/lists/epoch={n}")
        commit_epoch(self.spark, self.root, n)
        return n

    def _dealt(self, rows: DataFrame) -> DataFrame:
        if self.centres is None or not len(self.centres):
            return rows.withColumn("list", F.lit(0))
        return rows.withColumn("list", nearest_lists(self.centres, 1)(F.col(self.vector_col))[0])

    def _rows(self) -> DataFrame:
        """``list, id, embedding, epoch`` of the live rows."""
        done = committed_epochs(self.spark, self.root)
        parts = [f"{self.root}/lists/epoch={n}" for n in done]
        table = self.spark.read.option("basePath", f"{self.root}/lists").parquet(*parts)
        table = table.select("list", self.key, self.vector_col, F.col("epoch").cast("int").alias("epoch"))
        dead = [f"{self.root}/replaced/by={n}" for n in done if n > min(done)]
        if not dead:
            return table
        return table.join(self.spark.read.parquet(*dead).distinct(), [self.key, "epoch"], "left_anti")

    def vectors(self) -> DataFrame:
        """All live rows."""
        return self._rows().select(self.key, self.vector_col)

    def search(self, queries: DataFrame, k: int, *, query_keys: list[str], probes: int | None = None, round_digits: int | None = None) -> DataFrame:
        """``query_keys, id, distance, rank``: the ``k`` nearest rows of each query in its ``probes`` nearest lists.

        ``probes`` defaults to the tuned number; without one every list is searched, which is exact.
        """
        queries = queries.where(F.col(self.vector_col).isNotNull()).select(*query_keys, self.vector_col)
        if self.centres is None or not len(self.centres):
            return knn_join(queries, self.vectors(), k, query_keys=query_keys, corpus_key=self.key, vector_col=self.vector_col, round_digits=round_digits)
        probes = probes or self.probes or len(self.centres)
        # all lists need no order, so no row of all their numbers is made in Python
        every = F.sequence(F.lit(0), F.lit(len(self.centres) - 1))
        asked = queries.withColumn("list", F.explode(
            every if probes >= len(self.centres) else nearest_lists(self.centres, probes)(F.col(self.vector_col))))
        asked = cut_lineage(asked.withColumn("_in", F.col("list")))
        # a row is in one list: the cut to k within a list loses nothing that the query could keep
        per_list = knn_join(asked, self._rows(), k, query_keys=[*query_keys, "_in"], corpus_key=self.key, vector_col=self.vector_col, scope_col="list")
        w = Window.partitionBy(*query_keys).orderBy(F.col("distance"), F.col(self.key))
        best = per_list.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if round_digits is not None:
            best = best.withColumn("distance", F.round("distance", round_digits))
        return best.select(*query_keys, self.key, "distance", "rank")

    def tune(self, queries: DataFrame, k: int, *, query_keys: list[str], floor: float = 0.95, most: int = TUNE_QUERIES) -> float:
        """Set ``probes`` to the fewest, in powers of two, that reach the recall ``floor`` over at most about ``most`` queries; returns that recall."""
        n = queries.count()
        if self.centres is None or not len(self.centres) or not n:
            return 1.0
        chosen = cut_lineage(queries if n <= most else queries.where(F.pmod(F.xxhash64(*query_keys), F.lit(math.ceil(n / most))) == 0))
        exact = cut_lineage(knn_join(chosen, self.vectors(), k, query_keys=query_keys, corpus_key=self.key, vector_col=self.vector_col).select(
            *query_keys, self.key))
        self.probes = 1
        while True:
            got = recall(self.search(chosen, k, query_keys=query_keys), exact, query_keys, self.key)
            if got >= floor or self.probes >= len(self.centres):
                return got
            self.probes = min(2 * self.probes, len(self.centres))


def recall(found: DataFrame, exact: DataFrame, query_keys: list[str], key: str = "id") -> float:
    """Share of the rows of ``exact`` that are in ``found`` (1 if there are none)."""
    hit = found.select(*query_keys, key).distinct().withColumn("hit", F.lit(1))
    r = exact.select(*query_keys, key).join(hit, [*query_keys, key], "left").agg(F.count("hit").alias("a"), F.count(F.lit(1)).alias("b")).first()
    return r["a"] / r["b"] if r["b"] else 1.0
