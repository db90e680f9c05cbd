"""A vector store over a snapshot table, chosen by backend name (UDF-4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citesift.operators.ivf import IvfIndex
from citesift.operators.knn import knn_join
from citesift.operators.lsh import knn_lsh
from citesift.sinks.snapshot import read_snapshot, upsert, write_snapshot


class TableStore:
    """Vectors ``id, embedding, ...`` in a snapshot table under ``root``; exact search."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def upsert(self, rows: DataFrame) -> int:
        """Replace rows with the same ``id``, add the others; returns the snapshot written."""
        return write_snapshot(upsert(read_snapshot(self.spark, self.root), rows, ["id"]), self.root)

    def vectors(self) -> DataFrame:
        table = read_snapshot(self.spark, self.root)
        if table is None:
            raise ValueError(f"nothing was stored under {self.root} yet")
        return table

    def query(self, queries: DataFrame, k: int, *, query_keys: list[str], scope: str | None = None, **settings) -> DataFrame:
        """The ``k`` nearest stored rows of each query, within the query's own ``scope`` value if one is named."""
        return knn_join(queries, self.vectors(), k, query_keys=query_keys, corpus_key="id", scope_col=scope, **settings)


class BucketStore(TableStore):
    """The same table searched approximately, by hashed buckets."""

    def query(self, queries: DataFrame, k: int, *, query_keys: list[str], scope: str | None = None, **settings) -> DataFrame:
        if scope is not None:
            raise ValueError("the bucket store searches without a scope")
        return knn_lsh(queries, self.vectors(), k, query_keys=query_keys, corpus_key="id", **settings)


class ListStore:
    """Vectors in inverted lists, searched approximately; the first upsert trains the lists and measures the probes."""

    def __init__(self, spark: SparkSession, root: str):
        self.index = IvfIndex(spark, root)

    def upsert(self, rows: DataFrame) -> int:
        if self.index.centres is None:
            self.index.build(rows)
            return 1
        return self.index.upsert(rows)

    def vectors(self) -> DataFrame:
        return self.index.vectors()

    def query(self, queries: DataFrame, k: int, *, query_keys: list[str], scope: str | None = None, **settings) -> DataFrame:
        if scope is not None:
            raise ValueError("the list store searches without a scope")
        if self.index.probes is None:
            self.index.tune(queries, k, query_keys=query_keys)
        return self.index.search(queries, k, query_keys=query_keys, **settings)


STORES: dict[str, Callable[[SparkSession, str], TableStore | ListStore]] = {"table": TableStore, "buckets": BucketStore, "lists": ListStore}


def get_store(name: str, spark: SparkSession, root: str) -> TableStore | ListStore:
    if name not in STORES:
        raise ValueError(f"unknown vector store {name!r}; known: {sorted(STORES)}")
    return STORES[name](spark, root)
