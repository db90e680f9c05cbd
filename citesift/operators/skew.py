"""Skewed key assignment and hot-key share (PRJ-12, AGG-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_FRACTION = 0.05  # fixed value: share of keys that are hot
HOT_WEIGHT = 0.6  # fixed value: share of draws that land on hot keys


def _unit(*cols: Column) -> Column:
    """A uniform draw in [0, 1) from a hash of the row key and seed (stable under recomputation)."""
    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double")) / float(1 << 52)


def skewed_assignment(rows: DataFrame, row_key: str, n_slots: int, *, seed: int = 42,
                      hot_fraction: float = HOT_FRACTION, hot_weight: float = HOT_WEIGHT) -> DataFrame:
    """PRJ-12: map every row to one of ``n_slots`` slots; the first ``max(1, int(n * hot_fraction))`` slots
    receive ``hot_weight`` of the rows.  Hash-seeded instead of ``rand(seed)`` so a re-run or a lost task
    recomputes the same assignment whatever the partitioning."""
    n_hot = max(1, int(n_slots * hot_fraction))
    n_cold = max(1, n_slots - n_hot)
    k, s = F.col(row_key), F.lit(seed)
    hot = _unit(k, s, F.lit("draw")) < hot_weight
    hot_slot = F.pmod(F.xxhash64(k, s, F.lit("hot")), F.lit(n_hot))
    cold_slot = (F.lit(n_hot) if n_slots > n_hot else F.lit(0)) + F.pmod(F.xxhash64(k, s, F.lit("cold")), F.lit(n_cold))
    return rows.select(k, F.when(hot, hot_slot).otherwise(cold_slot).cast("bigint").alias("slot"))


def hot_key_share(df: DataFrame, key: str, hot_fraction: float = HOT_FRACTION) -> DataFrame:
    """AGG-11: share of rows on the hottest ``max(1, int(keys * hot_fraction))`` keys.

    Counts per key are partially aggregated; the ranking then runs over the *histogram* of counts (one row
    per distinct count value, at most about sqrt(2 * rows) of them), never over the keys themselves, so no
    single task ever sorts all keys.  Ties between equal counts do not change the sum.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hist = per_key.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy(F.lit(0))
    higher = Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = (hist.withColumn("n_keys", F.sum("m").over(whole))
         .withColumn("total", F.sum(F.col("n") * F.col("m")).over(whole))
         .withColumn("keys_above", F.coalesce(F.sum("m").over(higher), F.lit(0))))
    n_hot = F.greatest(F.lit(1), F.floor(F.col("n_keys") * hot_fraction))
    take = F.least(F.col("m"), F.greatest(F.lit(0), n_hot - F.col("keys_above")))
    h = h.withColumn("_hot_rows", take * F.col("n")).withColumn("_n_hot", n_hot)
    return h.agg(F.max("n_keys").cast("bigint").alias("n_keys"), F.max("_n_hot").cast("bigint").alias("n_hot"),
                 F.sum("_hot_rows").cast("bigint").alias("hot_rows"), F.max("total").cast("bigint").alias("total_rows"),
                 F.round(F.sum("_hot_rows") / F.max("total"), 4).alias("hot_share"))
