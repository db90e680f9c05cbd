"""Loop trace windows (WIN-2, WIN-3).

A trace has one row per (claim, iteration) with that iteration's top-1 distance (``+inf`` when the search
returned nothing).  Groups are bounded by the iteration cap, so the windows below never hold more than
``max_iterations`` rows per claim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ITERATIONS = 3  # fixed value: hard iteration cap of the loop
INF = float("inf")


def top1_per_iteration(steps: DataFrame, hits: DataFrame, keys: list[str], *, iteration_col="iteration",
                       rank_col="rank", distance_col="distance") -> DataFrame:
    """One row per planned step with its top-1 distance; a step with no hits gets +inf (Q5)."""
    top1 = hits.where(F.col(rank_col) == 1).select(*keys, iteration_col, F.col(distance_col).alias("_d1"))
    return (steps.select(*keys, iteration_col).join(top1, [*keys, iteration_col], "left")
            .withColumn("top1_distance", F.coalesce(F.col("_d1"), F.lit(INF))).drop("_d1"))


def improvement(trace: DataFrame, keys: list[str], *, iteration_col="iteration") -> DataFrame:
    """WIN-2: running best before this step (from +inf) and the strict ``improved`` flag."""
    w = Window.partitionBy(*keys).orderBy(iteration_col).rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.coalesce(F.min("top1_distance").over(w), F.lit(INF))
    return (trace.withColumn("best_before", best_before)
            .withColumn("improved", F.col("top1_distance") < F.col("best_before")))


def early_stop(trace: DataFrame, keys: list[str], *, iteration_col="iteration",
               max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """WIN-3: keep steps up to and including the first non-improving one after the first; cap the count.

    Adds ``stop`` (this step ends the loop).  Expects the columns of :func:`improvement`.
    """
    stop = (~F.col("improved")) & (F.col(iteration_col) > 1)
    w = Window.partitionBy(*keys).orderBy(iteration_col).rowsBetween(Window.unboundedPreceding, -1)
    stopped_before = F.coalesce(F.sum(F.col("_stop").cast("int")).over(w), F.lit(0))
    return (trace.where(F.col(iteration_col) <= max_iterations)
            .withColumn("_stop", stop)
            .withColumn("_sb", stopped_before)
            .where(F.col("_sb") == 0)
            .drop("_sb")
            .withColumnRenamed("_stop", "stop"))
