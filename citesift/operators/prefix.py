"""Running sums inside a group without gathering the group into one task (WIN-4).

``sum() over (partition by k order by o)`` puts a whole group into one task.  Here rows are spread by ranges of the whole
order, written once, and summed in three steps:

1. inside each run (the rows of one group in one range) a plain window; a run is never more than one range;
2. per run its row count and its sum, and with a window over that small table (at most ranges + groups rows) those of the
   same group's earlier ranges;
3. both joined: place and running sum of every row.  A hot group's rows are spread over ranges, so neither the window of
   step 1 nor the join has one key that holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.session import cut_lineage


def prefix_within(df: DataFrame, keys: list[str], order: list[str], value: Column, *, seq: str = "seq", total: str = "running") -> DataFrame:
    """``df`` with ``seq``, the row's place from 1 in its group, and ``total``, the sum of ``value`` up to and including the row.

    ``order`` must be a total order inside a group.  A null key is a group like any other, a null value counts as 0.
    """
    sort_keys = [*keys, *order]
    tagged = df.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys).withColumn(
        "_tag", F.monotonically_increasing_id())
    # range bounds are sampled anew by each execution: everything below reads this one copy
    tagged = cut_lineage(tagged).withColumn("_range", F.shiftright("_tag", 33))
    run = Window.partitionBy("_range", *keys).orderBy("_tag").rowsBetween(Window.unboundedPreceding, 0)
    inner = tagged.withColumn(seq, F.count(F.lit(1)).over(run)).withColumn(total, F.sum("_value").over(run))
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = tagged.groupBy(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_s"))
    offsets = runs.select("_r", *[f"_k{i}" for i in range(len(keys))], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                          F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_spent"))
    same = [F.col("_range") == F.col("_r")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return inner.join(offsets, same).select(
        *df.columns, (F.col(seq) + F.col("_before")).alias(seq), (F.col(total) + F.col("_spent")).alias(total))
