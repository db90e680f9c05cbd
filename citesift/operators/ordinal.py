"""Row position inside a group without gathering the group into one task.

``row_number() over (partition by k order by o)`` puts every row of a key into one task; if one key holds a
third of all rows that task holds a third of the data.  :func:`ordinal_within` computes the same number
in three steps that all stay spread over the cluster and never leave the JVM:

1. range-partition on ``(k, o)`` (sampled bounds; a hot key spans many partitions), sort inside each,
   tag every row with ``monotonically_increasing_id()`` (partition index in the high bits, position inside
   the sorted partition in the low bits) and write the result once as a reliable checkpoint;
2. per (partition, key) run: its row count and its first tag — at most ``partitions + distinct keys``
   small rows, partially aggregated — and, with a window over that small table, the rows of the same key
   in earlier partitions;
3. join the run table back: ``ordinal = tag - first tag of the run + 1 + rows in earlier partitions``.
   AQE broadcasts the run table when its measured size is small, otherwise it is an ordinary shuffle join
   on (partition, key), which a hot key cannot skew because its rows are spread over many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.session import ensure_checkpoint_dir


# fixed value: the largest group one task may number on its own with a plain window
WINDOW_GROUP_ROWS = 100_000


def largest_group(df: DataFrame, partition_cols: list[str]) -> int:
    """Rows in the biggest group: a partially aggregated count per key, then one scalar to the driver."""
    row = df.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("m")).first()
    return int(row["m"] or 0) if row is not None else 0


def ordinal_within(df: DataFrame, partition_cols: list[str], order_cols: list[str | Column], *,
                   name: str = "ordinal", num_partitions: int | None = None, group_bound: int | None = None,
                   max_window_rows: int = WINDOW_GROUP_ROWS) -> DataFrame:
    """1-based position of each row inside its ``partition_cols`` group in ``order_cols`` order.

    ``order_cols`` must be a total order inside a group (end with a unique key) so the numbering is
    deterministic and identical on re-execution after a lost executor.

    When the biggest group is proven small (``group_bound``, a bound the caller already holds, or else
    measured here) the plain ``row_number()`` window is used: one shuffle, no written copy.  Beyond
    ``max_window_rows`` the range-partitioned path below takes over.  Both give the same numbers.
    """
    if group_bound is None:
        group_bound = largest_group(df, partition_cols)
    if group_bound <= max_window_rows:
        w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_keys = [*partition_cols, *order_cols]
    # range bounds are sampled per execution, so the tagged rows are written once (reliable checkpoint in
    # the shared checkpoint folder) and both the run table and the numbering read that same copy
    ensure_checkpoint_dir(spark)
    tagged = (df.repartitionByRange(n, *sort_keys).sortWithinPartitions(*sort_keys)
              .withColumn("_tag", F.monotonically_increasing_id())).checkpoint(eager=True)
    pid = F.shiftright("_tag", 33).alias("_pid")
    runs = tagged.groupBy(pid, *partition_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_tag").alias("_first"))
    before = Window.partitionBy(*partition_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    deltas = runs.select(F.col("_pid").alias("_rpid"), *[F.col(k).alias(f"_r_{k}") for k in partition_cols],
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_delta"))
    rows = tagged.withColumn("_pid", F.shiftright("_tag", 33))
    # null-safe on the keys: a null key is a group like any other
    cond = [F.col("_pid") == F.col("_rpid")] + [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in partition_cols]
    return (rows.join(deltas, cond)
            .withColumn(name, (F.col("_tag") + F.col("_delta")).cast("bigint"))
            .drop("_pid", "_tag", "_delta", "_rpid", *[f"_r_{k}" for k in partition_cols]))
