"""Places in a total order, spread over the cluster by ranges."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.shared import Tables

_LOW = (1 << 33) - 1


def numbered(tables: Tables, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of the columns ``order`` (nulls first).

    The sorted rows are written as table ``name``, each with its range and its place there.
    """
    tagged = tables.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "tag", F.monotonically_increasing_id()), name)
    # two numbers a range, and no more ranges than shuffle partitions
    counts = sorted(map(tuple, tagged.groupBy(range_of("tag")).agg(F.count(F.lit(1))).collect()))
    before = [0, *accumulate(n for _, n in counts)]
    bases = rows.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(counts, before)], "range bigint, base bigint")
    return tagged.withColumn("range", range_of("tag")).join(F.broadcast(bases), "range").withColumn(
        "place", F.col("base") + F.col("tag").bitwiseAND(F.lit(_LOW))).drop("range", "tag", "base")


def range_of(tag: str) -> Column:
    """The range's number in a ``monotonically_increasing_id``."""
    return F.shiftright(tag, 33)
