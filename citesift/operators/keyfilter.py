"""Rows whose key may be in another table, told without a shuffle: a table of bits by the keys' hashes, of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# bits a key if there is room, and bits at most (16 MB, sent to every executor)
BITS_A_KEY, MOST_BITS = 16, 1 << 27


def may_hold(keys: DataFrame, cols: list[str]) -> Column:
    """A condition on rows with the columns ``cols``: false only where no row of ``keys`` has these values.

    Beyond ``MOST_BITS`` ever more rows pass that have no equal, so what must be exact joins the rows that pass.
    """
    spark = keys.sparkSession
    bits = min(MOST_BITS, 1 << max(13, (BITS_A_KEY * keys.count()).bit_length()))
    at = F.xxhash64(*cols).bitwiseAND(F.lit(bits - 1))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 3).cast("int").alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).cast("short").alias("bits")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[words["byte"].to_numpy()] = words["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def among(places: pa.Array) -> pa.Array:
        place = places.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)

    return among(at)
