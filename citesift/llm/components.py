"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm.shared import Tables


def components(tables: Tables, links: DataFrame, name: str = "links") -> DataFrame:
    """``node, component`` (the component's smallest node) for every node of ``links (a, b)``.

    A step joins every node's larger neighbours, then its smaller ones, to the smallest neighbour; the links
    turn into stars in a number of steps that grows with the logarithm of the longest path.  Each step is a
    partially aggregated minimum and one join that splits where a node has very many links.
    """
    stars = tables.write(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct(), f"{name}0")
    for step in count(1):
        both = stars.select(F.col("big").alias("u"), F.col("small").alias("v")).union(stars.select("small", "big"))
        # done when every node has links to one side only, and one link if that side is the smaller one
        below = F.when(F.col("v") < F.col("u"), 1).otherwise(0)
        if not both.groupBy("u").agg(F.sum(below).alias("n"), F.min(below).alias("least")).where(
                "n > 1 or (n = 1 and least = 0)").limit(1).count():
            break
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        first = large.groupBy("big").agg(F.min("small").alias("m"))
        moved = large.join(first, "big").where(F.col("small") != F.col("m")).select(F.col("small").alias("big"), F.col("m").alias("small"))
        stars = tables.write(moved.union(first).distinct(), f"{name}{step}")
        tables.drop(f"{name}{step - 1}")
    return stars.select(F.col("big").alias("node"), F.col("small").alias("component")).union(
        stars.select("small", "small").distinct())
