"""Combining ranked lists (AGG-1..3, ORD-1, JON-9, SET-1).

A ranked list set is a long table ``(group, list_no, rank, id, payload...)``: one row per hit, ``list_no`` is
the iteration that produced the list and ``rank`` the 1-based position inside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60  # fixed value: the rank-fusion constant
SCORE_DIGITS = 12  # sums of reciprocals can differ in the last bit by addition order


def rrf(ranked: DataFrame, group: list[str], *, id_col: str = "id", list_col: str = "list_no",
        rank_col: str = "rank", k: int = RRF_K, payload: list[str] = ()) -> DataFrame:
    """AGG-1: reciprocal rank fusion, one row per (group, id).

    ``score`` = sum over lists of 1/(k + rank).  ``first_list``/``first_rank`` give the first place the id
    was seen (lists in order, ranks in order), which breaks score ties; payload columns come from the
    *last* place the id was seen.  Partial aggregation runs before the shuffle, so a hot group only
    sends one row per (group, id) and partition.
    """
    seen = F.struct(F.col(list_col), F.col(rank_col))
    aggs = [F.sum(F.lit(1.0) / (F.lit(k) + F.col(rank_col))).alias("score"),
            F.min(seen).alias("_first")]
    aggs += [F.max_by(F.col(p), seen).alias(p) for p in payload]
    out = ranked.groupBy(*group, id_col).agg(*aggs)
    return (out.withColumn("first_list", F.col("_first")[list_col])
               .withColumn("first_rank", F.col("_first")[rank_col]).drop("_first"))


def fused_order(fused: DataFrame, group: list[str], *, id_col: str = "id", n: int | None = 3,
                rank_col: str = "fused_rank") -> DataFrame:
    """ORD-1: score descending, then first-seen position; keep ``n`` per group (None keeps all)."""
    w = Window.partitionBy(*group).orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("first_list"),
                                           F.col("first_rank"), F.col(id_col))
    out = fused.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= n) if n is not None else out


def min_distance_fusion(ranked: DataFrame, group: list[str], *, id_col: str = "id",
                        distance_col: str = "distance") -> DataFrame:
    """AGG-2: the rejected merge — keep each id's smallest raw distance across lists."""
    return ranked.groupBy(*group, id_col).agg(F.min(distance_col).alias("min_distance"))


def min_distance_order(fused: DataFrame, group: list[str], *, id_col: str = "id", n: int | None = 3,
                       rank_col: str = "fused_rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col("min_distance"), F.col(id_col))
    out = fused.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= n) if n is not None else out


def union_dedup_fusion(ranked: DataFrame, group: list[str], *, id_col: str = "id") -> DataFrame:
    """AGG-3: the rejected union + de-duplication without any score."""
    return ranked.select(*group, id_col).distinct()


def attach_payload(fused: DataFrame, catalog: DataFrame, *, id_col: str = "id") -> DataFrame:
    """JON-9: look the fused ids up in the corpus metadata (equi-join; AQE broadcasts a small side)."""
    return fused.join(catalog, id_col, "left")
