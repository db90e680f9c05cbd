"""Evaluation against golden labels (JON-5, AGG-5..7, AGG-13, AGG-14, JON-8, SET-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def citation_hits(outcomes: DataFrame, golden: DataFrame, keys=("claim_id",)) -> DataFrame:
    """JON-5: one row per predicted citation with its position and whether it is a golden clause."""
    keys = list(keys)
    return (outcomes.join(golden.select(*keys, "ground_truth"), keys, "left")
            .select(*keys, F.posexplode("citations").alias("pos", "id"), "ground_truth")
            .select(*keys, (F.col("pos") + 1).cast("int").alias("position"), "id",
                    F.coalesce(F.array_contains("ground_truth", F.col("id")), F.lit(False)).alias("is_hit")))


def precision(outcomes: DataFrame, golden: DataFrame, keys=("claim_id",)) -> DataFrame:
    """AGG-5: hits / number of citations actually returned (duplicates count twice); none -> 0.0."""
    keys = list(keys)
    truth = F.coalesce(F.col("ground_truth"), F.array().cast("array<bigint>"))
    hits = F.size(F.filter("citations", lambda c: F.array_contains(truth, c)))
    n = F.size("citations")
    return (outcomes.join(golden.select(*keys, "ground_truth"), keys, "left")
            .select(*keys, "status", "iterations",
                    n.cast("int").alias("n_predicted"), hits.cast("int").alias("n_hits"),
                    F.size(truth).cast("int").alias("n_truth"),
                    F.when(n == 0, F.lit(0.0)).otherwise(hits / n).alias("precision")))


def summary(scored: DataFrame, group=("mode",)) -> DataFrame:
    """AGG-7 + AGG-6 per mode: claims, answered, mean precision (4 dp), mean iterations (2 dp),
    claims with >= 1 correct citation, and micro clause recall."""
    group = list(group)
    return (scored.groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n_claims"),
                 F.count_if(F.col("status") == "answered").alias("n_answered"),
                 F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 4).alias("citation_precision_at_k"),
                 F.round(F.coalesce(F.avg("iterations"), F.lit(0.0)), 2).alias("avg_iterations"),
                 F.count_if(F.col("precision") > 0).alias("n_hit"),
                 F.sum("n_hits").cast("bigint").alias("sum_hits"),
                 F.sum("n_truth").cast("bigint").alias("sum_truth")))


def golden_check(golden: DataFrame, corpus_ids: DataFrame, keys=("claim_id",), id_col="id") -> DataFrame:
    """AGG-13: every claim has >= 1 label and every label is a real corpus id (one summary row)."""
    keys = list(keys)
    known = corpus_ids.select(id_col).distinct().withColumn("_known", F.lit(True))
    labels = golden.select(*keys, F.explode("ground_truth").alias(id_col)).join(known, id_col, "left")
    unknown = labels.groupBy(*keys).agg(F.count_if(F.col("_known").isNull()).alias("_unknown"))
    per_claim = golden.select(*keys, F.size("ground_truth").alias("_n")).join(unknown, keys, "left")
    return (per_claim.agg(F.count(F.lit(1)).alias("n_claims"),
                          F.count_if(F.col("_n") < 1).alias("n_unlabelled"),
                          F.coalesce(F.sum("_unknown"), F.lit(0)).cast("bigint").alias("n_unknown_labels"))
            .withColumn("passed", (F.col("n_unlabelled") == 0) & (F.col("n_unknown_labels") == 0)))
