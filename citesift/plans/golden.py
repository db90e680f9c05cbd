"""Evaluation against golden labels taken from texts (SRC-6, JOB-5, AGG-5..7, AGG-13, AGG-14).

A question's golden clauses are the clauses that hold it word for word.  Labels are rows ``claim_id, id``, never a list
per claim, so hits and truth are counted by joins and partial aggregates whatever a claim's number of labels is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators.containment import contained_in


def golden_from_text(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """``claim_id, id``: the clauses of ``clauses (id, text)`` that hold the question of a claim."""
    return contained_in(claims.select("claim_id", F.col("question").alias("text")), clauses.select("id", "text"),
                        passage_key="claim_id", doc_key="id")


def scored_by_labels(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``outcomes (mode, claim_id, status, iterations, citations)`` whose claim has a label: ``n_predicted, n_hits,
    n_truth, precision`` (AGG-5).  A citation counts each time it is given, and no citations give a precision of 0."""
    truth = labels.groupBy("claim_id").agg(F.count(F.lit(1)).cast("int").alias("n_truth"))
    cited = outcomes.select("mode", "claim_id", F.explode("citations").alias("id"))
    hits = cited.join(labels.select("claim_id", "id"), ["claim_id", "id"]).groupBy("mode", "claim_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_hits"))
    n = F.size("citations")
    return outcomes.join(truth, "claim_id").join(hits, ["mode", "claim_id"], "left").select(
        "mode", "claim_id", "status", "iterations", n.alias("n_predicted"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "n_truth",
        F.when(n == 0, 0.0).otherwise(F.coalesce("n_hits", F.lit(0)) / n).alias("precision"))


def label_check(claims: DataFrame, labels: DataFrame, clauses: DataFrame) -> DataFrame:
    """AGG-13: claims, claims without a label, labels that are no clause, and whether both are none."""
    known = clauses.select("id").distinct().withColumn("known", F.lit(1))
    unknown = labels.join(known, "id", "left").agg(F.count_if(F.col("known").isNull()).alias("n_unknown_labels"))
    bare = claims.join(labels.select("claim_id").distinct().withColumn("labelled", F.lit(1)), "claim_id", "left").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("labelled").isNull()).alias("n_unlabelled"))
    # one row on either side
    return bare.withColumn("k", F.lit(1)).join(unknown.withColumn("k", F.lit(1)), "k").select(
        "n_claims", "n_unlabelled", "n_unknown_labels", ((F.col("n_unlabelled") == 0) & (F.col("n_unknown_labels") == 0)).alias("passed"))


def retrieval_share(hits: DataFrame, labels: DataFrame, pass_at: float = 0.8) -> DataFrame:
    """AGG-14: share of labelled claims that have a golden clause among ``hits (claim_id, id)``, and whether it is enough."""
    found = hits.join(labels, ["claim_id", "id"], "left_semi").select("claim_id").distinct().withColumn("found", F.lit(1))
    per = labels.select("claim_id").distinct().join(found, "claim_id", "left")
    share = F.coalesce(F.try_divide(F.count("found"), F.count(F.lit(1))), F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("n_claims"), F.count("found").alias("n_found"), F.round(share, 4).alias("share"),
                   (share >= pass_at).alias("passed"))
