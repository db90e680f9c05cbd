"""Claim, query and corpus tables derived from the ``embeddings`` table.

Mapping (every row of the table is used):

* query rows: ``vec_id % 25 <= 2``; ``claim_id = vec_id - vec_id % 25``; ``iteration = vec_id % 25 + 1``
  (the vectors a claim's first, second and third search would use);
* corpus rows: ``vec_id % 25 > 2``, so no query meets itself; ``label`` is the scope;
* a claim's scope is the label of its first query row; its golden clauses are the two smallest corpus
  ids of that label;
* budget by ``(claim_id div 25) % 4`` -> 1, 300, 700, 2000 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLAIM_STRIDE = 25
QUERIES_PER_CLAIM = 3
# fixed values: budgets assigned round-robin to claims
BUDGETS = (1, 300, 700, 2000)


def query_vectors(emb: DataFrame) -> DataFrame:
    m = F.col("vec_id") % CLAIM_STRIDE
    return (emb.where(m < QUERIES_PER_CLAIM)
            .select((F.col("vec_id") - m).alias("claim_id"), (m + 1).cast("int").alias("iteration"),
                    F.col("vec_id").alias("query_vec_id"), "embedding", "label"))


def corpus_vectors(emb: DataFrame) -> DataFrame:
    return (emb.where(F.col("vec_id") % CLAIM_STRIDE >= QUERIES_PER_CLAIM)
            .select(F.col("vec_id").alias("id"), "embedding", "label"))


def budget_expr(claim_col: str = "claim_id"):
    slot = F.floor(F.col(claim_col) / CLAIM_STRIDE) % len(BUDGETS)
    expr = None
    for i, b in enumerate(BUDGETS):
        expr = F.when(slot == i, F.lit(b)) if expr is None else expr.when(slot == i, F.lit(b))
    return expr.cast("int")


def claims(emb: DataFrame) -> DataFrame:
    """One row per claim: claim_id, label (scope), budget."""
    q = query_vectors(emb).where(F.col("iteration") == 1)
    return q.select("claim_id", "label", budget_expr().alias("budget"))


def golden(emb: DataFrame, n_truth: int = 2) -> DataFrame:
    """claim_id, label, ground_truth (sorted array of the ``n_truth`` smallest corpus ids of the label).

    Per label only the ``n_truth`` smallest ids are kept (partial top-n before the shuffle), so a hot
    label never gathers its whole corpus in one task.
    """
    corpus = corpus_vectors(emb).select("label", "id")
    w = Window.partitionBy("label").orderBy("id")
    smallest = (corpus.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_truth)
                .groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("ground_truth")))
    return claims(emb).join(smallest, "label", "left").select(
        "claim_id", "label", F.coalesce("ground_truth", F.array().cast("array<bigint>")).alias("ground_truth"))
