"""The bounded plan -> retrieve -> observe loop over a whole table of claims (JOB-3) and the single-shot
baseline (JOB-4), in closed form.

When every claim's search vectors for iterations 1..3 are known up front, the loop outcome is a set of
window computations over (claim, iteration) rows:

* trace: top-1 distance per iteration, running best from +inf, strict ``improved`` (WIN-2);
* the loop runs up to the first non-improving iteration after the first, at most 3 (WIN-3);
* the gate runs before every iteration the loop reaches, spending first and then comparing; the first
  refusal ends the claim as ``budget_exhausted`` with ``iterations`` = the refused iteration (WIN-4);
* otherwise the ranked lists of the iterations that ran are fused by RRF and the top 3 cited (AGG-1, ORD-1).

Every group is bounded by the iteration cap, so no claim ever gathers more than 3 x k rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators import fusion
from citesift.operators.budget import COST_PER_CALL, sequential_gate
from citesift.operators.trace import MAX_ITERATIONS, early_stop, improvement, top1_per_iteration
from citesift.session import cut_lineage

ANSWER_K = 3  # fixed value: citations in an answer


def loop_trace(steps: DataFrame, hits: DataFrame, keys=("claim_id",)) -> DataFrame:
    keys = list(keys)
    return improvement(top1_per_iteration(steps, hits, keys), keys)


def run_loop(steps: DataFrame, hits: DataFrame, claims: DataFrame, keys=("claim_id",), *,
             cost=COST_PER_CALL, answer_k: int = ANSWER_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (outcomes, kept_trace, fused_top).

    ``steps``: planned (claim, iteration) rows; ``hits``: (claim, iteration, id, distance, rank);
    ``claims``: (claim, budget).  ``outcomes`` has one row per claim: status, iterations, tokens_spent,
    citations (array, fused order; empty unless answered).
    """
    keys = list(keys)
    # the hits feed both the trace and the fusion; the k-NN behind them is the costliest step and Spark
    # cannot share a pandas kernel's output between two branches, so it is written once (Q x k rows)
    hits = cut_lineage(hits)
    kept = early_stop(loop_trace(steps, hits, keys), keys)
    gated = sequential_gate(kept.join(claims.select(*keys, "budget"), keys), keys, ["iteration"],
                            cost=cost, budget=F.col("budget"), max_calls=MAX_ITERATIONS)
    per = (gated.groupBy(*keys)
           .agg(F.max("iteration").alias("last_iter"),
                F.max("tokens_spent").alias("tokens_spent"),
                F.min(F.when(~F.col("within_budget"), F.col("iteration"))).alias("refused_at")))
    answered = per.where(F.col("refused_at").isNull()).select(*keys, "last_iter")
    to_fuse = hits.join(answered, keys).where(F.col("iteration") <= F.col("last_iter")).drop("last_iter")
    fused = fusion.rrf(to_fuse, keys, list_col="iteration", rank_col="rank")
    top = fusion.fused_order(fused, keys, n=answer_k)
    cites = (top.groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct("fused_rank", "id"))).alias("_c"))
             .select(*keys, F.transform("_c", lambda s: s["id"]).alias("citations")))
    exhausted = F.col("refused_at").isNotNull()
    outcomes = (per.join(cites, keys, "left")
                .select(*keys,
                        F.when(exhausted, F.lit("budget_exhausted")).otherwise(F.lit("answered")).alias("status"),
                        F.coalesce("refused_at", "last_iter").cast("int").alias("iterations"),
                        F.col("tokens_spent").cast("bigint").alias("tokens_spent"),
                        F.when(exhausted, F.array().cast("array<bigint>"))
                         .otherwise(F.coalesce("citations", F.array().cast("array<bigint>"))).alias("citations")))
    # trace rows recorded: up to the last iteration that passed the gate (Q3)
    trace = (kept.join(per.select(*keys, "refused_at", "last_iter"), keys)
             .where(F.col("iteration") < F.coalesce(F.col("refused_at"), F.col("last_iter") + 1))
             .drop("refused_at", "last_iter"))
    return outcomes, trace, top


def single_shot(hits_k: DataFrame, keys=("claim_id",)) -> DataFrame:
    """JOB-4: one retrieval with k = 3 on the claim as written, no gate, no trace."""
    keys = list(keys)
    cites = (hits_k.groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_c"))
             .select(*keys, F.transform("_c", lambda s: s["id"]).alias("citations")))
    return cites.select(*keys, F.lit("answered").alias("status"), F.lit(1).cast("int").alias("iterations"),
                        F.lit(0).cast("bigint").alias("tokens_spent"), "citations")
