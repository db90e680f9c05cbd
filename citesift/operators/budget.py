"""Spend counter and budget gate (AGG-4, WIN-4, FLT-2).

The reference keeps one atomic counter per claim that every gate call increments *before* comparing
(``spent <= budget`` is allowed, inclusive; a refused call still spends).  Here the counter is a
commutative sum over a table of gate calls, de-duplicated on the call key so a retried delivery is
counted once, and the sequential gate is a running sum in call order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.operators.prefix import prefix_within

COST_PER_CALL = 300  # fixed value: flat spend per gate call
DEFAULT_BUDGET = 2000  # fixed value: budget when the caller gives none


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def spend_counter(calls: DataFrame, claim_keys: list[str], call_key: str, *, cost=COST_PER_CALL) -> DataFrame:
    """AGG-4: exact total spend per claim under retries: de-duplicate on (claim, call), then sum.

    The sum is partially aggregated before the shuffle, so a claim holding a large share of all calls
    still sends one row per partition.
    """
    once = calls.dropDuplicates([*claim_keys, call_key])
    return (once.groupBy(*claim_keys)
            .agg(F.count(F.lit(1)).alias("calls"), F.sum(_col(cost)).cast("bigint").alias("tokens_spent")))


def within_budget(spent: Column, budget: Column | None = None) -> Column:
    """FLT-2: inclusive test, missing budget -> the default."""
    b = F.coalesce(budget, F.lit(DEFAULT_BUDGET)) if budget is not None else F.lit(DEFAULT_BUDGET)
    return spent <= b


def max_calls_bound(calls: DataFrame, *, cost=COST_PER_CALL, budget=DEFAULT_BUDGET) -> int | None:
    """Exact upper bound on how many calls of one claim the gate can see before its first refusal.

    Each call spends at least ``min_cost`` > 0, so after ``floor(max_budget / min_cost) + 1`` calls the
    running spend is above every budget and the claim has been refused.  Returns None when costs may be
    zero (no bound exists).
    """
    if not isinstance(cost, Column) and not isinstance(budget, Column):
        return max(0, math.floor((DEFAULT_BUDGET if budget is None else budget) / cost)) + 1 if cost > 0 else None
    # the same default as the gate's own test, so a claim without a budget counts with it here too; a
    # negative budget still has its one refused call
    row = calls.agg(F.min(_col(cost)).alias("c"), F.max(F.coalesce(_col(budget), F.lit(DEFAULT_BUDGET))).alias("b")).first()
    if row is None or row["c"] is None or row["c"] <= 0:
        return None
    return max(0, math.floor(row["b"] / row["c"])) + 1


def sequential_gate(calls: DataFrame, claim_keys: list[str], order_cols: list[str], *,
                    cost=COST_PER_CALL, budget=DEFAULT_BUDGET, prior=0, max_calls: int | None = None) -> DataFrame:
    """WIN-4: gate the calls of each claim in order; the first refusal ends the claim.

    Returns the calls that happen (all up to and including the first refusal) with ``seq``,
    ``tokens_spent`` (running, after this call) and ``within_budget``.

    Only the first ``max_calls_bound`` calls of a claim can matter, so ``row_number() <= bound`` is
    applied first: Spark turns it into a partial WindowGroupLimit that trims every partition before the
    shuffle, and a hot claim never moves more than ``bound`` rows per partition into its window.
    ``max_calls`` overrides the bound when the caller already knows one (the loop's iteration cap).  Costs that may
    be zero give no bound; then the running spend is a prefix sum over ranges, and no claim is gathered in one task.
    """
    bound = max_calls if max_calls is not None else max_calls_bound(calls, cost=cost, budget=budget)
    if bound is None:
        return _gate_by_prefix(calls, claim_keys, order_cols, cost=cost, budget=budget, prior=prior)
    w = Window.partitionBy(*claim_keys).orderBy(*order_cols)
    seq = calls.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= bound)
    run = Window.partitionBy(*claim_keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*claim_keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    gated = (seq.withColumn("tokens_spent", (_col(prior) + F.sum(_col(cost)).over(run)).cast("bigint"))
             .withColumn("within_budget", F.col("tokens_spent") <= F.coalesce(_col(budget), F.lit(DEFAULT_BUDGET))))
    refused_before = F.coalesce(F.sum((~F.col("within_budget")).cast("int")).over(before), F.lit(0))
    return gated.withColumn("_rb", refused_before).where(F.col("_rb") == 0).drop("_rb")


def _gate_by_prefix(calls: DataFrame, claim_keys: list[str], order_cols: list[str], *, cost, budget, prior) -> DataFrame:
    """The gate over any number of calls of a claim: places and spends from ranges, then each claim's first refusal."""
    placed = prefix_within(calls, claim_keys, order_cols, _col(cost), seq="seq", total="tokens_spent")
    spent = placed.withColumn("seq", F.col("seq").cast("int")).withColumn(
        "tokens_spent", (_col(prior) + F.col("tokens_spent")).cast("bigint")).withColumn(
        "within_budget", F.col("tokens_spent") <= F.coalesce(_col(budget), F.lit(DEFAULT_BUDGET)))
    # one partially aggregated number a claim
    names = [f"_k{i}" for i in range(len(claim_keys))]
    first = spent.where(~F.col("within_budget")).groupBy(*[F.col(k).alias(n) for k, n in zip(claim_keys, names)]).agg(F.min("seq").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(claim_keys, names)]
    return spent.join(first, same, "left").where(F.col("_first").isNull() | (F.col("seq") <= F.col("_first"))).drop("_first", *names)


def gate_outcome(gated: DataFrame, claim_keys: list[str]) -> DataFrame:
    """Per claim: calls made, final spend, and whether (and where) the claim was refused."""
    return (gated.groupBy(*claim_keys)
            .agg(F.max("seq").alias("calls_made"), F.max("tokens_spent").alias("tokens_spent"),
                 F.min(F.when(~F.col("within_budget"), F.col("seq"))).alias("refused_at")))
