"""Provider calls, retries and dead letters (WIN-5, WIN-6, UDF-2/3, SNK-6, SET-2, AGG-17).

An attempt log has one row per (call, attempt) with an outcome ``ok`` / ``transient`` / ``permanent``.
The reference retries a transient error once (two attempts, back-off 0.5 s then doubled) and fails a
permanent one at once; a failed call goes to the dead-letter table with its failure type.  Every call is
bounded by its attempt cap, so grouping by call never gathers more than a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: retry policy of provider calls and of the gate's state machine
LLM_MAX_ATTEMPTS = 2
LLM_BACKOFF_BASE_S = 0.5
GATE_MAX_RETRIES = 3
GATE_BACKOFF_BASE_S = 1.0
GATE_BACKOFF_RATE = 2.0
FAILURE_PERMANENT = "permanent"
FAILURE_TRANSIENT = "transient_retries_exhausted"
BUDGET_REASON = "token budget exceeded (%d tokens spent)"


def backoff_schedule(attempts: DataFrame, *, attempt_col="attempt", outcome_col="outcome") -> DataFrame:
    """WIN-5: the wait after each attempt.

    ``llm_delay_s``: 0.5 * 2^(n-1) after a transient failure that is retried (n < 2), else null.
    ``gate_delay_s``: 1 * 2^(n-1), the state machine's wait before its n-th retry (n <= 3).
    """
    n = F.col(attempt_col)
    retried = (F.col(outcome_col) == "transient") & (n < LLM_MAX_ATTEMPTS)
    return (attempts
            .withColumn("llm_delay_s", F.when(retried, F.lit(LLM_BACKOFF_BASE_S) * F.pow(F.lit(2.0), n - 1)))
            .withColumn("gate_delay_s", F.when(n <= GATE_MAX_RETRIES,
                                               F.lit(GATE_BACKOFF_BASE_S) * F.pow(F.lit(GATE_BACKOFF_RATE), n - 1))))


def classify_calls(attempts: DataFrame, call_keys: list[str], *, attempt_col="attempt",
                   outcome_col="outcome", max_attempts: int = LLM_MAX_ATTEMPTS) -> DataFrame:
    """WIN-6: final state of every call from its attempts.

    The first terminal attempt decides: ``ok`` -> ok; ``permanent`` -> failed/permanent; ``transient`` at
    the last allowed attempt -> failed/transient_retries_exhausted.  A call whose attempts so far are all
    retried transients is ``retry_pending``.  Attempts after the terminal one never happened.
    """
    n, out = F.col(attempt_col), F.col(outcome_col)
    terminal = (out == "ok") | (out == "permanent") | ((out == "transient") & (n >= max_attempts))
    t = attempts.withColumn("_terminal", terminal)
    key = F.when(F.col("_terminal"), F.col(attempt_col))
    agg = t.groupBy(*call_keys).agg(
        F.count(F.lit(1)).alias("n_attempts_logged"),
        F.min(key).alias("decided_at"),
        F.min_by(out, F.when(F.col("_terminal"), n)).alias("_final"))
    status = (F.when(F.col("decided_at").isNull(), F.lit("retry_pending"))
              .when(F.col("_final") == "ok", F.lit("ok")).otherwise(F.lit("failed")))
    ftype = (F.when(F.col("_final") == "permanent", F.lit(FAILURE_PERMANENT))
             .when((F.col("_final") == "transient") & F.col("decided_at").isNotNull(), F.lit(FAILURE_TRANSIENT)))
    return agg.select(*call_keys, status.alias("status"), ftype.alias("failure_type"),
                      F.coalesce("decided_at", "n_attempts_logged").cast("int").alias("attempts_used"))


def failure_messages(failed: DataFrame, claim_id: Column) -> DataFrame:
    """DLQ rows for failed provider calls (the shape with a failure type)."""
    reason = F.format_string("%s after %d attempt(s)", F.col("failure_type"), F.col("attempts_used"))
    return failed.where(F.col("status") == "failed").select(claim_id.alias("claim_id"),
                                                            F.col("failure_type"), reason.alias("reason"))


def budget_messages(exhausted: DataFrame, claim_id: Column) -> DataFrame:
    """DLQ rows for budget-exhausted claims (the shape without a failure type)."""
    reason = F.format_string(BUDGET_REASON, F.col("tokens_spent"))
    return exhausted.where(F.col("status") == "budget_exhausted").select(claim_id.alias("claim_id"),
                                                                         reason.alias("reason"))


def dead_letters(*parts: DataFrame) -> DataFrame:
    """SET-2: one table of both message shapes; a missing ``failure_type`` is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if "failure_type" not in out.columns:
        out = out.withColumn("failure_type", F.lit(None).cast("string"))
    return out.select("claim_id", F.col("failure_type").cast("string"), "reason")


def dlq_breakdown(dlq: DataFrame) -> DataFrame:
    """AGG-17: messages per kind (no failure type means budget exhaustion)."""
    return (dlq.groupBy(F.coalesce("failure_type", F.lit("budget_exhausted")).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n_messages")))
