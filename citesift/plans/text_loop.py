"""The loop over texts (JOB-3, JOB-4): question -> search text -> embedding -> retrieval -> observation -> answer.

Whole tables move round by round.  A round gates the active claims, has the provider rewrite the searches of
the admitted ones (from the second round on), embeds them, searches the clause vectors and observes the best
distance.  A provider failure ends its claim as ``failed``; claims that stop searching are answered from the
fused citations.  What a provider or a model produced is written once per round, so it is paid for once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.functions import text as tx
from citesift.functions.models import complete, embed
from citesift.operators import fusion
from citesift.operators.budget import COST_PER_CALL, DEFAULT_BUDGET
from citesift.operators.trace import INF, MAX_ITERATIONS
from citesift.session import cut_lineage

ACTIVE, STOPPED, ANSWERED, FAILED, EXHAUSTED = "active", "stopped", "answered", "failed", "budget_exhausted"
Search = Callable[[DataFrame, DataFrame], DataFrame]


def clause_vectors(clauses: DataFrame, *, model: str = "hashed") -> DataFrame:
    """``id, embedding`` of ``clauses (id, title, text)``, embedded once."""
    return cut_lineage(embed(clauses, "id", "text", model=model))


def _answers(claims: DataFrame, top: DataFrame, clauses: DataFrame, provider: str) -> DataFrame:
    """``claim_id, citations, completion, failure_type``: the answer to each question from its fused citations."""
    line = F.concat(F.lit("[clause-"), F.col("id").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")))
    cited = top.join(clauses.select("id", "title"), "id").groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("fused_rank", "id", line.alias("line")))).alias("c"))
    prompts = claims.select("claim_id", "question").join(cited, "claim_id", "left").select(
        "claim_id", F.coalesce(F.transform("c", lambda x: x["id"]), F.array().cast("array<bigint>")).alias("citations"),
        tx.answer_prompt("question", F.coalesce(F.transform("c", lambda x: x["line"]), F.array().cast("array<string>"))).alias("prompt"))
    return cut_lineage(complete(prompts, "prompt", provider=provider).select("claim_id", "citations", "completion", "failure_type"))


def text_loop(claims: DataFrame, clauses: DataFrame, search: Search, *, provider: str = "deterministic", model: str = "hashed",
              cost: int = COST_PER_CALL, max_iterations: int = MAX_ITERATIONS, answer_k: int = 3) -> DataFrame:
    """One outcome per claim of ``claims (claim_id, question, budget)``.

    ``search(queries, vectors)`` gives ``claim_id, id, distance, rank``.  Outcome: ``claim_id, status,
    iterations, tokens_spent, citations, completion, failure_type``.
    """
    vectors = clause_vectors(clauses, model=model)
    state = claims.select("claim_id", "question", F.coalesce("budget", F.lit(DEFAULT_BUDGET)).alias("budget"),
                          F.lit(0).cast("bigint").alias("spent"), F.lit(INF).alias("best"), F.lit(0).alias("last_iter"),
                          F.lit(ACTIVE).alias("status"), F.array().cast("array<string>").alias("searches"),
                          F.lit(None).cast("string").alias("failure_type"))
    rounds: list[DataFrame] = []
    for i in range(1, max_iterations + 1):
        active = F.col("status") == ACTIVE
        gated = state.withColumn("spent", F.col("spent") + F.when(active, cost).otherwise(0)).withColumn(
            "last_iter", F.when(active, i).otherwise(F.col("last_iter"))).withColumn(
            "status", F.when(active & (F.col("spent") > F.col("budget")), EXHAUSTED).otherwise(F.col("status")))
        admitted = gated.where(active).select("claim_id", "question", "searches")
        if i == 1:
            planned = admitted.select("claim_id", F.col("question").alias("search"), F.lit(None).cast("string").alias("failed"))
        else:
            prompts = admitted.withColumn("prompt", tx.reformulation_prompt("question", F.col("searches")))
            planned = complete(prompts, "prompt", provider=provider).select(
                "claim_id", F.when(F.col("failure_type").isNull(), tx.clean_rewrite("completion", "question")).alias("search"),
                F.col("failure_type").alias("failed"))
        planned = cut_lineage(planned)
        asked = embed(planned.where(F.col("failed").isNull()), "claim_id", "search", model=model)
        hits = cut_lineage(search(asked, vectors).select("claim_id", F.lit(i).alias("iteration"), "id", "distance", "rank"))
        rounds.append(hits)
        best = hits.where(F.col("rank") == 1).select("claim_id", F.col("distance").alias("d1"))
        seen = gated.join(planned, "claim_id", "left").join(best, "claim_id", "left")
        ran = active & F.col("failed").isNull()
        d1 = F.coalesce("d1", F.lit(INF))
        stop = (~(d1 < F.col("best")) & F.lit(i > 1)) | F.lit(i == max_iterations)
        state = cut_lineage(seen.select(
            "claim_id", "question", "budget", "spent", F.when(ran, F.least("best", d1)).otherwise(F.col("best")).alias("best"), "last_iter",
            F.when(active & F.col("failed").isNotNull(), FAILED).when(ran & stop, STOPPED).otherwise(F.col("status")).alias("status"),
            F.when(ran, F.concat("searches", F.array("search"))).otherwise(F.col("searches")).alias("searches"),
            F.coalesce("failed", "failure_type").alias("failure_type")))
    done = state.where(F.col("status") == STOPPED)
    lists = reduce(DataFrame.unionByName, rounds).join(done.select("claim_id"), "claim_id", "left_semi")
    top = fusion.fused_order(fusion.rrf(lists, ["claim_id"], list_col="iteration", rank_col="rank"), ["claim_id"], n=answer_k)
    answers = _answers(done, top, clauses, provider).withColumnRenamed("failure_type", "answer_failure")
    answered = F.col("answer_failure").isNull()
    return state.join(answers, "claim_id", "left").select(
        "claim_id", F.when(F.col("status") != STOPPED, F.col("status")).when(answered, ANSWERED).otherwise(FAILED).alias("status"),
        F.col("last_iter").cast("int").alias("iterations"), F.col("spent").alias("tokens_spent"),
        F.when((F.col("status") == STOPPED) & answered, F.col("citations")).otherwise(F.array().cast("array<bigint>")).alias("citations"),
        "completion", F.coalesce("failure_type", "answer_failure").alias("failure_type"))


def text_single_shot(claims: DataFrame, clauses: DataFrame, search: Search, *, provider: str = "deterministic",
                     model: str = "hashed") -> DataFrame:
    """JOB-4: the question as written, one search, one answer: ``claim_id, status, citations, completion``."""
    asked = embed(claims, "claim_id", "question", model=model)
    hits = cut_lineage(search(asked, clause_vectors(clauses, model=model)).select("claim_id", "id", "distance", "rank"))
    answers = _answers(claims, hits.withColumnRenamed("rank", "fused_rank"), clauses, provider)
    good = F.col("failure_type").isNull()
    return answers.select("claim_id", F.when(good, ANSWERED).otherwise(FAILED).alias("status"),
                          F.when(good, F.col("citations")).otherwise(F.array().cast("array<bigint>")).alias("citations"), "completion")


def dead_letters(outcomes: DataFrame) -> DataFrame:
    """``claim_id, reason, failure_type`` of every claim that was not answered."""
    return outcomes.where(F.col("status") != ANSWERED).select("claim_id", F.col("status").alias("reason"), "failure_type")
