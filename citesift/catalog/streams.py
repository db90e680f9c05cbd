"""Streaming queries (STR-1..4): each runs a Structured Streaming job to completion (``availableNow``) and
returns its final table, which must equal the batch job over the same input."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import ORACLES, query
from citesift.catalog.loop import EVENT_BUDGET
from citesift.operators.knn import knn_join
from citesift.streaming import jobs, keyed


@query("stream_budget_counter", sql=ORACLES["budget_counter"])
def stream_budget_counter(spark, sf_dir):
    """STR-1: keyed spend counter over a stream of gate calls with retried deliveries."""
    def twice(calls):
        return calls.unionByName(calls.where(F.col("event_type") == "error"))
    return jobs.stream_spend_counter(spark, sf_dir, deliveries=twice).select("user_id", "calls", "tokens_spent")


@query("stream_budget_gate", sql=ORACLES["budget_gate"])
def stream_budget_gate(spark, sf_dir):
    """STR-2: gate decisions per micro-batch against the running counter."""
    return jobs.stream_gate(spark, sf_dir, budget=EVENT_BUDGET).select(
        "user_id", "event_id", "seq", "tokens_spent", "within_budget")


@query("stream_claim_intake", sql=ORACLES["agentic_loop"])
def stream_claim_intake(spark, sf_dir):
    """STR-3: claims arriving as a stream each run through the loop once (idempotent upsert by claim)."""
    def knn(q, corpus):
        return knn_join(q, corpus, 5, query_keys=["claim_id", "iteration"], corpus_key="id", round_digits=9)
    out = jobs.stream_claim_intake(spark, sf_dir, knn)
    return out.select("claim_id", "status", "iterations", "tokens_spent",
                      F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("citations"))


@query("stream_reindex", sql=ORACLES["content_digest"])
def stream_reindex(spark, sf_dir):
    """STR-4: incremental indexing as documents arrive; the final manifest equals the batch digests."""
    manifest, _ = jobs.stream_reindex(spark, sf_dir)
    return manifest.select("policy_id", "digest")


@query("stream_gate_keyed", sql=ORACLES["budget_gate"])
def stream_gate_keyed(spark, sf_dir):
    """STR-2 with the spend of each user in the state store, refusals in a sink of their own."""
    return keyed.decisions(keyed.stream_gate_keyed(spark, sf_dir, budget=EVENT_BUDGET)).select(
        "user_id", "event_id", "seq", "tokens_spent", "within_budget")


@query("stream_gate_refused", sql=f"""SELECT user_id, event_id, seq, tokens_spent FROM ({ORACLES["budget_gate"]}) WHERE NOT within_budget""")
def stream_gate_refused(spark, sf_dir):
    """STR-2 / SNK-6: the dead-letter sink of the keyed gate."""
    _, refused = keyed.stream_gate_keyed(spark, sf_dir, budget=EVENT_BUDGET)
    return refused.select("user_id", "event_id", "seq", "tokens_spent")
