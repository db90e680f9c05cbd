"""Trace windows and the budget gate on hand-made tables (FIXTURES.md part C)."""

from pyspark.sql import functions as F

from citesift.operators import budget, trace

INF = float("inf")


def _trace(spark, rows):
    steps = spark.createDataFrame([(c, i) for c, i, _ in rows], "claim string, iteration int")
    hits = spark.createDataFrame([(c, i, "x", d, 1) for c, i, d in rows if d is not None],
                                 "claim string, iteration int, id string, distance double, rank int")
    return trace.improvement(trace.top1_per_iteration(steps, hits, ["claim"]), ["claim"])


def test_stop_rule_and_infinity(spark):
    rows = [("up", 1, 0.9), ("up", 2, 0.5), ("up", 3, 0.1),
            ("worse", 1, 0.5), ("worse", 2, 0.7), ("worse", 3, 0.1),
            ("null1", 1, None), ("null1", 2, 0.4), ("null1", 3, 0.5),
            ("null12", 1, None), ("null12", 2, None), ("null12", 3, 0.1)]
    tr = _trace(spark, rows)
    first = {r["claim"]: r for r in tr.where(F.col("iteration") == 1).collect()}
    assert first["null1"]["top1_distance"] == INF and first["null1"]["improved"] is False
    kept = trace.early_stop(tr, ["claim"])
    last = {r["claim"]: r["m"] for r in kept.groupBy("claim").agg(F.max("iteration").alias("m")).collect()}
    # improving x3 runs to the cap; worse at 2 stops at 2; +inf at 1 does not stop; +inf at 1 and 2 stops at 2
    assert last == {"up": 3, "worse": 2, "null1": 3, "null12": 2}


def test_gate_inclusive_and_refused_call_spends(spark):
    calls = spark.createDataFrame([(b, s) for b in (1, 299, 300, 600) for s in range(1, 4)],
                                  "budget int, seq_in int").withColumn("claim", F.col("budget"))
    g = budget.sequential_gate(calls, ["claim"], ["seq_in"], budget=F.col("budget"), max_calls=3)
    out = {r["claim"]: r for r in budget.gate_outcome(g, ["claim"]).collect()}
    assert out[1]["refused_at"] == 1 and out[1]["tokens_spent"] == 300
    assert out[299]["refused_at"] == 1
    assert out[300]["refused_at"] == 2 and out[300]["tokens_spent"] == 600  # 300 <= 300 allowed, refused still spends
    assert out[600]["refused_at"] == 3 and out[600]["calls_made"] == 3


def test_counter_exact_under_retries(spark):
    rows = [("c", f"call{i}") for i in range(20)] + [("c", "call7")]  # one call delivered twice
    calls = spark.createDataFrame(rows, "claim string, call_id string")
    got = budget.spend_counter(calls, ["claim"], "call_id").first()
    assert got["tokens_spent"] == 6000 and got["calls"] == 20


def test_gate_bound_is_exact(spark):
    # 80 calls for one claim, budget 20000 at 300 each: the 67th is the first refusal, 68+ never happen
    calls = spark.createDataFrame([("u", i) for i in range(80)], "claim string, n int")
    g = budget.sequential_gate(calls, ["claim"], ["n"], budget=20000)
    assert g.count() == 67
    assert g.where(~F.col("within_budget")).select("seq").first()["seq"] == 67
