import random
from collections import defaultdict

from pyspark.sql import functions as F

from citesift.operators.budget import sequential_gate
from citesift.operators.prefix import prefix_within


def _calls(n=3000):
    rnd = random.Random(2)
    # one claim holds most of all calls, and most of its calls cost nothing; some claims have no key
    return [(rnd.choice([1] * 8 + [2, 3, None]), i, rnd.choice([0, 0, 0, 0, 5, None, 40])) for i in range(n)]


def test_running_sums_equal_a_plain_loop(spark):
    rows = _calls()
    df = spark.createDataFrame(rows, "claim bigint, call bigint, cost bigint").repartition(5)
    got = {r.call: (r.seq, r.running) for r in prefix_within(df, ["claim"], ["call"], F.col("cost")).collect()}
    at, total, want = defaultdict(int), defaultdict(int), {}
    for claim, call, cost in rows:
        at[claim] += 1
        total[claim] += cost or 0
        want[call] = (at[claim], total[claim])
    assert got == want


def test_gate_without_a_cost_bound(spark):
    rows = _calls()
    df = spark.createDataFrame(rows, "claim bigint, call bigint, cost bigint").repartition(5)
    gated = sequential_gate(df, ["claim"], ["call"], cost=F.col("cost"), budget=F.when(F.col("claim") == 2, 100).otherwise(2000))
    got = sorted((r.call, r.seq, r.tokens_spent, r.within_budget) for r in gated.collect())
    want, spent, seq, over = [], defaultdict(int), defaultdict(int), set()
    for claim, call, cost in rows:
        if claim in over:
            continue
        spent[claim] += cost or 0
        seq[claim] += 1
        fits = spent[claim] <= (100 if claim == 2 else 2000)
        want.append((call, seq[claim], spent[claim], fits))
        if not fits:
            over.add(claim)
    assert got == want and len(over) >= 2


def test_no_window_gathers_a_claim(spark):
    df = spark.createDataFrame(_calls(200), "claim bigint, call bigint, cost bigint")
    plan = sequential_gate(df, ["claim"], ["call"], cost=F.col("cost"))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        # over the runs of one range, or over the small table of runs
        if "Window [" in line:
            assert "_range" in line or "sum(_n" in line, line
