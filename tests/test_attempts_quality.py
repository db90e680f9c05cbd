"""Attempt classification, precision edge cases and quality scoring."""

from pyspark.sql import functions as F

from citesift.operators import attempts, evaluation, quality


def test_attempt_outcomes(spark):
    rows = [("ok", 1, "ok"), ("retry_ok", 1, "transient"), ("retry_ok", 2, "ok"),
            ("exhausted", 1, "transient"), ("exhausted", 2, "transient"), ("perm", 1, "permanent"),
            ("perm", 2, "ok"), ("pending", 1, "transient")]
    log = spark.createDataFrame(rows, "call string, attempt int, outcome string")
    got = {r["call"]: (r["status"], r["failure_type"], r["attempts_used"])
           for r in attempts.classify_calls(log, ["call"]).collect()}
    assert got == {"ok": ("ok", None, 1), "retry_ok": ("ok", None, 2),
                   "exhausted": ("failed", "transient_retries_exhausted", 2),
                   "perm": ("failed", "permanent", 1), "pending": ("retry_pending", None, 1)}
    sched = {(r["call"], r["attempt"]): r["llm_delay_s"] for r in attempts.backoff_schedule(log).collect()}
    assert sched[("retry_ok", 1)] == 0.5 and sched[("exhausted", 2)] is None


def test_precision_denominator(spark):
    out = spark.createDataFrame([("empty", [], "answered", 1), ("dup", [1, 1, 2], "answered", 1),
                                 ("two", [1, 2, 9], "answered", 1)],
                                "claim_id string, citations array<bigint>, status string, iterations int")
    gold = spark.createDataFrame([("empty", [1]), ("dup", [1]), ("two", [1, 2])],
                                 "claim_id string, ground_truth array<bigint>")
    p = {r["claim_id"]: r["precision"] for r in evaluation.precision(out, gold).collect()}
    assert p["empty"] == 0.0 and abs(p["dup"] - 2 / 3) < 1e-12 and abs(p["two"] - 2 / 3) < 1e-12


def _checks(spark, rows):
    return spark.createDataFrame(rows, quality.CHECK_SCHEMA)


def test_thresholds_inclusive_both_ways(spark):
    rows = [(1, "correctness", "at_hib", 0.5, 0.5, True, ""), (2, "correctness", "below_hib", 0.4, 0.5, True, ""),
            (3, "validity", "at_lib", 0.1, 0.1, False, ""), (4, "validity", "above_lib", 0.2, 0.1, False, "d")]
    c = {r["name"]: r["passed"] for r in quality.with_passed(_checks(spark, rows)).collect()}
    assert c == {"at_hib": True, "below_hib": False, "at_lib": True, "above_lib": False}
    sc = {r["dimension"]: r["score"] for r in quality.score(_checks(spark, rows)).collect()}
    assert sc == {"correctness": 0.5, "validity": 0.5, "overall": 0.5}
    msgs = [r["message"] for r in quality.failures(_checks(spark, rows)).orderBy("check_no").collect()]
    assert msgs[1] == "  [validity] above_lib: measured=0.2 > threshold=0.1 — d"


def test_empty_report_scores_zero(spark):
    sc = {r["dimension"]: r["score"] for r in quality.score(_checks(spark, [])).collect()}
    assert sc == {"overall": 0.0}
    lines = quality.markdown_lines(_checks(spark, []), "p", "t").orderBy("section", "k").collect()
    assert any(r["line"] == "**Overall score: 0%** (0/0 checks passed)" for r in lines)


def test_failed_checks_raise_and_reach_the_json_report(spark):
    import json

    import pytest

    one = spark.range(4).agg(
        quality.check_row(1, "validity", "small", F.max("id"), 3.0, False, "at most three").alias("a"),
        quality.check_row(2, "completeness", "many", F.count(F.lit(1)), 5.0, True, "at least five").alias("b"))
    checks = one.select(F.inline(F.array("a", "b")))
    with pytest.raises(AssertionError, match=r"\[completeness\] many: measured=4.0 < threshold=5.0"):
        quality.assert_all_passed(checks)
    quality.assert_all_passed(checks.where("check_no = 1"))
    report = json.loads(quality.json_report(checks, "p", "now").first()["value"])
    assert report["overall_score"] == 0.5 and report["scores"] == {"completeness": 0.0, "validity": 1.0}
    assert [c["passed"] for c in report["checks"]] == [True, False]
