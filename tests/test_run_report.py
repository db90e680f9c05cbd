import pytest

from citesift.operators import quality as qa
from citesift.plans import run_report as rr


def _outcomes(spark):
    return spark.createDataFrame(
        [(1, "answered", 2, 600, [5, 6], "a", None), (2, "budget_exhausted", 1, 300, [], None, None), (3, "failed", 3, 900, [], None, "permanent"),
         (4, "answered", 4, 1200, [7], "b", None)],
        "claim_id bigint, status string, iterations int, tokens_spent bigint, citations array<bigint>, completion string, failure_type string")


def test_counts_are_taken_while_the_tables_are_written(spark, tmp_path):
    clauses = spark.createDataFrame([(5,), (6,), (6,)], "id bigint")
    n = rr.save_outcomes(_outcomes(spark), clauses, str(tmp_path))
    assert n == {"claims": 4, "ended": 3, "exhausted": 1, "in_time": 3, "citations": 3, "known": 2, "buried": 1}
    assert spark.read.parquet(str(tmp_path / "citations")).where("not known").first()["id"] == 7
    assert spark.read.parquet(str(tmp_path / "dead_letters")).count() == 2
    checks = rr.checks_of_run(spark, n, 2)
    got = {r.dimension: (r.measured, r.passed) for r in qa.with_passed(checks).collect()}
    assert got == {"completeness": (0.75, False), "correctness": (0.6667, False), "validity": (1.0, True), "consistency": (2.0, False),
                   "timeliness": (0.75, False)}
    with pytest.raises(AssertionError, match="completeness"):
        qa.assert_all_passed(checks)


def test_saved_report_comes_back_from_json_and_markdown(spark, tmp_path):
    n = {"claims": 0, "ended": 0, "exhausted": 0, "in_time": 0, "citations": 0, "known": 0, "buried": 0}
    checks = rr.checks_of_run(spark, n, 0)
    rr.save_report(checks, str(tmp_path), "p", "t")
    back = rr.read_report(spark, str(tmp_path)).first()
    assert (back.pipeline, back.generated_at, back.overall_score) == ("p", "t", 1.0)
    assert back.scores == {"completeness": 1.0, "correctness": 1.0, "validity": 1.0, "consistency": 1.0, "timeliness": 1.0}
    assert [c.check_no for c in back.checks] == [1, 2, 3, 4, 5] and all(c.passed for c in back.checks)
    lines = [r.value for r in spark.read.text(str(tmp_path / "report.md")).collect()]
    assert lines[0] == "# Quality report — p" and "**Overall score: 100%** (5/5 checks passed)" in lines
