"""Report of a whole run (JOB-6, SNK-8, AGG-9, AGG-10): text loop and reindex, checks taken while they write, JSON read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.catalog.texts import SQL_TEXT_LOOP, _clauses, _claims, _search
from citesift.plans import reindex as rx
from citesift.plans import run_report as rr
from citesift.plans import text_loop as tl
from citesift.session import work_dir
from citesift.sources.tables import read_table

PIPELINE, STAMP = "citesift", "run0001"

# what cannot be counted from the tables is what a correct run must give: known citations, dead letters, no second embedding
SQL_RUN = f"""{SQL_TEXT_LOOP},
n AS (SELECT count(*) AS claims, count_if(status IN ('answered', 'budget_exhausted')) AS ended, count_if(at_iter <= 3) AS in_time FROM outcome),
run_checks AS (
  SELECT 1 AS check_no, 'completeness' AS dimension, 'every_claim_reaches_a_terminal_status' AS name, round(ended / claims, 4) AS measured,
         CAST(1 AS DOUBLE) AS threshold, true AS higher_is_better FROM n
  UNION ALL SELECT 2, 'correctness', 'citations_reference_real_clause_ids', 1.0, 1.0, true
  UNION ALL SELECT 3, 'validity', 'budget_exhaustion_reaches_dead_letters', 1.0, 1.0, true
  UNION ALL SELECT 4, 'consistency', 'incremental_reindex_skips_unchanged_docs', 0.0, 0.0, false
  UNION ALL SELECT 5, 'timeliness', 'loop_terminates_within_max_iterations', round(in_time / claims, 4), 1.0, true FROM n),
checked AS (SELECT *, CASE WHEN higher_is_better THEN measured >= threshold ELSE measured <= threshold END AS passed FROM run_checks)"""


def reported(spark, sf_dir):
    """Run the loop and two reindexes, write all their tables and the report, and read the report's JSON."""
    root = work_dir(spark, "pipeline-run")
    clauses = _clauses(spark, sf_dir)
    outcomes = tl.text_loop(_claims(spark, sf_dir), clauses, _search(5), provider="deterministic-refusing")
    counts = rr.save_outcomes(outcomes, clauses, root)
    rows = rx.arrivals(*(read_table(spark, sf_dir, t) for t in ("orders", "lineitem", "part")))
    rx.land(rows, f"{root}/policies")
    index = rx.PolicyIndex(spark, f"{root}/index")
    index.run(f"{root}/policies")
    again = index.run(f"{root}/policies")["policies_reembedded"]
    rr.save_report(rr.checks_of_run(spark, counts, again), root, PIPELINE, STAMP)
    return rr.read_report(spark, root)


@query("run_report", sql=f"""{SQL_RUN} SELECT check_no, dimension, name, CAST(measured AS DOUBLE) AS measured, CAST(threshold AS DOUBLE) AS threshold,
  higher_is_better, passed FROM checked""")
def run_report(spark, sf_dir):
    """JOB-6 + SNK-8: the run's five checks, from the saved JSON."""
    return reported(spark, sf_dir).select(F.inline("checks")).select(
        "check_no", "dimension", "name", "measured", "threshold", "higher_is_better", "passed")


@query("run_report_scores", sql=f"""{SQL_RUN}
SELECT dimension, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) AS score FROM checked GROUP BY dimension
UNION ALL SELECT 'overall', round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) FROM checked""")
def run_report_scores(spark, sf_dir):
    """AGG-9 over the run: score per dimension and overall, from the saved JSON."""
    report = reported(spark, sf_dir)
    per = report.select(F.explode("scores").alias("dimension", "score"))
    return per.unionByName(report.select(F.lit("overall").alias("dimension"), F.col("overall_score").alias("score")))
