"""Quality report of a pipeline run (JOB-6, SNK-8): the claims loop and two reindex runs, measured as they write.

The loop's outcomes, citations and dead letters are written as tables; the counts that the checks need are observed on
those very writes (``DataFrame.observe``), so nothing is scanned again.  The checks are the five dimensions' one each:

1. completeness: claims that end as answered or out of budget, of all claims (JON-7, FLT-5);
2. correctness: citations that are clauses of the corpus, of all citations (JON-6);
3. validity: claims out of budget that are in the dead-letter table, of all out of budget (JON-7);
4. consistency: policies that a second reindex over unchanged files embeds again (AGG-8);
5. timeliness: claims that end within the iteration cap, of all claims (WIN-3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citesift.operators import quality as qa
from citesift.operators.trace import MAX_ITERATIONS
from citesift.plans import text_loop as tl

REPORT_SCHEMA = ("pipeline string, generated_at string, overall_score double, scores map<string,double>, "
                 "checks array<struct<check_no:int,dimension:string,name:string,measured:double,threshold:double,"
                 "higher_is_better:boolean,passed:boolean,detail:string>>")


def save_outcomes(outcomes: DataFrame, clauses: DataFrame, root: str) -> dict[str, int]:
    """Write ``answers``, ``citations`` (with ``known``) and ``dead_letters`` under ``root``; what was counted meanwhile."""
    spark, seen = outcomes.sparkSession, {n: Observation() for n in ("answers", "citations", "dead_letters")}
    ended = F.col("status").isin(tl.ANSWERED, tl.EXHAUSTED)
    outcomes.observe(seen["answers"], F.count(F.lit(1)).alias("claims"), F.count_if(ended).alias("ended"),
                     F.count_if(F.col("status") == tl.EXHAUSTED).alias("exhausted"),
                     F.count_if(F.col("iterations") <= MAX_ITERATIONS).alias("in_time")).write.mode("overwrite").parquet(f"{root}/answers")
    # what was written is what the other tables are made of: the loop runs once
    answers = spark.read.parquet(f"{root}/answers")
    cited = answers.select("claim_id", F.posexplode("citations").alias("pos", "id")).join(
        clauses.select("id").distinct().withColumn("known", F.lit(True)), "id", "left").select(
        "claim_id", (F.col("pos") + 1).alias("position"), "id", F.coalesce("known", F.lit(False)).alias("known"))
    cited.observe(seen["citations"], F.count(F.lit(1)).alias("citations"), F.count_if("known").alias("known")).write.mode(
        "overwrite").parquet(f"{root}/citations")
    tl.dead_letters(answers).observe(seen["dead_letters"], F.count_if(F.col("reason") == tl.EXHAUSTED).alias("buried")).write.mode(
        "overwrite").parquet(f"{root}/dead_letters")
    return {k: v for o in seen.values() for k, v in o.get.items()}


def _share(part: int, whole: int) -> float:
    return round(part / whole, 4) if whole else 1.0


def checks_of_run(spark: SparkSession, n: dict[str, int], reindexed_again: int) -> DataFrame:
    """The five checks from the run's counts; nothing to measure counts as passed."""
    return spark.createDataFrame([
        (1, "completeness", "every_claim_reaches_a_terminal_status", _share(n["ended"], n["claims"]), 1.0, True, f"{n['ended']} of {n['claims']} claims"),
        (2, "correctness", "citations_reference_real_clause_ids", _share(n["known"], n["citations"]), 1.0, True, f"{n['known']} of {n['citations']} citations"),
        (3, "validity", "budget_exhaustion_reaches_dead_letters", _share(n["buried"], n["exhausted"]), 1.0, True, f"{n['buried']} of {n['exhausted']} claims"),
        (4, "consistency", "incremental_reindex_skips_unchanged_docs", float(reindexed_again), 0.0, False, "policies embedded by a second run"),
        (5, "timeliness", "loop_terminates_within_max_iterations", _share(n["in_time"], n["claims"]), 1.0, True, f"at most {MAX_ITERATIONS} iterations"),
    ], qa.CHECK_SCHEMA)


def save_report(checks: DataFrame, root: str, pipeline: str, generated_at: str) -> None:
    """The report as ``report.json`` (one JSON line) and as Markdown lines, each in a folder of its own."""
    qa.json_report(checks, pipeline, generated_at).coalesce(1).write.mode("overwrite").text(f"{root}/report.json")
    qa.write_markdown(qa.markdown_lines(checks, pipeline, generated_at), f"{root}/report.md")


def read_report(spark: SparkSession, root: str) -> DataFrame:
    """The saved report with its fixed schema; a line that does not parse is an error."""
    return spark.read.schema(REPORT_SCHEMA).option("mode", "FAILFAST").json(f"{root}/report.json")
