"""Data-quality checks, scores and the report (FLT-3, FLT-4, AGG-9, AGG-10, SNK-8).

A checks table has one row per check: ``check_no, dimension, name, measured, threshold, higher_is_better,
detail``.  Everything below is a few aggregates over that (small) table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the five quality dimensions in report order
DIMENSIONS = ("completeness", "correctness", "consistency", "validity", "timeliness")

CHECK_SCHEMA = ("check_no int, dimension string, name string, measured double, threshold double, "
                "higher_is_better boolean, detail string")


def check_row(check_no: int, dimension: str, name: str, measured: Column, threshold: float,
              higher_is_better: bool = True, detail: str = "") -> Column:
    """One check as a struct (``measured`` is an aggregate expression); several fit into one aggregate."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension}")
    return F.struct(F.lit(check_no).alias("check_no"), F.lit(dimension).alias("dimension"), F.lit(name).alias("name"),
            F.round(measured.cast("double"), 4).alias("measured"), F.lit(float(threshold)).alias("threshold"),
            F.lit(higher_is_better).alias("higher_is_better"), F.lit(detail).alias("detail"))


def with_passed(checks: DataFrame) -> DataFrame:
    """FLT-3: inclusive threshold in the check's direction."""
    m, t = F.col("measured"), F.col("threshold")
    return checks.withColumn("passed", F.when(F.col("higher_is_better"), m >= t).otherwise(m <= t))


def score(checks: DataFrame) -> DataFrame:
    """AGG-9: pass rate per dimension present, and overall (0.0 when there are no checks), 4 places."""
    c = with_passed(checks)
    per_dim = c.groupBy("dimension").agg(F.round(F.avg(F.col("passed").cast("double")), 4).alias("score"))
    overall = c.agg(F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)), 4).alias("score")) \
        .select(F.lit("overall").alias("dimension"), "score")
    return per_dim.unionByName(overall)


def failures(checks: DataFrame) -> DataFrame:
    """FLT-4: failed checks with the assertion message line."""
    c = with_passed(checks).where(~F.col("passed"))
    msg = F.format_string("  [%s] %s: measured=%s %s threshold=%s — %s", F.col("dimension"), F.col("name"),
                          F.col("measured").cast("string"),
                          F.when(F.col("higher_is_better"), F.lit("<")).otherwise(F.lit(">")),
                          F.col("threshold").cast("string"), F.col("detail"))
    return c.select("check_no", "dimension", "name", msg.alias("message"))


def assert_all_passed(checks: DataFrame) -> None:
    """Raise with one line per failed check (a check is one row, so the lines are few)."""
    lines = [r["message"] for r in failures(checks).orderBy("check_no").collect()]
    if lines:
        raise AssertionError("quality checks failed:\n" + "\n".join(lines))


def json_report(checks: DataFrame, pipeline: str, generated_at: str) -> DataFrame:
    """The report as one JSON line: scores per dimension, overall score and every check."""
    c = with_passed(checks)
    per_dim = score(checks)
    rows = c.agg(F.sort_array(F.collect_list(F.struct(
        "check_no", "dimension", "name", "measured", "threshold", "higher_is_better", "passed", "detail"))).alias("checks"))
    scores = per_dim.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("dimension") != "overall", F.struct("dimension", "score"))))).alias("scores"),
        F.max(F.when(F.col("dimension") == "overall", F.col("score"))).alias("overall_score"))
    both = rows.withColumn("k", F.lit(1)).join(scores.withColumn("k", F.lit(1)), "k")
    return both.select(F.to_json(F.struct(
        F.lit(pipeline).alias("pipeline"), F.lit(generated_at).alias("generated_at"), "overall_score", "scores", "checks")).alias("value"))


def _pct(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def markdown_lines(checks: DataFrame, pipeline: str, generated_at: str) -> DataFrame:
    """SNK-8: the Markdown report as rows ``(section, k, line)``; ordered by (section, k) they are the file.

    Sections: 1 header, 2 dimension table (fixed dimension order, present dimensions only), 3 checks
    table header, 4 one line per check in check order with PASS / **FAIL**.
    """
    spark: SparkSession = checks.sparkSession
    c = with_passed(checks)
    sc = score(checks)
    schema = "section int, k int, line string"
    head = [f"# Quality report — {pipeline}", "", f"Generated: {generated_at}", ""]
    parts = [spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(head)], schema)]
    parts.append(c.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"),
                       F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)), 4).alias("overall"))
                 .select(F.lit(1).alias("section"), F.lit(5).alias("k"),
                         F.format_string("**Overall score: %s** (%d/%d checks passed)", _pct(F.col("overall")),
                                         F.col("ok"), F.col("n")).alias("line")))
    parts.append(spark.createDataFrame([(1, 6, ""), (1, 7, "| Dimension | Score |"), (1, 8, "|---|---|")], schema))
    order = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension")).cast("int")
    parts.append(sc.where(F.col("dimension") != "overall")
                 .select(F.lit(2).alias("section"), order.alias("k"),
                         F.format_string("| %s | %s |", F.col("dimension"), _pct(F.col("score"))).alias("line")))
    tail = ["", "## Checks", "", "| Dimension | Check | Measured | Threshold | Status | Detail |",
            "|---|---|---|---|---|---|"]
    parts.append(spark.createDataFrame([(3, i + 1, t) for i, t in enumerate(tail)], schema))
    status = F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("**FAIL**"))
    parts.append(c.select(F.lit(4).alias("section"), F.col("check_no").cast("int").alias("k"),
                          F.format_string("| %s | %s | %s | %s | %s | %s |", F.col("dimension"), F.col("name"),
                                          F.col("measured").cast("string"), F.col("threshold").cast("string"),
                                          status, F.col("detail")).alias("line")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("section").cast("int"), F.col("k").cast("int"), "line")


def write_markdown(lines: DataFrame, path: str) -> None:
    """Write the (small, fixed-size) report as one text file in line order."""
    lines.orderBy("section", "k").select("line").coalesce(1).write.mode("overwrite").text(path)
