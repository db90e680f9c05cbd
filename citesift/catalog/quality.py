"""Quality report, skew, impact, inventory and source/sink queries (FLT-3/4, AGG-9/10/11/15/16, SNK-1/7/8,
PRJ-12, ORD-3, SRC-2/3/7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.catalog.loop import WITH_LOOP, scored_modes
from citesift.operators import evaluation as ev
from citesift.operators import quality as qa
from citesift.operators.skew import hot_key_share, skewed_assignment
from citesift.session import cut_lineage, work_dir
from citesift.sources.nested import read_text_documents, write_text_documents
from citesift.sources.tables import read_table, register_parquet_view, table_path

PIPELINE = "citesift"
REPORT_STAMP = "run0001"
LATE_DAYS = 90
# parameters of the impact model (the reference leaves them open)
MINUTES_SAVED_PER_CLAIM = 12.0
HOURLY_COST = 40.0
INVENTORY_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
                  "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
                  "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
                  "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}

SQL_CHECKS = f"""checks AS (
  SELECT 1 AS check_no, 'completeness' AS dimension, 'labels_cover_documents' AS name,
         round(count(l.doc_id) / count(*), 4) AS measured, 0.3 AS threshold, true AS higher_is_better,
         'labelled documents / documents' AS detail
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id
  UNION ALL
  SELECT 2, 'correctness', 'quality_pass_rate', round(avg(quality), 4), 0.5, true,
         'share of labelled documents with quality = 1' FROM labels
  UNION ALL
  SELECT 3, 'validity', 'toxic_rate', round(avg(toxic), 4), 0.1, false,
         'share of labelled documents flagged toxic' FROM labels
  UNION ALL
  SELECT 4, 'consistency', 'duplicate_label_rows', round(count(*) - count(DISTINCT doc_id), 4), 0.0, false,
         'label rows beyond one per document' FROM labels
  UNION ALL
  SELECT 5, 'timeliness', 'late_shipment_share',
         round(avg(CASE WHEN date_diff('day', CAST(o.o_orderdate AS DATE), CAST(li.l_shipdate AS DATE)) > {LATE_DAYS}
                   THEN 1.0 ELSE 0.0 END), 4), 0.5, false,
         'line items shipped more than {LATE_DAYS} days after the order'
  FROM lineitem li JOIN orders o ON o.o_orderkey = li.l_orderkey
  UNION ALL
  SELECT 6, 'validity', 'dangling_part_refs', round(avg(CASE WHEN p.p_partkey IS NULL THEN 1.0 ELSE 0.0 END), 4),
         0.0, false, 'line items whose part is not in the part table'
  FROM lineitem li LEFT JOIN part p ON p.p_partkey = li.l_partkey),
cp AS (SELECT *, CASE WHEN higher_is_better THEN measured >= threshold ELSE measured <= threshold END AS passed
       FROM checks)"""


def quality_checks_df(spark, sf_dir):
    """Six checks over the driver tables (JOB-6 inputs): one aggregate per table, written once, since score,
    failures and report all read them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    labels = read_table(spark, sf_dir, "labels")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    labelled = labels.select("doc_id").distinct().withColumn("_l", F.lit(1))
    of_docs = docs.join(labelled, "doc_id", "left").agg(qa.check_row(
        1, "completeness", "labels_cover_documents", F.count("_l") / F.count(F.lit(1)), 0.3,
        detail="labelled documents / documents").alias("c1"))
    of_labels = labels.agg(
        qa.check_row(2, "correctness", "quality_pass_rate", F.avg("quality"), 0.5,
                     detail="share of labelled documents with quality = 1").alias("c1"),
        qa.check_row(3, "validity", "toxic_rate", F.avg("toxic"), 0.1, False,
                     detail="share of labelled documents flagged toxic").alias("c2"),
        qa.check_row(4, "consistency", "duplicate_label_rows", F.count(F.lit(1)) - F.count_distinct("doc_id"), 0.0, False,
                     detail="label rows beyond one per document").alias("c3"))
    late = F.when(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) > LATE_DAYS, 1.0).otherwise(0.0)
    known = part.distinct().withColumn("_p", F.lit(1))
    lines = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(
        known, F.col("l_partkey") == F.col("p_partkey"), "left")
    of_lines = lines.agg(
        qa.check_row(5, "timeliness", "late_shipment_share", F.avg(F.when(F.col("o_orderkey").isNotNull(), late)), 0.5, False,
                     detail=f"line items shipped more than {LATE_DAYS} days after the order").alias("c1"),
        qa.check_row(6, "validity", "dangling_part_refs", F.avg(F.when(F.col("_p").isNull(), 1.0).otherwise(0.0)), 0.0, False,
                     detail="line items whose part is not in the part table").alias("c2"))
    stacked = [df.select(F.inline(F.array(*[F.col(c) for c in df.columns]))) for df in (of_docs, of_labels, of_lines)]
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), stacked))


@query("quality_checks", sql=f"""WITH {SQL_CHECKS}
SELECT check_no, dimension, name, measured, threshold, higher_is_better, passed FROM cp""")
def quality_checks(spark, sf_dir):
    """FLT-3: every check with its inclusive, direction-aware pass flag."""
    return qa.with_passed(quality_checks_df(spark, sf_dir)).select(
        "check_no", "dimension", "name", "measured", "threshold", "higher_is_better", "passed")


@query("quality_score", sql=f"""WITH {SQL_CHECKS}
SELECT dimension, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) AS score FROM cp GROUP BY dimension
UNION ALL
SELECT 'overall', round(coalesce(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 0.0), 4) FROM cp""")
def quality_score(spark, sf_dir):
    """AGG-9 / JOB-6: pass rate per dimension and overall."""
    return qa.score(quality_checks_df(spark, sf_dir))


@query("quality_failures", sql=f"""WITH {SQL_CHECKS}
SELECT check_no, dimension, name,
       '  [' || dimension || '] ' || name || ': measured=' || CAST(measured AS VARCHAR) || ' '
       || CASE WHEN higher_is_better THEN '<' ELSE '>' END || ' threshold=' || CAST(threshold AS VARCHAR)
       || ' — ' || detail AS message
FROM cp WHERE NOT passed""")
def quality_failures(spark, sf_dir):
    """FLT-4: failed checks and their message lines (``operators.quality.assert_all_passed`` raises with them)."""
    return qa.failures(quality_checks_df(spark, sf_dir))


@query("quality_markdown", sql=f"""WITH {SQL_CHECKS},
sc AS (SELECT dimension, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) AS score FROM cp GROUP BY dimension)
SELECT 1 AS section, 1 AS k, '# Quality report — {PIPELINE}' AS line
UNION ALL SELECT 1, 2, '' UNION ALL SELECT 1, 3, 'Generated: {REPORT_STAMP}' UNION ALL SELECT 1, 4, ''
UNION ALL SELECT 1, 5, printf('**Overall score: %.0f%%** (%d/%d checks passed)',
                              round(coalesce(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 0.0), 4) * 100,
                              count_if(passed), count(*)) FROM cp
UNION ALL SELECT 1, 6, '' UNION ALL SELECT 1, 7, '| Dimension | Score |' UNION ALL SELECT 1, 8, '|---|---|'
UNION ALL SELECT 2, CAST(list_position(['completeness', 'correctness', 'consistency', 'validity', 'timeliness'],
                                       dimension) AS INTEGER),
                 printf('| %s | %.0f%% |', dimension, score * 100) FROM sc
UNION ALL SELECT 3, 1, '' UNION ALL SELECT 3, 2, '## Checks' UNION ALL SELECT 3, 3, ''
UNION ALL SELECT 3, 4, '| Dimension | Check | Measured | Threshold | Status | Detail |'
UNION ALL SELECT 3, 5, '|---|---|---|---|---|---|'
UNION ALL SELECT 4, check_no, '| ' || dimension || ' | ' || name || ' | ' || CAST(measured AS VARCHAR) || ' | '
                 || CAST(threshold AS VARCHAR) || ' | ' || CASE WHEN passed THEN 'PASS' ELSE '**FAIL**' END
                 || ' | ' || detail || ' |' FROM cp""")
def quality_markdown(spark, sf_dir):
    """SNK-8 + AGG-10: the Markdown report, written as a file and returned as ordered lines."""
    lines = qa.markdown_lines(quality_checks_df(spark, sf_dir), PIPELINE, REPORT_STAMP)
    qa.write_markdown(lines, work_dir(spark, "quality-md"))
    return lines


# ---- skew ---------------------------------------------------------------------------------------------
@query("hot_key_share", sql="""
WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS rk, count(*) OVER () AS n_keys,
             sum(n) OVER () AS total FROM c)
SELECT CAST(max(n_keys) AS BIGINT) AS n_keys, CAST(greatest(1, floor(max(n_keys) * 0.05)) AS BIGINT) AS n_hot,
       CAST(sum(CASE WHEN rk <= greatest(1, floor(n_keys * 0.05)) THEN n ELSE 0 END) AS BIGINT) AS hot_rows,
       CAST(max(total) AS BIGINT) AS total_rows,
       round(sum(CASE WHEN rk <= greatest(1, floor(n_keys * 0.05)) THEN n ELSE 0 END) / max(total), 4) AS hot_share
FROM r""")
def hot_key_share_q(spark, sf_dir):
    """AGG-11: share of events on the hottest 5 % of users."""
    return hot_key_share(read_table(spark, sf_dir, "events"), "user_id")


@query("skewed_keys")
def skewed_keys(spark, sf_dir):
    """PRJ-12: every order drawn onto customer slots so that 5 % of slots get 60 % of orders (hash-seeded,
    stable under recomputation).  Rows only: the draw uses Spark's hash."""
    n_slots = read_table(spark, sf_dir, "customer").count()
    return skewed_assignment(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", n_slots)


# ---- impact, inventory, latest runs -----------------------------------------------------------------------
@query("impact_model", sql=f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_claims,
       count(*) * {MINUTES_SAVED_PER_CLAIM} AS minutes_saved,
       round(count(*) * {MINUTES_SAVED_PER_CLAIM} / 60.0 * {HOURLY_COST}, 2) AS value_month,
       round(count(*) * {MINUTES_SAVED_PER_CLAIM} / 60.0 * {HOURLY_COST} * 12, 2) AS value_year
FROM orders GROUP BY 1""")
def impact_model(spark, sf_dir):
    """AGG-15: claims per month and the value of the minutes saved (parameters, not measurements)."""
    o = read_table(spark, sf_dir, "orders")
    m = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_claims"))
    minutes = F.col("n_claims") * F.lit(MINUTES_SAVED_PER_CLAIM)
    return m.select("month", "n_claims", minutes.alias("minutes_saved"),
                    F.round(minutes / 60.0 * HOURLY_COST, 2).alias("value_month"),
                    F.round(minutes / 60.0 * HOURLY_COST * 12, 2).alias("value_year"))


@query("dataset_inventory", sql=" UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows,
       (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT {k} AS k FROM {t} ORDER BY {k} LIMIT 3))
         AS first_keys""" for t, k in INVENTORY_KEYS.items()))
def dataset_inventory(spark, sf_dir):
    """AGG-16: row count and the three smallest keys of every table (a top-k per table, no full sort)."""
    parts = []
    for t, k in INVENTORY_KEYS.items():
        df = read_table(spark, sf_dir, t)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows"))
        first = df.select(F.col(k).alias("k")).orderBy("k").limit(3)
        parts.append(first.agg(F.array_sort(F.collect_list("k")).alias("_k")).select(
            F.lit(t).alias("table_name"), F.array_join(F.transform("_k", lambda x: x.cast("string")), ",")
            .alias("first_keys")))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.groupBy("table_name").agg(F.max("n_rows").alias("n_rows"), F.max("first_keys").alias("first_keys"))


@query("latest_n_runs", sql="""
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER)
       AS rn
FROM events QUALIFY rn <= 5""")
def latest_n_runs(spark, sf_dir):
    """ORD-3: the last five executions per key (row_number <= 5 becomes a partial WindowGroupLimit)."""
    ev_ = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return ev_.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 5).select("user_id", "event_id", "rn")


# ---- sources and sinks ---------------------------------------------------------------------------------
@query("eval_report", sql=f"""{WITH_LOOP}
SELECT mode, count(*) AS n_claims, CAST(count_if(status = 'answered') AS BIGINT) AS n_answered,
       round(coalesce(avg(precision), 0.0), 4) AS citation_precision_at_k,
       round(coalesce(avg(iterations), 0.0), 2) AS avg_iterations
FROM scored GROUP BY mode""")
def eval_report(spark, sf_dir):
    """SNK-7 + SRC-7: evaluation summary and per-claim rows saved as two JSON tables; the report reads the
    summaries of both modes back without the per-claim rows and fails when there are none."""
    scored = scored_modes(spark, sf_dir)
    root = work_dir(spark, "eval")
    summary = ev.summary(scored).select("mode", "n_claims", "n_answered", "citation_precision_at_k",
                                        "avg_iterations")
    summary.write.mode("overwrite").json(f"{root}/summary")
    scored.write.mode("overwrite").json(f"{root}/results")
    back = spark.read.schema("mode string, n_claims bigint, n_answered bigint, citation_precision_at_k double, "
                             "avg_iterations double").json(f"{root}/summary")
    if back.isEmpty():
        raise FileNotFoundError("no evaluation results saved")
    return back


@query("src_parquet_view", sql="""
SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price
FROM orders GROUP BY o_orderstatus""")
def src_parquet_view(spark, sf_dir):
    """SRC-3: a parquet glob registered as a view, then plain SQL over it (pruning and pushdown included)."""
    register_parquet_view(spark, table_path(sf_dir, "orders"), "orders_view")
    return spark.sql("SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price "
                     "FROM orders_view GROUP BY o_orderstatus")


@query("src_text_docs", sql="""
SELECT count(*) AS n_files, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents""")
def src_text_docs(spark, sf_dir):
    """SRC-2: documents landed as one ``.txt`` file each, scanned back whole (one row per file)."""
    path = work_dir(spark, "text-docs")
    write_text_documents(read_table(spark, sf_dir, "documents").select("text"), path)
    docs = read_text_documents(spark, path, recursive=True)
    return docs.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("land_documents", sql="""
SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source""")
def land_documents(spark, sf_dir):
    """SNK-1: raw documents landed as parquet partitioned by ingest date and source, read back per source."""
    path = work_dir(spark, "landing")
    (read_table(spark, sf_dir, "documents").withColumn("ingest_date", F.current_date())
     .write.mode("overwrite").partitionBy("ingest_date", "source").parquet(path))
    landed = spark.read.parquet(path)
    return landed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                        F.sum("n_chars").cast("bigint").alias("n_chars"))
