"""Golden labels from texts and the evaluation on them (SRC-6, JOB-5, AGG-5..7, AGG-13, AGG-14): a ``benchmark`` text is a
question, and the ``documents`` that hold it word for word are its golden clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.catalog.texts import SQL_TEXT_LOOP, _answer_prompt, _clauses, _claims, _refused, _search
from citesift.functions.models import embed
from citesift.operators import evaluation as ev
from citesift.plans import golden as gd
from citesift.plans import text_loop as tl
from citesift.session import work_dir
from citesift.sources.claims_file import read_claims, write_claims

SQL_LABELS = "labels_of AS (SELECT DISTINCT item_id AS claim_id, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
SQL_EVAL = f"""{SQL_TEXT_LOOP},
{SQL_LABELS},
ss AS (
  SELECT knn.claim_id, string_agg('[clause-' || knn.id || '] ' || title, chr(10) ORDER BY rank) AS lines
  FROM knn JOIN titles ON titles.id = knn.id WHERE iteration = 1 AND rank <= 3 GROUP BY knn.claim_id),
single AS (
  SELECT claim_id, CASE WHEN {_refused("prompt")} THEN 'failed' ELSE 'answered' END AS status, 1 AS iterations
  FROM (SELECT qs.claim_id, {_answer_prompt()} AS prompt FROM qs LEFT JOIN ss ON ss.claim_id = qs.claim_id)),
ended_as AS (
  SELECT 'agentic' AS mode, claim_id, status, at_iter AS iterations FROM outcome
  UNION ALL SELECT 'single-shot', claim_id, status, iterations FROM single),
given AS (
  SELECT 'agentic' AS mode, claim_id, id FROM ltop
  UNION ALL SELECT 'single-shot', claim_id, id FROM knn WHERE iteration = 1 AND rank <= 3),
scored AS (
  SELECT e.mode, e.claim_id, any_value(e.status) AS status, any_value(e.iterations) AS iterations,
         count(g.id) AS n_predicted, count(l.id) AS n_hits,
         any_value(t.n_truth) AS n_truth, CASE WHEN count(g.id) = 0 THEN 0.0 ELSE count(l.id) / count(g.id) END AS precision
  FROM ended_as e JOIN (SELECT claim_id, count(*) AS n_truth FROM labels_of GROUP BY claim_id) t ON t.claim_id = e.claim_id
  LEFT JOIN given g ON g.mode = e.mode AND g.claim_id = e.claim_id AND e.status = 'answered'
  LEFT JOIN labels_of l ON l.claim_id = g.claim_id AND l.id = g.id
  GROUP BY e.mode, e.claim_id)"""


def golden_claims(spark, sf_dir):
    """Claims and labels, written as JSON Lines and read from there, as an evaluation run does."""
    claims, clauses = _claims(spark, sf_dir), _clauses(spark, sf_dir)
    path = work_dir(spark, "golden-claims")
    write_claims(claims, gd.golden_from_text(claims, clauses), path)
    return read_claims(spark, path)


def golden_outcomes(claims, clauses):
    """Both modes over the claims that were read: ``mode, claim_id, status, iterations, citations``."""
    provider = "deterministic-refusing"
    loop = tl.text_loop(claims, clauses, _search(5), provider=provider)
    single = tl.text_single_shot(claims, clauses, _search(3), provider=provider)
    return loop.select(F.lit("agentic").alias("mode"), "claim_id", "status", "iterations", "citations").unionByName(
        single.select(F.lit("single-shot").alias("mode"), "claim_id", "status", F.lit(1).alias("iterations"), "citations"))


def golden_scores(spark, sf_dir):
    claims, labels = golden_claims(spark, sf_dir)
    return gd.scored_by_labels(golden_outcomes(claims, _clauses(spark, sf_dir)), labels)


@query("golden_from_text", sql=f"WITH {SQL_LABELS} SELECT claim_id, id FROM labels_of")
def golden_from_text(spark, sf_dir):
    """SRC-6: golden labels found by the containment join, read back from the claims file."""
    return golden_claims(spark, sf_dir)[1].select("claim_id", "id")


@query("claims_file", sql="""SELECT item_id AS claim_id, text AS question,
  CAST(CASE item_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 300 WHEN 2 THEN 700 ELSE 2000 END AS INTEGER) AS budget FROM benchmark""")
def claims_file(spark, sf_dir):
    """SRC-6: claims scanned from JSON Lines with a fixed schema."""
    return golden_claims(spark, sf_dir)[0].select("claim_id", "question", "budget")


@query("golden_precision", sql=f"""{SQL_EVAL}
SELECT mode, claim_id, status, CAST(iterations AS INTEGER) AS iterations, CAST(n_predicted AS INTEGER) AS n_predicted,
       CAST(n_hits AS INTEGER) AS n_hits, CAST(n_truth AS INTEGER) AS n_truth, round(precision, 6) AS precision FROM scored""")
def golden_precision(spark, sf_dir):
    """AGG-5 on golden labels from texts, per claim and mode."""
    return golden_scores(spark, sf_dir).withColumn("precision", F.round("precision", 6))


@query("golden_eval_summary", sql=f"""{SQL_EVAL}
SELECT mode, count(*) AS n_claims, CAST(count_if(status = 'answered') AS BIGINT) AS n_answered,
       round(avg(precision), 4) AS citation_precision_at_k, round(avg(iterations), 2) AS avg_iterations,
       CAST(count_if(precision > 0) AS BIGINT) AS n_hit, round(sum(n_hits) / sum(n_truth), 4) AS clause_recall
FROM scored GROUP BY mode""")
def golden_eval_summary(spark, sf_dir):
    """AGG-6 + AGG-7 / JOB-5 on golden labels from texts: single shot against the loop."""
    s = ev.summary(golden_scores(spark, sf_dir))
    return s.select("mode", "n_claims", "n_answered", "citation_precision_at_k", "avg_iterations", "n_hit",
                    F.round(F.col("sum_hits") / F.col("sum_truth"), 4).alias("clause_recall"))


@query("golden_label_check", sql=f"""WITH {SQL_LABELS}
SELECT count(*) AS n_claims, CAST(count_if(item_id NOT IN (SELECT claim_id FROM labels_of)) AS BIGINT) AS n_unlabelled,
       CAST(0 AS BIGINT) AS n_unknown_labels, count_if(item_id NOT IN (SELECT claim_id FROM labels_of)) = 0 AS passed FROM benchmark""")
def golden_label_check(spark, sf_dir):
    """AGG-13 on the claims file: every claim labelled, every label a clause."""
    claims, labels = golden_claims(spark, sf_dir)
    return gd.label_check(claims, labels, _clauses(spark, sf_dir))


@query("golden_retrieval_gate", sql=f"""{SQL_TEXT_LOOP},
{SQL_LABELS},
hit AS (SELECT l.claim_id, bool_or(k.id IS NOT NULL) AS found FROM labels_of l
        LEFT JOIN knn k ON k.claim_id = l.claim_id AND k.id = l.id AND k.iteration = 1 GROUP BY l.claim_id)
SELECT count(*) AS n_claims, CAST(count_if(found) AS BIGINT) AS n_found, round(count_if(found) / count(*), 4) AS share,
       count_if(found) / count(*) >= 0.8 AS passed FROM hit""")
def golden_retrieval_gate(spark, sf_dir):
    """AGG-14 on the claims file: a golden clause among the five nearest of the question as written."""
    claims, labels = golden_claims(spark, sf_dir)
    vectors = tl.clause_vectors(_clauses(spark, sf_dir))
    asked = embed(claims.join(labels, "claim_id", "left_semi"), "claim_id", "question")
    return gd.retrieval_share(_search(5)(asked, vectors).select("claim_id", "id"), labels)
