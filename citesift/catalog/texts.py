"""The loop over texts (JOB-3, JOB-4): ``benchmark`` texts are the questions, ``documents`` the clauses.

Budgets by ``item_id % 4`` -> 1, 300, 700, 2000 tokens.  The provider refuses every prompt whose SHA-256
starts with 0 or 1, so that all four outcomes occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.catalog.prompts import SQL_PYREPR, sql_strip
from citesift.functions import models
from citesift.functions import text as tx
from citesift.operators.attempts import FAILURE_PERMANENT
from citesift.operators.knn import knn_join
from citesift.plans import text_loop as tl
from citesift.session import work_dir
from citesift.sources.tables import read_table

REFUSED = ("0", "1")


class RefusingProvider(models.DeterministicProvider):
    """Answers like the deterministic provider, but refuses prompts by their hash."""

    def column_failure(self, prompt):
        return F.when(F.substring(F.sha2(prompt, 256), 1, 1).isin(*REFUSED), FAILURE_PERMANENT)


models.register_provider("deterministic-refusing", RefusingProvider)


def _claims(spark, sf_dir):
    budgets = F.array(*[F.lit(b) for b in (1, 300, 700, 2000)])
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("claim_id"), F.col("text").alias("question"),
        F.element_at(budgets, (F.col("item_id") % 4 + 1).cast("int")).alias("budget"))


def _clauses(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.first_line("text").alias("title"), "text")


def _search(k):
    def search(queries, vectors):
        return knn_join(queries, vectors, k, query_keys=["claim_id"], corpus_key="id", round_digits=9)
    return search


def _fake(prompt):
    return (f"to_json({{'answer': '[fake-llm deterministic response ' || substr(sha256({prompt}), 1, 8) || ']', "
            "'confidence': 0.5, 'citations': []::VARCHAR[]})::VARCHAR")


def _refused(prompt):
    return f"substr(sha256({prompt}), 1, 1) IN ('0', '1')"


def _rewrite_prompt(prior):
    return (f"'An insurance claim says: \"' || question || '\"' || chr(10) "
            "|| 'Previous search queries that did not find a strong match in the policy: [' "
            f"|| array_to_string(list_transform({prior}, lambda s: {SQL_PYREPR.replace('{s}', 's')}), ', ') || ']' || chr(10) "
            "|| 'Rewrite this as a short search query using formal insurance-policy terminology ' "
            "|| '(coverage type, exclusion, deductible, limit) instead of the claimant''s own words. ' "
            "|| 'Return only the rewritten query, nothing else.'")


def _clean(raw):
    return f"coalesce(nullif(substr(trim({sql_strip(raw)}, '\"'), 1, 200), ''), question)"


def _vectors(name, source, keys):
    """Dense 64-bucket vectors of the column ``text`` of ``source`` per ``keys``."""
    k = ", ".join(keys)
    on = " AND ".join(f"d.{x} = w.{x}" for x in keys)
    return f"""{name}_tok AS (SELECT {k}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS t FROM {source}),
{name}_bk AS (SELECT {k}, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, count(*) AS tf
  FROM {name}_tok WHERE t <> '' GROUP BY ALL),
{name}_w AS (SELECT {k}, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {k})) AS weight FROM {name}_bk),
{name} AS (SELECT {", ".join("d." + x for x in keys)}, list(coalesce(w.weight, 0.0)::FLOAT::DOUBLE ORDER BY g.b) AS v
  FROM (SELECT DISTINCT {k} FROM {name}_w) d CROSS JOIN range(64) g(b)
  LEFT JOIN {name}_w w ON {on} AND w.bucket = g.b GROUP BY {", ".join("d." + x for x in keys)})"""


SQL_QUESTIONS = """qs AS (SELECT item_id AS claim_id, text AS question,
  CASE item_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 300 WHEN 2 THEN 700 ELSE 2000 END AS budget FROM benchmark)"""
SQL_TITLES = "titles AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title FROM documents)"


def _answer_prompt():
    return ("'Claim: ' || question || chr(10) || chr(10) || 'Relevant policy clauses:' || chr(10) || coalesce(lines, '') "
            "|| chr(10) || chr(10) || 'Answer the claim using only these clauses and cite the clause IDs.'")


SQL_TEXT_LOOP = f"""WITH {SQL_QUESTIONS},
{SQL_TITLES},
s2 AS (SELECT *, {_rewrite_prompt("[question]")} AS prompt2 FROM qs),
s2t AS (SELECT *, {_refused("prompt2")} AS fail2, {_clean(_fake("prompt2"))} AS text2 FROM s2),
s3 AS (SELECT *, {_rewrite_prompt("[question, text2]")} AS prompt3 FROM s2t),
s3t AS (SELECT *, {_refused("prompt3")} AS fail3, {_clean(_fake("prompt3"))} AS text3 FROM s3),
searches AS (
  SELECT claim_id, 1 AS iteration, question AS text, false AS fail FROM s3t
  UNION ALL SELECT claim_id, 2, text2, fail2 FROM s3t UNION ALL SELECT claim_id, 3, text3, fail3 FROM s3t),
{_vectors("sv", "searches", ["claim_id", "iteration"])},
{_vectors("cv", "documents", ["doc_id"])},
knn AS (
  SELECT claim_id, iteration, id, round(d, 9) AS distance,
         row_number() OVER (PARTITION BY claim_id, iteration ORDER BY d, id) AS rank
  FROM (SELECT sv.claim_id, sv.iteration, cv.doc_id AS id, list_distance(sv.v, cv.v) ^ 2 AS d FROM sv CROSS JOIN cv)
  QUALIFY rank <= 5),
tr AS (
  SELECT s.claim_id, s.iteration, s.fail, coalesce(k.distance, 'inf'::DOUBLE) AS d1
  FROM searches s LEFT JOIN knn k ON k.claim_id = s.claim_id AND k.iteration = s.iteration AND k.rank = 1),
tr2 AS (
  SELECT *, iteration > 1 AND NOT d1 < min(d1) OVER (PARTITION BY claim_id ORDER BY iteration
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM tr),
kept AS (
  SELECT * FROM tr2
  QUALIFY coalesce(sum(CAST(stop AS INTEGER)) OVER (PARTITION BY claim_id ORDER BY iteration
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0),
per AS (
  SELECT qs.claim_id, question, max(iteration) AS last_iter,
         coalesce(min(CASE WHEN 300 * iteration > budget THEN iteration END), 99) AS refused_at,
         coalesce(min(CASE WHEN fail THEN iteration END), 99) AS failed_at
  FROM kept JOIN qs ON qs.claim_id = kept.claim_id GROUP BY ALL),
lf AS (
  SELECT knn.claim_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score,
         arg_min(iteration, iteration * 1000 + rank) AS first_list, arg_min(rank, iteration * 1000 + rank) AS first_rank
  FROM knn JOIN per ON per.claim_id = knn.claim_id
  WHERE refused_at = 99 AND failed_at = 99 AND iteration <= last_iter GROUP BY knn.claim_id, id),
ltop AS (
  SELECT claim_id, id,
         row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 9) DESC, first_list, first_rank, id) AS fused_rank
  FROM lf QUALIFY fused_rank <= 3),
cited AS (
  SELECT claim_id, string_agg(CAST(ltop.id AS VARCHAR), ',' ORDER BY fused_rank) AS citations,
         string_agg('[clause-' || ltop.id || '] ' || title, chr(10) ORDER BY fused_rank) AS lines
  FROM ltop JOIN titles ON titles.id = ltop.id GROUP BY claim_id),
ended AS (
  SELECT per.*, citations, {_answer_prompt()} AS prompt
  FROM per LEFT JOIN cited ON cited.claim_id = per.claim_id),
outcome AS (
  SELECT claim_id, least(refused_at, failed_at, last_iter) AS at_iter,
         CASE WHEN refused_at <= failed_at AND refused_at < 99 THEN 'budget_exhausted'
              WHEN failed_at < 99 OR {_refused("prompt")} THEN 'failed' ELSE 'answered' END AS status, citations, prompt
  FROM ended)"""


@query("text_loop", sql=f"""{SQL_TEXT_LOOP}
SELECT claim_id, status, CAST(at_iter AS INTEGER) AS iterations, CAST(300 * at_iter AS BIGINT) AS tokens_spent,
       CASE WHEN status = 'answered' THEN coalesce(citations, '') ELSE '' END AS citations,
       CASE WHEN status = 'answered' THEN {_fake("prompt")} END AS completion,
       CASE WHEN status = 'failed' THEN 'permanent' END AS failure_type
FROM outcome""")
def text_loop(spark, sf_dir):
    """JOB-3 over texts: every benchmark question through rewriting, embedding, search and answering."""
    out = tl.text_loop(_claims(spark, sf_dir), _clauses(spark, sf_dir), _search(5), provider="deterministic-refusing")
    return out.withColumn("citations", F.array_join(F.transform("citations", lambda x: x.cast("string")), ","))


@query("text_loop_statuses", sql=f"""{SQL_TEXT_LOOP}
SELECT status, count(*) AS n_claims FROM outcome GROUP BY status""")
def text_loop_statuses(spark, sf_dir):
    """FLT-5 over the text loop: every claim ends as answered, failed or budget_exhausted."""
    out = tl.text_loop(_claims(spark, sf_dir), _clauses(spark, sf_dir), _search(5), provider="deterministic-refusing")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_claims"))


@query("text_single_shot", sql=f"""WITH {SQL_QUESTIONS},
{SQL_TITLES},
searches AS (SELECT claim_id, 1 AS iteration, question AS text FROM qs),
{_vectors("sv", "searches", ["claim_id"])},
{_vectors("cv", "documents", ["doc_id"])},
hits AS (
  SELECT claim_id, id, row_number() OVER (PARTITION BY claim_id ORDER BY d, id) AS rank
  FROM (SELECT sv.claim_id, cv.doc_id AS id, list_distance(sv.v, cv.v) ^ 2 AS d FROM sv CROSS JOIN cv) QUALIFY rank <= 3),
cited AS (
  SELECT claim_id, string_agg(CAST(hits.id AS VARCHAR), ',' ORDER BY rank) AS citations,
         string_agg('[clause-' || hits.id || '] ' || title, chr(10) ORDER BY rank) AS lines
  FROM hits JOIN titles ON titles.id = hits.id GROUP BY claim_id),
ended AS (SELECT qs.claim_id, citations, {_answer_prompt()} AS prompt FROM qs LEFT JOIN cited ON cited.claim_id = qs.claim_id)
SELECT claim_id, CASE WHEN {_refused("prompt")} THEN 'failed' ELSE 'answered' END AS status,
       CASE WHEN {_refused("prompt")} THEN '' ELSE coalesce(citations, '') END AS citations,
       CASE WHEN NOT {_refused("prompt")} THEN {_fake("prompt")} END AS completion
FROM ended""")
def text_single_shot(spark, sf_dir):
    """JOB-4 over texts: the question as written, three citations, one answer."""
    out = tl.text_single_shot(_claims(spark, sf_dir), _clauses(spark, sf_dir), _search(3), provider="deterministic-refusing")
    return out.withColumn("citations", F.array_join(F.transform("citations", lambda x: x.cast("string")), ","))


@query("text_dead_letters", sql=f"""{SQL_TEXT_LOOP}
SELECT claim_id, status AS reason, CASE WHEN status = 'failed' THEN 'permanent' END AS failure_type
FROM outcome WHERE status <> 'answered'""")
def text_dead_letters(spark, sf_dir):
    """SNK-6: claims of the text loop that got no answer, appended to a stored table and read back."""
    out = tl.text_loop(_claims(spark, sf_dir), _clauses(spark, sf_dir), _search(5), provider="deterministic-refusing")
    path = work_dir(spark, "dead-letters")
    tl.dead_letters(out).write.mode("append").parquet(path)
    return spark.read.parquet(path)
