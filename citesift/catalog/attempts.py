"""Attempts, dead letters, answers and archives (WIN-5, WIN-6, UDF-2/3, SNK-2, SNK-5, SNK-6, SET-2, AGG-17,
JON-7, SRC-4, PRJ-5, PRJ-9, PRJ-10, JOB-7).

Attempt fixture over ``events``: the events of a user in (ts, event_id) order are provider attempts;
consecutive pairs form one call (call_no = (position - 1) div 2, attempt = (position - 1) % 2 + 1);
``error`` is a transient failure, ``signup`` a permanent one, anything else succeeds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.catalog.loop import WITH_LOOP, loop_outcomes
from citesift.functions import text as tx
from citesift.operators import attempts as at
from citesift.operators.ordinal import ordinal_within
from citesift.plans import claims as cl
from citesift.session import work_dir
from citesift.sinks.snapshot import read_snapshot, upsert, write_snapshot
from citesift.sources.tables import read_table

SQL_ATT = """att AS (
  SELECT user_id, event_id, (rn - 1) // 2 AS call_no, CAST((rn - 1) % 2 + 1 AS INTEGER) AS attempt,
         CASE event_type WHEN 'error' THEN 'transient' WHEN 'signup' THEN 'permanent' ELSE 'ok' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)),
calls AS (
  SELECT user_id, call_no,
         CASE WHEN decided IS NULL THEN 'retry_pending' WHEN final = 'ok' THEN 'ok' ELSE 'failed' END AS status,
         CASE WHEN final = 'permanent' THEN 'permanent'
              WHEN final = 'transient' AND decided IS NOT NULL THEN 'transient_retries_exhausted' END AS failure_type,
         CAST(coalesce(decided, n) AS INTEGER) AS attempts_used
  FROM (SELECT user_id, call_no, count(*) AS n, min(CASE WHEN term THEN attempt END) AS decided,
               arg_min(outcome, CASE WHEN term THEN attempt END) AS final
        FROM (SELECT *, outcome IN ('ok', 'permanent') OR (outcome = 'transient' AND attempt >= 2) AS term FROM att)
        GROUP BY user_id, call_no))"""

SQL_DLQ = """dlq AS (
  SELECT 'claim-' || CAST(claim_id AS VARCHAR) AS claim_id, CAST(NULL AS VARCHAR) AS failure_type,
         printf('token budget exceeded (%d tokens spent)', tokens_spent) AS reason
  FROM outcome WHERE status = 'budget_exhausted'
  UNION ALL
  SELECT 'user-' || CAST(user_id AS VARCHAR) || '-call-' || CAST(call_no AS VARCHAR), failure_type,
         printf('%s after %d attempt(s)', failure_type, attempts_used)
  FROM calls WHERE status = 'failed')"""

SQL_ANSWERS = """top_meta AS (
  SELECT ltop.claim_id, ltop.fused_rank, '[clause-' || CAST(ltop.id AS VARCHAR) || '] label '
           || CAST(c.label AS VARCHAR) AS line, 'clause-' || CAST(ltop.id AS VARCHAR) AS cid
  FROM ltop JOIN c ON c.id = ltop.id),
prompts AS (
  SELECT o.claim_id, o.iterations,
         'Claim: claim ' || CAST(o.claim_id AS VARCHAR) || chr(10) || chr(10) || 'Relevant policy clauses:' || chr(10)
           || string_agg(t.line, chr(10) ORDER BY t.fused_rank) || chr(10) || chr(10)
           || 'Answer the claim using only these clauses and cite the clause IDs.' AS prompt,
         '[' || string_agg('"' || t.cid || '"', ', ' ORDER BY t.fused_rank) || ']' AS citations
  FROM outcome o JOIN top_meta t ON t.claim_id = o.claim_id WHERE o.status = 'answered'
  GROUP BY o.claim_id, o.iterations),
trace_json AS (
  SELECT kept.claim_id, '[' || string_agg('{"iteration": ' || CAST(kept.iteration AS VARCHAR)
           || ', "query": "vector ' || CAST(kept.claim_id + kept.iteration - 1 AS VARCHAR)
           || '", "top1_distance": ' || CAST(kept.top1_distance AS VARCHAR)
           || ', "improved": ' || CASE WHEN kept.improved THEN 'true' ELSE 'false' END || '}', ', '
           ORDER BY kept.iteration) || ']' AS trace
  FROM kept JOIN per ON per.claim_id = kept.claim_id
  WHERE kept.iteration < coalesce(per.refused_at, per.last_iter + 1) GROUP BY kept.claim_id),
answers AS (
  SELECT 'claim-' || CAST(p.claim_id AS VARCHAR) AS claim_id,
         substr(to_json({'answer': '[fake-llm deterministic response ' || substr(sha256(p.prompt), 1, 8) || ']',
                         'confidence': 0.5, 'citations': []::VARCHAR[]})::VARCHAR, 1, 2000) AS answer,
         p.citations, p.iterations, coalesce(tj.trace, '[]') AS trace
  FROM prompts p LEFT JOIN trace_json tj ON tj.claim_id = p.claim_id)"""


def attempt_log(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    pos = ordinal_within(ev, ["user_id"], ["ts", "event_id"], name="pos")
    outcome = (F.when(F.col("event_type") == "error", F.lit("transient"))
               .when(F.col("event_type") == "signup", F.lit("permanent")).otherwise(F.lit("ok")))
    return pos.select("user_id", "event_id", F.floor((F.col("pos") - 1) / 2).cast("bigint").alias("call_no"),
                      ((F.col("pos") - 1) % 2 + 1).cast("int").alias("attempt"), outcome.alias("outcome"))


def call_states(spark, sf_dir):
    return at.classify_calls(attempt_log(spark, sf_dir), ["user_id", "call_no"])


def dlq_table(spark, sf_dir):
    loop, _, _ = loop_outcomes(spark, sf_dir)
    budget = at.budget_messages(loop, F.concat(F.lit("claim-"), F.col("claim_id").cast("string")))
    calls = call_states(spark, sf_dir)
    failed = at.failure_messages(calls, F.concat(F.lit("user-"), F.col("user_id").cast("string"),
                                                 F.lit("-call-"), F.col("call_no").cast("string")))
    return at.dead_letters(budget, failed)


def answers_table(spark, sf_dir):
    """Answer rows for answered claims: prompt (PRJ-9) -> completion (PRJ-5) -> JSON text fields (PRJ-10)."""
    emb = read_table(spark, sf_dir, "embeddings")
    loop, trace, top = loop_outcomes(spark, sf_dir)
    meta = cl.corpus_vectors(emb).select("id", "label")
    lines = (top.join(meta, "id")
             .select("claim_id", "fused_rank",
                     F.format_string("[clause-%d] label %d", F.col("id"), F.col("label")).alias("line"),
                     F.format_string('"clause-%d"', F.col("id")).alias("cid"))
             .groupBy("claim_id")
             .agg(F.array_sort(F.collect_list(F.struct("fused_rank", "line", "cid"))).alias("_l")))
    question = F.format_string("claim %d", F.col("claim_id"))
    prompts = (loop.where(F.col("status") == "answered").select("claim_id", "iterations").join(lines, "claim_id")
               .select("claim_id", "iterations",
                       tx.answer_prompt(question, F.transform("_l", lambda s: s["line"])).alias("prompt"),
                       F.concat(F.lit("["), F.array_join(F.transform("_l", lambda s: s["cid"]), ", "),
                                F.lit("]")).alias("citations")))
    item = F.format_string('{"iteration": %d, "query": "vector %d", "top1_distance": %s, "improved": %s}',
                           F.col("iteration"), F.col("claim_id") + F.col("iteration") - 1,
                           F.col("top1_distance").cast("string"), F.when(F.col("improved"), "true").otherwise("false"))
    tj = (trace.select("claim_id", "iteration", item.alias("item")).groupBy("claim_id")
          .agg(F.array_sort(F.collect_list(F.struct("iteration", "item"))).alias("_t"))
          .select("claim_id", F.concat(F.lit("["), F.array_join(F.transform("_t", lambda s: s["item"]), ", "),
                                       F.lit("]")).alias("trace")))
    return (prompts.join(tj, "claim_id", "left")
            .select(F.concat(F.lit("claim-"), F.col("claim_id").cast("string")).alias("claim_id"),
                    F.substring(tx.deterministic_completion("prompt"), 1, tx.ANSWER_MAX_CHARS).alias("answer"),
                    "citations", "iterations", F.coalesce("trace", F.lit("[]")).alias("trace")))


# ---- attempts ------------------------------------------------------------------------------------------
@query("retry_schedule", sql=f"""WITH {SQL_ATT}
SELECT user_id, call_no, attempt, outcome,
       CASE WHEN outcome = 'transient' AND attempt < 2 THEN 0.5 * pow(2, attempt - 1) END AS llm_delay_s,
       CASE WHEN attempt <= 3 THEN 1.0 * pow(2.0, attempt - 1) END AS gate_delay_s
FROM att""")
def retry_schedule(spark, sf_dir):
    """WIN-5: attempt numbers and the back-off waits of provider and gate retries."""
    return at.backoff_schedule(attempt_log(spark, sf_dir)).select(
        "user_id", "call_no", "attempt", "outcome", "llm_delay_s", "gate_delay_s")


@query("attempt_outcome", sql=f"""WITH {SQL_ATT}
SELECT user_id, call_no, status, failure_type, attempts_used FROM calls""")
def attempt_outcome(spark, sf_dir):
    """WIN-6 / UDF-3: final state of every provider call: ok, failed (permanent or retries exhausted), pending."""
    return call_states(spark, sf_dir).select("user_id", "call_no", "status", "failure_type", "attempts_used")


# ---- dead letters -------------------------------------------------------------------------------------
@query("dlq_messages", sql=f"""{WITH_LOOP},
{SQL_ATT},
{SQL_DLQ}
SELECT claim_id, failure_type, reason FROM dlq""")
def dlq_messages(spark, sf_dir):
    """SNK-6 + SET-2: budget-exhausted claims and failed calls in one dead-letter table."""
    return dlq_table(spark, sf_dir)


@query("dlq_breakdown", sql=f"""{WITH_LOOP},
{SQL_ATT},
{SQL_DLQ}
SELECT coalesce(failure_type, 'budget_exhausted') AS kind, count(*) AS n_messages FROM dlq GROUP BY 1""")
def dlq_breakdown(spark, sf_dir):
    """AGG-17: dead letters per kind."""
    return at.dlq_breakdown(dlq_table(spark, sf_dir))


@query("lost_claims", sql=f"""{WITH_LOOP},
{SQL_ATT},
{SQL_DLQ}
SELECT count(*) AS n_claims, CAST(count_if(o.status = 'answered') AS BIGINT) AS n_answered,
       CAST(count_if(d.claim_id IS NOT NULL) AS BIGINT) AS n_in_dlq,
       CAST(count_if(o.status <> 'answered' AND d.claim_id IS NULL) AS BIGINT) AS n_lost,
       CAST(count_if(o.status = 'budget_exhausted' AND d.claim_id IS NULL) AS BIGINT) AS n_exhausted_not_in_dlq
FROM outcome o LEFT JOIN dlq d ON d.claim_id = 'claim-' || CAST(o.claim_id AS VARCHAR)""")
def lost_claims(spark, sf_dir):
    """JON-7: every claim ends as an answer or a dead letter; none over budget is missing from the DLQ."""
    loop, _, _ = loop_outcomes(spark, sf_dir)
    keyed = loop.select(F.concat(F.lit("claim-"), F.col("claim_id").cast("string")).alias("claim_id"), "status")
    dlq = dlq_table(spark, sf_dir).select("claim_id").distinct().withColumn("_in_dlq", F.lit(True))
    j = keyed.join(dlq, "claim_id", "left")
    in_dlq = F.col("_in_dlq").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("status") == "answered").alias("n_answered"),
                 F.count_if(in_dlq).alias("n_in_dlq"),
                 F.count_if((F.col("status") != "answered") & ~in_dlq).alias("n_lost"),
                 F.count_if((F.col("status") == "budget_exhausted") & ~in_dlq).alias("n_exhausted_not_in_dlq"))


# ---- answers, attribute-value scan, archive -------------------------------------------------------------
@query("answers_upsert", sql=f"""{WITH_LOOP},
{SQL_ANSWERS}
SELECT claim_id, answer, citations, iterations, trace FROM answers""")
def answers_upsert(spark, sf_dir):
    """SNK-5: answered claims upserted by claim id (run twice: the second run replaces, never duplicates)."""
    root = work_dir(spark, "answers")
    ans = answers_table(spark, sf_dir)
    write_snapshot(upsert(read_snapshot(spark, root), ans, ["claim_id"]), root)
    write_snapshot(upsert(read_snapshot(spark, root), ans, ["claim_id"]), root)
    return read_snapshot(spark, root).select("claim_id", "answer", "citations", "iterations", "trace")


AV_SCHEMA = ("claim_id struct<S:string>, answer struct<S:string>, citations struct<S:string>, "
             "iterations struct<N:string>, trace struct<S:string>")


def write_attr_value_items(spark, sf_dir, path):
    """Encode answers in the key-value store's attribute-value form, one JSON item per line.  Items of
    claims whose id is a multiple of 50 lack ``answer``, of 75 lack ``iterations`` (defaults must apply)."""
    ans = answers_table(spark, sf_dir)
    num = F.regexp_extract("claim_id", r"(\d+)$", 1).cast("bigint")
    item = F.struct(
        F.struct(F.col("claim_id").alias("S")).alias("claim_id"),
        F.when(num % 50 != 0, F.struct(F.col("answer").alias("S"))).alias("answer"),
        F.struct(F.col("citations").alias("S")).alias("citations"),
        F.when(num % 75 != 0, F.struct(F.col("iterations").cast("string").alias("N"))).alias("iterations"),
        F.struct(F.col("trace").alias("S")).alias("trace"))
    ans.select(F.to_json(item).alias("value")).write.mode("overwrite").text(path)


def scan_attr_value(spark, path):
    """SRC-4: parse items with per-field defaults ('' answer, '[]' citations, 0 iterations)."""
    it = spark.read.text(path).select(F.from_json("value", AV_SCHEMA).alias("i"))
    return it.select(F.col("i.claim_id.S").alias("claim_id"),
                     F.coalesce(F.col("i.answer.S"), F.lit("")).alias("answer"),
                     F.coalesce(F.col("i.citations.S"), F.lit("[]")).alias("citations"),
                     F.coalesce(F.col("i.iterations.N").cast("int"), F.lit(0)).alias("iterations"))


SQL_AV = f"""{WITH_LOOP},
{SQL_ANSWERS}
SELECT claim_id,
       CASE WHEN CAST(split_part(claim_id, '-', 2) AS BIGINT) % 50 = 0 THEN '' ELSE answer END AS answer,
       citations,
       CASE WHEN CAST(split_part(claim_id, '-', 2) AS BIGINT) % 75 = 0 THEN 0 ELSE iterations END AS iterations
FROM answers"""


@query("src_attrvalue_scan", sql=SQL_AV)
def src_attrvalue_scan(spark, sf_dir):
    """SRC-4: scan attribute-value items in parallel file splits (no paging through the driver)."""
    path = work_dir(spark, "answers-av")
    write_attr_value_items(spark, sf_dir, path)
    return scan_attr_value(spark, path)


@query("archive_answers", sql=SQL_AV)
def archive_answers(spark, sf_dir):
    """SNK-2 / JOB-7: full-snapshot archive of the scanned answers; zero rows -> nothing written."""
    path = work_dir(spark, "answers-av")
    write_attr_value_items(spark, sf_dir, path)
    rows = scan_attr_value(spark, path)
    root = work_dir(spark, "archive")
    if rows.isEmpty():
        return rows
    write_snapshot(rows, root)
    return read_snapshot(spark, root).select("claim_id", "answer", "citations", "iterations")


@query("deterministic_completion", sql="""
SELECT conv_id, turn,
       to_json({'answer': '[fake-llm deterministic response ' || substr(sha256(text), 1, 8) || ']',
                'confidence': 0.5, 'citations': []::VARCHAR[]})::VARCHAR AS completion
FROM conversations WHERE role = 'user'""")
def deterministic_completion(spark, sf_dir):
    """PRJ-5 / UDF-2: the offline provider answers every user turn of every conversation."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return conv.select("conv_id", "turn", tx.deterministic_completion("text").alias("completion"))


@query("provider_completion", sql="""
SELECT conv_id, turn,
       to_json({'answer': '[fake-llm deterministic response ' || substr(sha256(text), 1, 8) || ']',
                'confidence': 0.5, 'citations': []::VARCHAR[]})::VARCHAR AS completion,
       CAST(1 AS INTEGER) AS attempts, CAST(NULL AS VARCHAR) AS failure_type
FROM conversations WHERE role = 'user'""")
def provider_completion(spark, sf_dir):
    """UDF-2 / UDF-3: the provider chosen by name; the deterministic one answers as a column, so the whole
    prompts never leave the JVM, and the outcome columns are those of any provider."""
    from citesift.functions.models import complete
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    out = complete(conv, "text", provider="deterministic")
    return out.select("conv_id", "turn", "completion", "attempts", "failure_type")


@query("answer_prompt", sql=f"""{WITH_LOOP},
{SQL_ANSWERS}
SELECT 'claim-' || CAST(claim_id AS VARCHAR) AS claim_id, sha256(prompt) AS prompt_sha,
       CAST(length(prompt) AS INTEGER) AS prompt_len, citations FROM prompts""")
def answer_prompt(spark, sf_dir):
    """PRJ-9: the answer prompt lists ``[clause_id] title`` lines in fused order; citations follow it."""
    emb = read_table(spark, sf_dir, "embeddings")
    loop, _, top = loop_outcomes(spark, sf_dir)
    meta = cl.corpus_vectors(emb).select("id", "label")
    lines = (top.join(meta, "id")
             .select("claim_id", "fused_rank",
                     F.format_string("[clause-%d] label %d", F.col("id"), F.col("label")).alias("line"),
                     F.format_string('"clause-%d"', F.col("id")).alias("cid"))
             .groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("fused_rank", "line", "cid"))).alias("_l")))
    p = (loop.where(F.col("status") == "answered").select("claim_id").join(lines, "claim_id")
         .select("claim_id", tx.answer_prompt(F.format_string("claim %d", F.col("claim_id")),
                                              F.transform("_l", lambda s: s["line"])).alias("prompt"),
                 F.concat(F.lit("["), F.array_join(F.transform("_l", lambda s: s["cid"]), ", "), F.lit("]"))
                 .alias("citations")))
    return p.select(F.concat(F.lit("claim-"), F.col("claim_id").cast("string")).alias("claim_id"),
                    F.sha2("prompt", 256).alias("prompt_sha"), F.length("prompt").alias("prompt_len"), "citations")


TRACE_T = "array<struct<iteration:int,query:string,top1_distance:double,improved:boolean>>"


@query("trace_lookup", sql=f"""{WITH_LOOP},
{SQL_ANSWERS},
ids AS (SELECT 'claim-' || CAST(claim_id + d AS VARCHAR) AS claim_id FROM claims, (VALUES (0), (1)) v(d)),
rows AS (SELECT a.claim_id, unnest(from_json(a.trace, '[{{"iteration":"INTEGER","query":"VARCHAR",
                 "top1_distance":"DOUBLE","improved":"BOOLEAN"}}]'), recursive := true)
         FROM answers a JOIN ids ON ids.claim_id = a.claim_id)
SELECT claim_id, iteration, query, top1_distance, improved FROM rows""")
def trace_lookup(spark, sf_dir):
    """PRJ-10: decode stored trace JSON for looked-up claim ids; an absent id gives no row."""
    ans = answers_table(spark, sf_dir)
    emb = read_table(spark, sf_dir, "embeddings")
    ids = cl.claims(emb).select(F.explode(F.array(F.col("claim_id"), F.col("claim_id") + 1)).alias("n")).select(
        F.concat(F.lit("claim-"), F.col("n").cast("string")).alias("claim_id"))
    hit = ans.join(ids, "claim_id", "left_semi")
    return (hit.select("claim_id", F.inline(F.from_json("trace", TRACE_T)))
            .select("claim_id", "iteration", "query", "top1_distance", "improved"))
