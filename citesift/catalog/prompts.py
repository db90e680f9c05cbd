"""Prompt and completion text queries over ``conversations`` (PRJ-6, PRJ-7, PRJ-8).

User turns play the claim questions and search queries, assistant turns the raw provider completions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.functions import text as tx
from citesift.sources.tables import read_table

WS = tx.PY_WHITESPACE


def sql_strip(x: str) -> str:
    return "regexp_replace(" + x + ", '^" + WS + "+|" + WS + "+$', '', 'g')"


SQL_PYREPR = """CASE WHEN contains({s}, '''') AND NOT contains({s}, '"')
     THEN '"' || replace(replace(replace(replace({s}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"'
     ELSE '''' || replace(replace(replace(replace(replace({s}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'),
                                  chr(9), '\\t'), '''', '\\''') || '''' END"""


@query("strip_reasoning", sql=f"""
SELECT conv_id, turn, CAST(length(c) AS INTEGER) AS content_len, sha256(c) AS content_sha FROM (
  SELECT conv_id, turn,
         {sql_strip("regexp_replace(coalesce(text, ''), '(?s)<think>.*?</think>', '', 'g')")} AS c
  FROM conversations WHERE role = 'assistant')""")
def strip_reasoning(spark, sf_dir):
    """PRJ-6: remove reasoning blocks from every assistant completion and trim it."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    c = tx.strip_reasoning("text")
    return conv.select("conv_id", "turn", F.length(c).alias("content_len"), F.sha2(c, 256).alias("content_sha"))


@query("clean_rewrite", sql=f"""
SELECT a.conv_id, a.turn,
       coalesce(nullif(substr(trim({sql_strip("a.text")}, '"'), 1, 200), ''), u.text) AS rewritten
FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
WHERE a.role = 'assistant'""")
def clean_rewrite(spark, sf_dir):
    """PRJ-7: an assistant turn read as a rewritten query: trimmed, unquoted, cut to 200; empty -> question."""
    conv = read_table(spark, sf_dir, "conversations")
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("raw"))
    u = conv.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                   F.col("text").alias("question"))
    return a.join(u, ["conv_id", "turn"]).select("conv_id", "turn",
                                                 tx.clean_rewrite("raw", "question").alias("rewritten"))


@query("reformulation_prompt", sql=f"""
WITH p AS (
  SELECT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question,
         coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  []) AS prior
  FROM conversations WHERE role = 'user'),
r AS (
  SELECT conv_id, turn,
         CASE WHEN len(prior) = 0 THEN question ELSE
           'An insurance claim says: "' || question || '"' || chr(10)
           || 'Previous search queries that did not find a strong match in the policy: ['
           || array_to_string(list_transform(prior, lambda s: {SQL_PYREPR.replace("{s}", "s")}), ', ') || ']' || chr(10)
           || 'Rewrite this as a short search query using formal insurance-policy terminology '
           || '(coverage type, exclusion, deductible, limit) instead of the claimant''s own words. '
           || 'Return only the rewritten query, nothing else.' END AS prompt
  FROM p)
SELECT conv_id, turn, CAST(length(prompt) AS INTEGER) AS prompt_len, sha256(prompt) AS prompt_sha FROM r""")
def reformulation_prompt(spark, sf_dir):
    """PRJ-8: the k-th user turn of a conversation is the k-th search; from the second on, the provider is asked
    to rewrite the first turn given all previous searches in order.  One window over a conversation's own
    turns: the prompt cites them all, so they meet in one row anyway."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    turns = Window.partitionBy("conv_id").orderBy("turn")
    j = conv.select("conv_id", "turn", F.first("text").over(turns).alias("question"),
                    F.collect_list("text").over(turns.rowsBetween(Window.unboundedPreceding, -1)).alias("prior"))
    prompt = tx.reformulation_prompt("question", "prior")
    return j.select("conv_id", "turn", F.length(prompt).alias("prompt_len"), F.sha2(prompt, 256).alias("prompt_sha"))
