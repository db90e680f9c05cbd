"""Paid calls over ``conversations`` through the ledger (UDF-2, UDF-3, WIN-5, WIN-6): every different text is one prompt.

The provider fails by the prompt's SHA-256: first digit 0 or 1 for good, 2 or 3 once, 4 every time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.functions import models
from citesift.functions.ledger import Ledger, prompt_sha
from citesift.session import work_dir
from citesift.sources.tables import read_table

FOR_GOOD, ONCE, ALWAYS = "01", "23", "4"
TASKS = 8


class FailsByHash(models.Provider):
    """Answers with the prompt's hash; which prompts fail, and how, follows from it too."""

    def __init__(self):
        self.failed: set[str] = set()

    def complete(self, prompt: str, max_tokens: int = models.DEFAULT_MAX_TOKENS) -> str:
        sha = prompt_sha(prompt)
        if sha[0] in FOR_GOOD:
            raise models.PermanentProviderError(sha)
        if sha[0] in ALWAYS or (sha[0] in ONCE and sha not in self.failed):
            self.failed.add(sha)
            raise models.TransientProviderError(sha)
        return f"answer {sha[:16]}"


models.register_provider("fails-by-hash", FailsByHash)


def _prompts(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))


def _complete(ledger, rows):
    return ledger.complete(rows, "prompt", provider="fails-by-hash", in_flight=TASKS, backoff_s=0.0)


@query("ledger_completions", sql="""WITH p AS (SELECT conv_id, turn, sha256(text) AS sha FROM conversations),
d AS (SELECT *, substr(sha, 1, 1) AS d FROM p)
SELECT conv_id, turn, CASE WHEN d > '4' OR d IN ('2', '3') THEN 'answer ' || substr(sha, 1, 16) END AS completion,
       CAST(CASE WHEN sha IS NULL THEN 0 WHEN d IN ('2', '3', '4') THEN 2 ELSE 1 END AS INTEGER) AS attempts,
       CASE WHEN d IN ('0', '1') THEN 'permanent' WHEN d = '4' THEN 'transient_retries_exhausted' END AS failure_type FROM d""")
def ledger_completions(spark, sf_dir):
    """UDF-2/3: every turn's text sent through the ledger; transient failures are really retried."""
    out, _ = _complete(Ledger(spark, work_dir(spark, "ledger")), _prompts(spark, sf_dir))
    return out.select("conv_id", "turn", "completion", "attempts", "failure_type")


@query("ledger_calls", sql="""WITH a AS (SELECT DISTINCT text FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT 1 AS run, (SELECT count(*) FROM a) AS sent
UNION ALL SELECT 2, (SELECT count(DISTINCT text) FROM conversations WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM a))
UNION ALL SELECT 3, 0""")
def ledger_calls(spark, sf_dir):
    """UDF-2: prompts paid for by three runs: the users' turns, then all turns, then all turns again."""
    ledger, rows = Ledger(spark, work_dir(spark, "ledger")), _prompts(spark, sf_dir)
    sent = [_complete(ledger, r)[1] for r in (rows.where(F.col("role") == "user"), rows, rows)]
    return spark.createDataFrame(list(enumerate(sent, 1)), "run int, sent bigint")
