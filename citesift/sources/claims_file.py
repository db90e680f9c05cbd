"""Golden claims as JSON Lines (SRC-6): a claim a line, and a line for each clause that answers it.

Labels are lines of their own, not a list inside the claim, so a claim that very many clauses answer is no long line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLAIMS_SCHEMA = "claim_id bigint, question string, budget int"
LABELS_SCHEMA = "claim_id bigint, id bigint"


def write_claims(claims: DataFrame, labels: DataFrame, path: str) -> None:
    """``claims (claim_id, question, budget)`` and ``labels (claim_id, id)`` under ``path``."""
    claims.select("claim_id", "question", "budget").write.mode("overwrite").json(f"{path}/claims")
    labels.select("claim_id", "id").write.mode("overwrite").json(f"{path}/labels")


def read_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Claims and labels with a fixed schema; a line that is no JSON object of that schema is an error."""
    def lines(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")

    return lines("claims", CLAIMS_SCHEMA), lines("labels", LABELS_SCHEMA)
