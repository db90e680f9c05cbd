"""Text helpers against the Python behaviour they stand in for."""

import hashlib
import json

from pyspark.sql import functions as F

from citesift.functions import text as tx


def _one(spark, col, **vals):
    row = spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} string" for k in vals))
    return row.select(col.alias("v")).first()["v"]


def test_strip_reasoning(spark):
    raw = "  <think>a\nb</think>Answer <think>x</think>done\n\t"
    assert _one(spark, tx.strip_reasoning("c"), c=raw) == "Answer done"
    assert _one(spark, tx.strip_reasoning(F.lit(None).cast("string")), c="x") == ""


def test_clean_rewrite(spark):
    for raw, q in [('  "covered peril"  ', "q"), ("   ", "question"), ("x" * 300, "q"), ('""', "orig")]:
        want = raw.strip().strip('"')[:200] or q
        assert _one(spark, tx.clean_rewrite("r", "q"), r=raw, q=q) == want


def test_deterministic_completion_matches_python(spark):
    prompt = "Claim: é\nclauses"
    digest = hashlib.sha256(prompt.encode()).hexdigest()[:8]
    got = json.loads(_one(spark, tx.deterministic_completion("p"), p=prompt))
    assert got == {"answer": f"[fake-llm deterministic response {digest}]", "confidence": 0.5, "citations": []}


def test_reformulation_prompt_matches_python(spark):
    question, prior = "roof hail", ["first try", "it's \"quoted\"\nline", "don't"]
    want = (f'An insurance claim says: "{question}"\n'
            f"Previous search queries that did not find a strong match in the policy: {prior}\n"
            "Rewrite this as a short search query using formal insurance-policy terminology "
            "(coverage type, exclusion, deductible, limit) instead of the claimant's own words. "
            "Return only the rewritten query, nothing else.")
    df = spark.createDataFrame([(question, prior)], "q string, p array<string>")
    assert df.select(tx.reformulation_prompt("q", "p").alias("v")).first()["v"] == want
    empty = spark.createDataFrame([(question, [])], "q string, p array<string>")
    assert empty.select(tx.reformulation_prompt("q", "p").alias("v")).first()["v"] == question


def test_key_order_does_not_change_digest(spark, tmp_path):
    from citesift.plans.corpus import policy_digest
    from citesift.sources.nested import read_policies_json
    a = {"policy_id": "POL-001", "clauses": [{"clause_id": "c1", "topic": "t", "title": "T", "text": "x"}]}
    b = {"clauses": [{"text": "x", "title": "T", "clause_id": "c1", "topic": "t"}], "policy_id": "POL-001"}
    (tmp_path / "a.json").write_text(json.dumps(a) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(b) + "\n")
    d = [r["digest"] for r in policy_digest(read_policies_json(spark, str(tmp_path))).collect()]
    assert len(d) == 2 and d[0] == d[1]
