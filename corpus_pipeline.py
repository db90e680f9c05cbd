"""The corpus pipeline: five stages over ``documents``, each over all that the one before it kept.

1. ``toxicity`` learns from ``labels`` and drops documents that score 0.7 or more.
2. ``minhash_near_dedup`` keeps one document of each class of near-duplicates.
3. ``substring_dedup`` cuts passages of 50 words or more that an earlier document holds too.
4. ``mixing`` takes documents by entropy balancing: none, one or two copies of each.
5. ``sentencepiece`` encodes whole texts and decodes them again.

All stages but the last return the columns of their input.  Null keys, texts, languages and sources pass
through (see each operator for what it makes of them), rows that repeat are handled as the operators say, further
columns are carried along, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.llm.entropy_mix import apply_mix
from citesift.llm.repeat_automata import remove_repeats
from citesift.llm.shared import Tables, fresh, scan
from citesift.llm.suffix_pieces import encode
from citesift.llm.toxicity import fit, toxicity_scores
from citesift.llm.weighted_minhash import drop_near_texts

REJECT = 0.7
# no SQL has these stages' learned scores, near-duplicates and byte-pair merges; tests hold them against brute force
ORACLE_SQL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, all their columns as they came; null and empty texts score as texts without hits."""
    model = fit(docs.select("doc_id", "text"), scan(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")[0]
    return toxicity_scores(docs, model, score=score).where(F.col(score) < REJECT).drop(score)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the smallest key first, nulls last; all documents without words stay."""
    return drop_near_texts(docs, similar=0.8, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller key holds too; null keys neither cut nor are cut."""
    kept = remove_repeats(docs, length=50)
    if "n_chars" not in kept.columns:
        return kept
    kind = kept.schema["n_chars"].dataType
    return kept.withColumn("n_chars", F.length("text").cast(kind)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """None, one or two copies of each document, so that each source meets its target; a null source is the last one."""
    return apply_mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts and whether decoding gives the text again; null and empty texts have no ids."""
    return encode(docs, keys=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: ``doc_id, lang, source, n_tokens, token_ids, restored``."""
    tables = Tables(spark, "corpus_pipeline")
    docs, before = scan(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            tables.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
