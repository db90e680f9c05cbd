"""Text column expressions: hashed embeddings (UDF-1 default model), digests, prompts and clean-up
(PRJ-2..8, PRJ-5/6/7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIM = 64  # buckets of the hashed bag-of-tokens embedding
TOKEN_SPLIT = r"[^\p{L}]+"  # tokens are maximal runs of letters
# fixed values: prompt wording of the reformulation and answer steps
REWRITE_PROMPT_HEAD = 'An insurance claim says: "'
REWRITE_PROMPT_PRIOR = '"\nPrevious search queries that did not find a strong match in the policy: '
REWRITE_PROMPT_TAIL = ("\nRewrite this as a short search query using formal insurance-policy terminology "
                       "(coverage type, exclusion, deductible, limit) instead of the claimant's own words. "
                       "Return only the rewritten query, nothing else.")
ANSWER_PROMPT_HEAD = "Claim: "
ANSWER_PROMPT_MID = "\n\nRelevant policy clauses:\n"
ANSWER_PROMPT_TAIL = "\n\nAnswer the claim using only these clauses and cite the clause IDs."
FAKE_ANSWER_PREFIX = "[fake-llm deterministic response "
REWRITE_MAX_CHARS = 200
ANSWER_MAX_CHARS = 2000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- hashed embedding (H3) -------------------------------------------------------------------------
def token_buckets(df: DataFrame, key: str, text: str, dim: int = HASH_DIM) -> DataFrame:
    """(key, bucket, tf): lower-cased letter tokens hashed into ``dim`` buckets and counted.

    Every token of the whole text is used; the count is partially aggregated per (key, bucket).
    """
    tok = df.select(key, F.explode(F.split(F.lower(_c(text)), TOKEN_SPLIT)).alias("tok")).where(F.col("tok") != "")
    bucket = (F.conv(F.substring(F.md5(F.col("tok")), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    return tok.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("tf"))


def normalised_buckets(buckets: DataFrame, key: str) -> DataFrame:
    """Add the L2-normalised weight of every bucket (one document never spans more than ``dim`` rows)."""
    w = Window.partitionBy(key)
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w))
    return buckets.withColumn("weight", F.col("tf") / norm)


def dense_vector(weights: DataFrame, key: str, dim: int = HASH_DIM) -> DataFrame:
    """(key, embedding array<float>) from sparse (key, bucket, weight)."""
    m = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return m.select(key, vec.cast("array<float>").alias("embedding"))


def embed_hashed(df: DataFrame, key: str, text: str, dim: int = HASH_DIM) -> DataFrame:
    """UDF-1 default model, run entirely as JVM expressions: (key, embedding)."""
    return dense_vector(normalised_buckets(token_buckets(df, key, text, dim), key), key, dim)


def _vectors_of_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The vector of each row's tokens; null for a row that has none."""
    for tokens in batches:
        # a bounded number of rows at a time, as each has a dense row of counts
        parts = [_dense(tokens.slice(a, 8192)) for a in range(0, len(tokens), 8192)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))


def _dense(tokens: pa.Array) -> pa.Array:
    row, words = np.asarray(pc.list_parent_indices(tokens)), pc.list_flatten(tokens)
    some = np.asarray(pc.not_equal(words, "").fill_null(False))
    coded = words.dictionary_encode()
    bucket = np.array([int(hashlib.md5((w or "").encode()).hexdigest()[:8], 16) % HASH_DIM for w in coded.dictionary.to_pylist()], np.int64)
    code = np.asarray(coded.indices.fill_null(0))[some]
    tf = np.bincount(row[some] * HASH_DIM + bucket[code], minlength=len(tokens) * HASH_DIM).reshape(-1, HASH_DIM) if len(code) else np.zeros((len(tokens), HASH_DIM))
    square = (tf * tf).sum(axis=1)
    weight = (tf[square > 0] / np.sqrt(square[square > 0])[:, None]).astype(np.float32)
    stops = np.concatenate([[0], np.cumsum(square > 0) * HASH_DIM]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(weight.ravel()), mask=pa.array(square == 0))


def hashed_vector(text) -> Column:
    """UDF-1 default model of one text within its row: the same vector as :func:`embed_hashed`, null without tokens.

    Nothing is shuffled, so this is the form for many short texts whose keys are known to be unique.
    """
    dense = F.arrow_udf(_vectors_of_tokens, "array<float>")
    return dense(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), TOKEN_SPLIT))


# ---- digests and keys ------------------------------------------------------------------------------
def sha256(c) -> Column:
    return F.sha2(_c(c), 256)


def canonical_json_digest(struct_col: Column) -> Column:
    """PRJ-4: SHA-256 of the JSON text of a struct whose fields are listed in sorted order.

    Field order is fixed by the schema, so the key order of the input never matters; null fields are
    written (``ignoreNullFields=false``) so a null field and an absent one do not collide.
    """
    return F.sha2(F.to_json(struct_col, {"ignoreNullFields": "false"}), 256)


def policy_key(n: Column) -> Column:
    """PRJ-3: ``POL-003`` from a number."""
    return F.format_string("POL-%03d", n)


def last_key_part(c) -> Column:
    """PRJ-3: the part after the last ``-`` (clause number of ``POL-003-2.7`` is ``2.7``)."""
    return F.substring_index(_c(c), "-", -1)


def first_line(c) -> Column:
    return F.substring_index(_c(c), "\n", 1)


# ---- provider-side text ----------------------------------------------------------------------------
# whitespace as Python's str.strip() sees it (ASCII controls, separators, NEL and Unicode spaces)
PY_WHITESPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]"


def py_strip(c) -> Column:
    """Trim leading and trailing whitespace the way ``str.strip()`` does."""
    return F.regexp_replace(_c(c), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")


def strip_reasoning(c) -> Column:
    """PRJ-6: drop ``<think>...</think>`` blocks (non-greedy, across lines), trim; null -> ''."""
    return py_strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?s)<think>.*?</think>", ""))


def clean_rewrite(raw, question) -> Column:
    """PRJ-7: strip whitespace, strip quotes, cut to 200 chars; empty -> the original question."""
    stripped = F.btrim(py_strip(raw), F.lit('"'))
    cut = F.substring(stripped, 1, REWRITE_MAX_CHARS)
    return F.coalesce(F.nullif(cut, F.lit("")), _c(question))


def deterministic_completion(prompt) -> Column:
    """PRJ-5: the offline provider — a JSON answer carrying the first 8 hex digits of SHA-256(prompt)."""
    digest = F.substring(F.sha2(_c(prompt), 256), 1, 8)
    return F.to_json(F.struct(F.concat(F.lit(FAKE_ANSWER_PREFIX), digest, F.lit("]")).alias("answer"),
                              F.lit(0.5).alias("confidence"),
                              F.array().cast("array<string>").alias("citations")))


def python_str_repr(s: Column) -> Column:
    """``repr()`` of a string: single quotes unless it holds ' and no "; backslash, newline, CR, tab escaped."""
    esc = s
    for raw, rep in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(raw), F.lit(rep))
    double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def python_list_literal(arr) -> Column:
    """Render an array<string> the way a Python list prints: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), python_str_repr), ", "), F.lit("]"))


def reformulation_prompt(question, prior_queries) -> Column:
    """PRJ-8: first iteration passes the question through; later ones ask for a rewrite."""
    prompt = F.concat(F.lit(REWRITE_PROMPT_HEAD), _c(question), F.lit(REWRITE_PROMPT_PRIOR),
                      python_list_literal(prior_queries), F.lit(REWRITE_PROMPT_TAIL))
    return F.when(F.size(_c(prior_queries)) == 0, _c(question)).otherwise(prompt)


def answer_prompt(question, clause_lines) -> Column:
    """PRJ-9: ``Claim: ...`` + one ``[clause_id] title`` line per cited clause in fused order."""
    return F.concat(F.lit(ANSWER_PROMPT_HEAD), _c(question), F.lit(ANSWER_PROMPT_MID),
                    F.array_join(_c(clause_lines), "\n"), F.lit(ANSWER_PROMPT_TAIL))
