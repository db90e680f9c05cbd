import random

import public_tokenizers
import pytest
from pyspark.sql import types as T

from citesift.llm.token_counts import token_counts

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("n_tokens", T.StringType())])


def _reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def test_counts_equal_whole_text_encoding(spark):
    rnd = random.Random(5)
    alphabet = ["a", "B", "é", "é", " ", "\n", "\t", " ", " ", "\x1c", "1", "'s", "<|endoftext|>", "!", "σ", "Σ",
                "中", "́", "👍", "don't", "\x0b", "\x85"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    texts += [None, "", "   \n", "x" * 30_000, "wörd " * 40_000, "ab́ " * 10, "ab́ " * 10]
    ids = [*range(300), None, 1, 1, 7, 8, 9, 9]
    got = token_counts(spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], SCHEMA)).collect()
    want = sorted(zip([-1 if i is None else i for i in ids], [len((t or "").encode()) for t in texts], _reference(texts)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_whole_table(spark):
    from citesift.llm.queries import op5_token_counts
    from tests.conftest import SF_SMALL

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op5_token_counts(spark, SF_SMALL).collect()}
    assert got == dict(zip(docs, _reference(docs.values())))
