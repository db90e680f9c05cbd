import random

import public_tokenizers
from pyspark.sql import types as T

from citesift.llm.suffix_pieces import decode, encode
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("n_tokens", T.StringType())])


def library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [sp.encode(t or "") for t in texts]


def test_ids_equal_the_library_and_come_back(spark):
    rnd = random.Random(6)
    parts = [*"abcdefghijklmnopqrstuvwxyz ABC  \n\t.,'0123456789éñü中👍", "▁", "\0", "the ", " and", "tion", "    ", "____", "<s>",
             "<0x0A>", "ing", "====", "́"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 120))) for _ in range(400)]
    texts += [None, "", " ", "   ", "a" * 5000, "=" * 900, "the" * 300 + " " * 70, "wörd " * 30_000, "x", "x"]
    ids = [*range(400), None, 1, 1, 2, 3, 4, 5, 6, 7, 7]
    out = encode(spark.createDataFrame([(i, t, "") for i, t in zip(ids, texts)], SCHEMA))
    got = sorted((str(r.doc_id), r.token_ids) for r in out.collect())
    assert got == sorted((str(i), x) for i, x in zip(ids, library(texts)))
    assert all(r.n_tokens == len(r.token_ids) for r in out.collect())
    back = sorted((str(r.doc_id), r.text) for r in decode(out).collect())
    assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t in zip(ids, texts))
    marks = sum("▁" in (t or "") for t in texts)
    assert out.where("not restored").count() == marks


def test_tables_of_one_short_word_and_blocks_with_one_new_word(spark):
    from citesift.llm.suffix_pieces import Pieces

    for texts in (["hello"], ["a"], ["aaaa"], ["é"], [None, "", "x"]):
        got = encode(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()
        assert [r.token_ids for r in sorted(got, key=lambda r: r.doc_id)] == library(texts)
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for block in (["the quick brown fox jumps over the lazy dog " * 20], ["the zebra"], ["q"], ["the quick", "ab"], ["the"]):
        assert [x.tolist() for x in pieces.encode(block)] == library(block)


def test_empty_table(spark):
    out = encode(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and decode(out).count() == 0


def test_query_over_the_whole_table(spark):
    from citesift.llm.queries import op3_suffix_pieces

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.token_ids, r.restored) for r in op3_suffix_pieces(spark, SF_SMALL).collect()}
    assert got == {i: (x, True) for i, x in zip(docs, library(docs.values()))}
