import random

import numpy as np
import pyarrow as pa
import pytest

from citesift.functions.fingerprints import fingerprints, text_blocks
from citesift.operators.containment import SCALES, _width, contained_in
from citesift.plans import golden as gd
from citesift.sources.claims_file import read_claims, write_claims


def _pairs(spark, passages, docs):
    p = spark.createDataFrame(passages, "claim_id bigint, text string")
    d = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    return sorted(tuple(r) for r in contained_in(p, d, passage_key="claim_id", doc_key="id").collect())


def test_containment_equals_brute_force(spark):
    rnd = random.Random(4)
    docs = [(i, "".join(rnd.choices("abé \n.", k=rnd.choice([0, 1, 5, 40, 400, 3000])))) for i in range(120)]
    passages = []
    for n in (1, 2, 3, 4, 7, 8, 15, 16, 31, 33, 64, 127, 128, 255, 256, 300, 1000):
        for _ in range(3):
            text = rnd.choice([t for _, t in docs if len(t) >= min(n, 400)])
            at = rnd.randrange(max(1, len(text) - n))
            passages.append((len(passages), text[at:at + n]))
        passages.append((len(passages), "".join(rnd.choices("abé", k=n))))
    hot = "a passage that very many documents hold, word for word, and some twice"
    docs += [(1000 + i, f"{i} {hot} {hot if i % 2 else ''}") for i in range(80)] + [(None, hot), (7, None), (7, f"again {hot}"), (2000, "x" * 50_000)]
    passages += [(900, hot), (901, ""), (902, None), (None, hot), (903, hot.upper()), (900, "x" * 300)]
    want = sorted({(p, d) for p, t in passages if p is not None and t for d, x in docs if d is not None and x and t in x})
    assert _pairs(spark, passages, docs) == want


def test_containment_of_empty_tables(spark):
    assert _pairs(spark, [], [(1, "a")]) == [] and _pairs(spark, [(1, "a")], []) == [] and _pairs(spark, [(1, "")], [(1, "a")]) == []


@pytest.mark.parametrize("k", SCALES)
def test_a_shared_passage_shares_all_its_fingerprints(k):
    rnd = random.Random(k)
    texts = ["".join(rnd.choices("abcd", k=rnd.randint(0, 600))) for _ in range(20)]
    span = k + _width(k) - 1
    parts = [t[5:5 + rnd.randint(span, span + 200)] for t in texts]
    (_, raw, offs), = text_blocks(pa.array(texts))
    (_, praw, poffs), = text_blocks(pa.array(parts))
    whole, inner = fingerprints(raw, offs, k, _width(k)), fingerprints(praw, poffs, k, _width(k))
    for i, part in enumerate(parts):
        mine = set(inner[1][inner[0] == i].tolist())
        assert mine <= set(whole[1][whole[0] == i].tolist())
        assert bool(mine) == (len(part) >= span)


def test_claims_file_round_trip_and_broken_lines(spark, tmp_path):
    claims = spark.createDataFrame([(1, "a \"b\"\nc", 300), (2, None, None)], "claim_id bigint, question string, budget int")
    labels = spark.createDataFrame([(1, 5), (1, 6)], "claim_id bigint, id bigint")
    write_claims(claims, labels, str(tmp_path / "c"))
    back, lab = read_claims(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == [(1, "a \"b\"\nc", 300), (2, None, None)] and lab.count() == 2
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(str(tmp_path / "c" / "claims"))
    with pytest.raises(Exception):
        read_claims(spark, str(tmp_path / "c"))[0].collect()


def test_scores_count_each_citation_and_only_labelled_claims(spark):
    out = spark.createDataFrame([("m", 1, "answered", 2, [5, 6, 5]), ("m", 2, "answered", 1, [9]), ("m", 3, "failed", 1, []), ("m", 4, "answered", 1, [1])],
                                "mode string, claim_id bigint, status string, iterations int, citations array<bigint>")
    labels = spark.createDataFrame([(1, 5), (1, 8), (2, 7), (3, 1)], "claim_id bigint, id bigint")
    got = {r.claim_id: (r.n_predicted, r.n_hits, r.n_truth, round(r.precision, 4)) for r in gd.scored_by_labels(out, labels).collect()}
    assert got == {1: (3, 2, 2, 0.6667), 2: (1, 0, 1, 0.0), 3: (0, 0, 1, 0.0)}
    claims = spark.createDataFrame([(1,), (2,), (3,), (4,)], "claim_id bigint")
    clauses = spark.createDataFrame([(5,), (7,), (8,)], "id bigint")
    assert tuple(gd.label_check(claims, labels, clauses).first()) == (4, 1, 1, False)
    hits = spark.createDataFrame([(1, 8), (1, 5), (2, 1), (9, 9)], "claim_id bigint, id bigint")
    assert tuple(gd.retrieval_share(hits, labels).first()) == (3, 1, 0.3333, False)


def test_fingerprints_of_no_text():
    assert len(fingerprints(np.zeros(0, np.uint8), np.array([0, 0]), 4, 5)[0]) == 0
