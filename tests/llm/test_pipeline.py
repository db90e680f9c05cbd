from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

import corpus_pipeline as P
from citesift.llm.toxicity import fit
from tests.conftest import SF_SMALL
from tests.llm.test_entropy_mix import targets, words
from tests.llm.test_repeat_automata import brute as cut_by_hand
from tests.llm.test_suffix_pieces import library
from tests.llm.test_weighted_minhash import brute as classes_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def follow(spark, docs, sf_dir):
    """Run the stages one by one and hold each against a plain version of it."""
    rows = [tuple(r) for r in docs.collect()]
    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    order = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)

    out = P.STAGES[0][1](spark, docs, sf_dir)
    assert out.columns == docs.columns
    kept = [r for r in rows if model.score([r[1] or ""])[0] < 0.7]
    got = [tuple(r) for r in out.collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, kept))

    out = P.STAGES[1][1](spark, out, sf_dir)
    got = [tuple(r) for r in out.collect()]
    classes = classes_by_hand(kept)
    full = [(r, c) for r, c in zip(kept, classes) if words(r[1])]
    bare = [r for r in kept if not words(r[1])]
    assert sorted(map(str, (r[0] for r in got))) == sorted(map(str, [*{c for _, c in full}, *[r[0] for r in bare]]))
    assert set(map(repr, got)) <= set(map(repr, kept))

    before = sorted(got, key=order)
    out = P.STAGES[2][1](spark, out, sf_dir)
    got = [tuple(r) for r in out.collect()]
    want = []
    for r, (_, _, n, _, text) in zip(before, cut_by_hand(before)):
        text = text if n else r[1]
        want.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    assert Counter(map(repr, got)) == Counter(map(repr, want))

    before = got
    out = P.STAGES[3][1](spark, out, sf_dir)
    got = [tuple(r) for r in out.collect()]
    times, given = Counter(map(repr, got)), Counter(map(repr, before))
    assert all(n <= 2 * given[r] for r, n in times.items())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += words(r[1])
    for r in got:
        taken[r[3]] += words(r[1])
    goal = targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 150 for s in sizes)

    out = P.STAGES[4][1](spark, out, sf_dir)
    ids = sorted((str(r.doc_id), r.token_ids) for r in out.collect())
    assert ids == sorted((str(r[0]), x) for r, x in zip(got, library([r[1] for r in got])))
    return ids


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_stages_and_run_over_the_small_table(spark, small):
    assert [c for c in small.columns] == COLUMNS
    assert all(r.n_chars == len(r.text) for r in small.collect())
    ids = follow(spark, small, SF_SMALL)
    assert sorted((str(r.doc_id), r.token_ids) for r in P.run(spark, SF_SMALL).collect()) == ids


def test_nulls_repeats_and_clashing_columns(spark, small):
    schema = T.StructType([*small.schema.fields, T.StructField("score", T.StringType()), T.StructField("__h", T.LongType())])
    rows = [(*r, "s", 1) for r in small.limit(60).collect()]
    rows += [(None, "no key at all", None, None, None, None, None), (9_000, None, None, "src1", None, "x", 2),
             (9_001, "", "en", None, 0, None, None), (9_002, "long " * 20_000, "en", "src2", 1, "", 0), rows[0], rows[0]]
    follow(spark, spark.createDataFrame(rows, schema), SF_SMALL)


def test_empty_table(spark, small):
    docs = small.limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0
