import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

from citesift.llm.entropy_mix import apply_mix, entropy_mix

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("size", T.StringType())])


def targets(sizes):
    """Share 150 % of all words by weights 3, 1, 2; what is above twice a source goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, got, near):
    sizes = defaultdict(int)
    for _, text, source, *_ in docs:
        sizes[source] += words(text)
    want = targets(sizes)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d[0], words(d[1]), d[2]) for d in docs)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(want[s], most[s]), (s, taken[s], want[s])


def test_small_table_with_nulls_repeats_and_a_hot_source(spark):
    docs = []
    for i in range(3000):
        source = "big" if i % 3 else f"s{i % 7}" if i % 5 else None
        text = None if i % 97 == 0 else "" if i % 89 == 0 else "w " * (1 + (i * 7919) % 400)
        docs.append((None if i % 50 == 0 else i, text, source, "clash"))
    docs += [(5, "same words here", "big", "x")] * 40 + [(9000, "word " * 30_000, "s1", "long")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = entropy_mix(df).collect()
    check(docs, got, lambda target, most: 0.005 * target + 60)
    again = entropy_mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_applied_mix_repeats_whole_rows(spark):
    docs = [(i, "w " * (1 + i % 60), f"s{i % 4}", "keep") for i in range(400)] + [(None, "a b", None, "n")]
    df = spark.createDataFrame(docs, SCHEMA)
    want = Counter()
    for r in entropy_mix(df).collect():
        want[r.doc_id] += r.copies
    out = apply_mix(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_null_keys_and_repeated_rows_meet_the_target(spark):
    docs = [(None, f"{i} " * 10, "a", "n") for i in range(600)] + [(7, "one two three", "b", "n")] * 9000
    docs += [(i, "w " * (1 + i % 9), "c", "n") for i in range(400)] + [(None, None, "c", "n")] * 5000
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    got = entropy_mix(df).collect()
    check(docs, got, lambda target, most: 2 * most)
    assert len({r.copies for r in got if r.doc_id == 7}) == 2
    out = Counter((r.doc_id, r.text) for r in apply_mix(df).collect())
    want = Counter()
    for r in entropy_mix(df).collect():
        want[r.doc_id] += r.copies
    assert Counter({i: sum(n for (k, _), n in out.items() if k == i) for i in want}) == want


def solved(spark, sources):
    """Words that each source's rates take, by counts: ``sources`` has {size: documents} and the target as a share."""
    import math

    from citesift.llm import entropy_mix as E
    from citesift.llm.shared import Tables

    full = {s: sum(k * n for k, n in c.items()) for s, (c, _) in sources.items()}
    counts = spark.createDataFrame([(False, s, k, n) for s, (c, _) in sources.items() for k, n in c.items()],
                                   "unnamed boolean, source string, size bigint, n bigint")
    goals = spark.createDataFrame([(False, s, full[s], share * full[s]) for s, (_, share) in sources.items()],
                                  "unnamed boolean, source string, source_size bigint, target double")
    duals = E._solve(Tables(spark, "entropy_mix_test"), counts, goals, 2).collect()
    return {r.source: sum(k * n * min(2.0, math.exp(min(700.0, r.lam * k / r.scale))) for k, n in sources[r.source][0].items())
            / full[r.source] for r in duals}


def test_short_documents_beside_one_of_millions_of_words(spark):
    sources = {"hot": ({300: 300_000, 8_000_000: 1}, 0.375), "up": ({300: 30_000, 5_000_000: 1}, 1.9),
               "tiny": ({0: 5, 1: 1, 5000: 1000, 10_000_000: 1}, 0.001), "even": ({200: 1000, 300: 1000}, 0.6)}
    got = solved(spark, sources)
    assert all(abs(got[s] - share) < 1e-6 for s, (_, share) in sources.items()), got


def test_a_missed_target_is_an_error(spark, monkeypatch):
    import pytest

    from citesift.llm import entropy_mix as E

    monkeypatch.setattr(E, "STEPS", 2)
    with pytest.raises(RuntimeError, match="'slow'"):
        solved(spark, {"slow": ({300: 1000, 8_000_000: 1}, 0.01), "done": ({5: 10}, 1.0)})


def test_empty_table_and_empty_texts(spark):
    assert entropy_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = entropy_mix(spark.createDataFrame([(1, "", "a", ""), (2, None, None, "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.taken, r.target) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_query_over_the_whole_table(spark):
    from citesift.llm.queries import op6_entropy_mix
    from tests.conftest import SF_MID

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    check(docs, op6_entropy_mix(spark, SF_MID).collect(), lambda target, most: 0.01 * target)
