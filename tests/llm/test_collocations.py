import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.llm import collocations as C
from citesift.llm.collocations import collocations
from citesift.llm.queries import QUERIES
from citesift.llm.shared import Tables

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("phrase", T.StringType()), T.StructField("k", T.StringType())])
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cands.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in cands.items():
            if longer[p] and 100 * longer[p] >= 50 * a:
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def check(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, g, "p", "k") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in collocations(df, **settings).collect())
    want = brute(rows, **settings)
    assert got == want
    return got


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["é", "Ä", "İ", "x" * 300, "the"]
    out = []
    for i in range(300):
        body = " ".join(rng.choice(words, 40, p=np.r_[np.full(34, 0.6 / 34), 0.4]))
        out.append((body + [". ", "; The the  the\tTHE", ",a b c a b c", "\x0bnew york city!"][i % 4], [None, "und", "en", "de", "en"][i % 5]))
    return out + [(None, "en"), ("", None), ("  \t ", "xx"), (".,;", "en"), ("same line again and again " * 3, "en")] + [("same line again", "fr")] * 12


def test_counts_cuts_and_drops(spark):
    got = check(spark, texts())
    assert {g[0] for g in got} == {"en", "de", "und", "fr"}
    check(spark, texts(), most=7, least=3)


def test_many_candidates_meet_in_groups(spark):
    check(spark, texts(), most=2, least=2)


def test_long_text_in_slices_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 500)
    long = ("alpha beta gamma, alpha beta. delta " * 400, "en")
    check(spark, [long, ("alpha beta " * 300, None)])
    raw = np.frombuffer(long[0].encode(), np.uint8)
    parts = [p.tobytes() for p, _ in C._cut(raw, np.array([0, len(raw)]))]
    assert b"".join(parts) == long[0].encode() and len(parts) > 3
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    check(spark, [("a b", "en")])


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_lockstep_over_any_cuts(spark, parts):
    rows = []
    for w in ("a", "b", "c"):
        rows.append(("x", w, 1, 500, [w]))
        for v in ("a", "b", "c", "d"):
            rows.append(("x", f"{w} {v}", 2, 100 + ord(v), [w, v]))
            rows += [("x", f"{w} {v} t{i:02}", 3, 10 + (i * 7 + ord(v)) % 41, [w, v, f"t{i:02}"]) for i in range(25)]
    df = spark.createDataFrame(rows, "lang string, phrase string, k int, f bigint, w array<string>")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C._merged(Tables(spark, "t"), df, [F.get("w", i) for i in range(3)], "one", "two", "most", "m").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    f = {tuple(r[4]): r[3] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = tuple(r.w)
        assert r.one == f[w[:1]]
        if len(w) > 1:
            assert r.two == f[w[:2]]
        if len(w) == 2:
            assert r.most == max(v for p, v in f.items() if len(p) == 3 and p[:2] == w)


def test_lockstep_in_batches_of_any_size():
    k = [1, 2, 3, 3, 2, 3, 1, 2, 3, 3, 3]
    table = pa.table({"k": pa.array(k, pa.int32()), "f": pa.array(range(20, 31), pa.int64()), "tag": pa.array(range(11), pa.int64())})
    whole = sorted(tuple(r.values()) for b in C._lockstep(iter(table.to_batches())) for r in b.to_pylist())
    for size in (1, 2, 3, 5):
        assert sorted(tuple(r.values()) for b in C._lockstep(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()) == whole


def test_whole_smallest_table(spark):
    from tests.conftest import SF_SMALL
    given = [(r.text, r.lang) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text", "lang").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_collocations"](spark, SF_SMALL).collect())
    assert got == brute(given) and got
