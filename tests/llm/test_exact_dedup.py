import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from citesift.llm.binary_fuse import build
from citesift.llm.exact_dedup import exact_groups
from citesift.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()),
                       T.StructField("batch", T.StringType()), T.StructField("row", T.LongType())])


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub("[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for body, members in by.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return out


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def check(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, "d", "b", 1) for i, t in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in exact_groups(df, **settings).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def rows():
    out = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(150)]
    out += [(1000 + i, "hot  copy\tof\x0ba text") for i in range(90)] + [(2000 + i, "hotcopyofatext" + "\n" * i) for i in range(5)]
    out += [(None, "text 3"), (None, "text 3"), (None, None), (7, None), (7, ""), (8, " \t\n\x0b\x0c\r"), (9, " "), (10, "  ")]
    out += [(5, "tie"), (5, "tie"), (5, "ti e"), (6, "t ie"), (3000, "ä" * 70_000), (3001, "ä" * 69_999 + " ä"), (3002, "\x1c"), (3003, "\x85")]
    return out


@pytest.mark.parametrize("settings", [{}, {"batches": 3, "bits": 5}, {"batches": 1}])
def test_groups_are_those_of_brute_force(spark, settings):
    # with 5 bits filters let nearly everything through and buckets hold several texts: bytes decide
    check(spark, rows(), **settings)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_filter_holds_all_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(1)
    fuse = build(np.concatenate([keys, keys[:3]]))
    assert fuse.contains(keys).all()
    assert fuse.contains(rng.integers(0, 1 << 62, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)).mean() < 0.01
    assert n < 5000 or len(fuse.cells) < 1.4 * n


def test_whole_smallest_table(spark):
    from tests.conftest import SF_SMALL
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_fuse_dedup"](spark, SF_SMALL).collect()]
    assert sorted(got, key=key) == sorted(brute(given), key=key)
    assert any(r[2] > 1 for r in got)
