import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from citesift.llm.merkle_manifest import merkle_manifest
from citesift.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()),
                       T.StructField("leaf", T.StringType()), T.StructField("place", T.LongType())])
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    out = ""
    for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def climb(hashes, width):
    """Root of a list, and for each place the levels of (before, after)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // width * width
            paths[k].append((level[run:i], level[i + 1:run + width]))
        level = [sha("".join(level[i:i + width])) for i in range(0, len(level), width)]
        at = [i // width for i in at]
    return level[0], paths


def brute(rows, width=16):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees.append(climb([x[2] for x in by[s]], width))
    root, upper = climb([t[0] for t in trees], width)
    out = []
    for s, (sub, paths), up in zip(order, trees, upper):
        for (_, _, h, r), path in zip(by[s], paths):
            path = path + up
            start = h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                start = leaf(r, r["text"].translate(UPPER) if r["text"] is not None else None)
            folded = start
            for left, right in path:
                folded = sha("".join([*left, folded, *right]))
            out.append((r["doc_id"], h, sub, root, sha("".join("".join(a + b) for a, b in path)), folded, folded == root))
    return out


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def check(spark, rows, width=16):
    df = spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA.fields) for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle_manifest(df.repartition(5), width=width).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, width), key=key)


def row(i, source="s", text="Some Text", lang="en"):
    return {"doc_id": i, "source": source, "text": text, "lang": lang, "n_chars": None if text is None else len(text), "leaf": "x", "place": 3}


@pytest.mark.parametrize("n", [1, 16, 273])
def test_one_source_of_any_size(spark, n):
    check(spark, [row(i * 7, text=f"Text {i}") for i in range(n)])


def test_hot_source_nulls_ties_and_long_texts(spark):
    rows = [row(i, "hot", f"T {i}") for i in range(60)] + [row(i, None, None, None) for i in range(20)]
    rows += [row(None, "ß", "Null Key")] * 9 + [row(5, "tie", "A"), row(5, "tie", "B"), row(5, "tie", "B")]
    rows += [row(1000 + i, f"lone {i}", "Éa ä") for i in range(40)] + [row(2000, "Z", "Long TEXT " * 40_000), row(2001, "a", "")]
    check(spark, rows)
    check(spark, rows, width=2)
    check(spark, rows, width=3)


def test_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_smallest_table(spark):
    from tests.conftest import SF_SMALL
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF_SMALL).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[-1] for r in got} == {True, False}
