import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

from citesift.llm.kd_shards import kd_shards

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("shard", T.StringType())])


def check(docs, got, spread):
    want = Counter((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, load = defaultdict(list), Counter({s: 0 for s in range(24)})
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    fair = sum(load.values()) / 24
    assert max(load.values()) <= fair * (1 + spread) and min(load.values()) >= fair * (1 - spread), load


def test_hot_source_copies_nulls_and_repeats(spark):
    docs = [(i, None if i % 101 == 0 else f"{i} " * (1 + i * 31 % 57), None if i % 13 == 0 else "en",
             "hot" if i % 3 == 0 else f"s{i % 11}", "x") for i in range(6000)]
    docs += [(10_000 + i, "copy " * 40, "en", f"s{i % 3}", "x") for i in range(900)]
    docs += [(None, "z " * 90, None, None, "x")] * 30 + [(7, "t" * 5000, "de", "long", "x")]
    got = kd_shards(spark.createDataFrame(docs, SCHEMA)).collect()
    check(docs, got, 0.05)
    homes = defaultdict(set)
    for r in got:
        if r.size != 208:
            homes[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
    again = kd_shards(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_half_of_all_bytes_in_one_group(spark):
    docs = [(i, "copy " * 50, "en", "s", "") for i in range(3000)] + [(5000 + i, f"{i} " * 40, "en", "s", "") for i in range(3000)]
    check(docs, kd_shards(spark.createDataFrame(docs, SCHEMA)).collect(), 0.1)


def test_rows_with_null_or_equal_keys_are_cut_like_others(spark):
    docs = [(None, None, None, None, "")] * 6000 + [(i, f"{i} " * 4, "en", "s", "") for i in range(600)] + [(3, "same " * 9, "en", "s", "")] * 3000
    check(docs, kd_shards(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect(), 0.05)


def test_empty_and_tiny_tables(spark):
    assert kd_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    got = kd_shards(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [(1, 8, 0), (2, 8, 0)]


def test_query_over_the_whole_table(spark):
    from citesift.llm.queries import op8_kd_shards
    from tests.conftest import SF_MID

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    check(docs, op8_kd_shards(spark, SF_MID).collect(), 0.05)
