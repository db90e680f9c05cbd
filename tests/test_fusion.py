"""Reciprocal rank fusion: rank beats raw distance, first-seen tie order, payload from the last list."""

from pyspark.sql import functions as F

from citesift.operators import fusion

ROWS = [
    # claim, list_no, rank, id, distance, payload
    ("c1", 1, 1, "a", 0.10, "a-l1"), ("c1", 1, 2, "b", 0.11, "b-l1"), ("c1", 1, 3, "c", 0.12, "c-l1"),
    # list 2 has a much smaller distance scale: min-distance would let "x" win, RRF must not
    ("c1", 2, 1, "a", 0.001, "a-l2"), ("c1", 2, 2, "x", 0.0011, "x-l2"), ("c1", 2, 3, "b", 0.0012, "b-l2"),
    # tie: two different rank-1 ids in two lists of another claim
    ("c2", 1, 1, "p", 0.5, "p1"), ("c2", 2, 1, "q", 0.4, "q2"),
]
SCHEMA = "claim string, list_no int, rank int, id string, distance double, payload string"


def test_rank_beats_raw_distance(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    top = fusion.fused_order(fusion.rrf(df, ["claim"], payload=["payload"]), ["claim"], n=3)
    got = [r["id"] for r in top.where(F.col("claim") == "c1").orderBy("fused_rank").collect()]
    assert got == ["a", "b", "x"]
    md = fusion.min_distance_order(fusion.min_distance_fusion(df, ["claim"]), ["claim"], n=3)
    assert [r["id"] for r in md.where(F.col("claim") == "c1").orderBy("fused_rank").collect()] == ["a", "x", "b"]


def test_tie_keeps_first_seen_order_and_last_payload(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    fused = fusion.rrf(df, ["claim"], payload=["payload"])
    top = fusion.fused_order(fused, ["claim"], n=None)
    c2 = [r["id"] for r in top.where(F.col("claim") == "c2").orderBy("fused_rank").collect()]
    assert c2 == ["p", "q"]
    a = fused.where((F.col("claim") == "c1") & (F.col("id") == "a")).first()
    assert a["payload"] == "a-l2" and abs(a["score"] - 2 / 61) < 1e-12
    assert (a["first_list"], a["first_rank"]) == (1, 1)


def test_union_dedup(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert fusion.union_dedup_fusion(df, ["claim"]).count() == 6
