"""Order policies: multiset digest and clause numbering without gathering an order's lines."""

from citesift.plans import corpus as cp

LI = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
      "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
ORD = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _line(order, line_no, qty, part=1):
    return (order, part, 2, line_no, qty, 10.5, 0.05, 0.02, "N", "O")


def _orders(spark, keys):
    return spark.createDataFrame([(k, 7, "O", 99.99, "1-URGENT") for k in keys], ORD)


def _digests(spark, lines, keys=(1,)):
    li = spark.createDataFrame(lines, LI)
    return {r["policy_id"]: r["digest"] for r in cp.order_policies(_orders(spark, keys), li, 1).collect()}


def test_digest_ignores_row_order_and_sees_content(spark):
    a = [_line(1, 1, 5.0), _line(1, 2, 3.0), _line(1, 2, 4.0)]
    base = _digests(spark, a)[1]
    assert _digests(spark, list(reversed(a)))[1] == base
    assert _digests(spark, [_line(1, 1, 5.0), _line(1, 2, 3.0), _line(1, 2, 4.5)])[1] != base
    # a duplicated line is a different multiset (sums, not xor, so copies do not cancel)
    assert _digests(spark, a + [_line(1, 1, 5.0)])[1] != base
    assert _digests(spark, a[:1] + a[:1])[1] != _digests(spark, [])[1]


def test_order_without_lines_has_a_digest(spark):
    d = _digests(spark, [_line(2, 1, 1.0)], keys=(1, 2))
    assert d[1] is not None and d[2] is not None and d[1] != d[2]


def test_numbering_follows_line_then_text(spark):
    lines = [_line(1, 2, 3.0), _line(1, 1, 9.0), _line(1, 2, 1.0), _line(13, 1, 1.0)]
    li = spark.createDataFrame(lines, LI)
    rows = cp.numbered_order_lines(_orders(spark, (1, 13)), li).collect()
    got = {(r["version"], r["id"]): r["text"].split("|")[3] for r in rows}
    # order 13 is not kept in version 1 (o_orderkey % 13 = 0) but is in version 2
    assert got == {(1, "1-1"): "900", (1, "1-2"): "100", (1, "1-3"): "300",
                   (2, "1-1"): "900", (2, "1-2"): "100", (2, "1-3"): "300", (2, "13-1"): "100"}
    assert {r["policy_id"] for r in rows if r["version"] == 1} == {1}


def test_stored_policies_and_manifest_give_the_same_vectors(spark, monkeypatch):
    from tests.conftest import SF_SMALL

    o, li = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("orders", "lineitem"))
    want, _ = cp.incremental_vectors(o, li)
    old, today = cp.manifest_of(cp.order_policies(o, li, 1)), cp.order_policies(o, li, 2)

    def never(*_):
        raise AssertionError("policies that are stored were made again")
    monkeypatch.setattr(cp, "order_policies", never)
    got, _ = cp.incremental_vectors(o, li, current=today, manifest=old)
    assert sorted(got.collect()) == sorted(want.collect())
