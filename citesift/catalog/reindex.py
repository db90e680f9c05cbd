"""Incremental reindex over stored state (JOB-2, JON-4, SNK-3, SNK-4, AGG-8): orders and their lines arrive by date; three runs, the
first ``LAST_DAYS`` before the last arrival, the second after it, the third over the same files."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.catalog.texts import _vectors
from citesift.plans import reindex as rx
from citesift.session import work_dir
from citesift.sources.tables import read_table

_SLICES = ", ".join(f"sum(('0x' || substr(sha256(text), {1 + 7 * i}, 7))::BIGINT) AS s{i}" for i in range(8))
SQL_ARRIVALS = f"""arr AS (
  SELECT o_orderkey AS policy_id, o_orderdate AS arrived, concat_ws('|', 'h', CAST(o_custkey AS VARCHAR), o_orderstatus,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), o_orderpriority) AS text FROM orders
  UNION ALL
  SELECT l_orderkey, l_shipdate, concat_ws('|', 'l', CAST(l_linenumber AS VARCHAR), p_name, CAST(l_suppkey AS VARCHAR),
         CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
         l_returnflag, l_linestatus) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
cut AS (SELECT max(arrived) AS d2, max(arrived) - INTERVAL {rx.LAST_DAYS} DAY AS d1 FROM arr)"""


def indexed(spark, sf_dir):
    """The index after three runs, and each run's counts."""
    orders, lineitem, part = (read_table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = rx.arrivals(orders, lineitem, part)
    path, index = work_dir(spark, "policy-files"), rx.PolicyIndex(spark, work_dir(spark, "policy-index"))
    last = rx.last_arrival(orders, lineitem)
    early = last - timedelta(days=rx.LAST_DAYS)
    rx.land(rows, path, until=early)
    counts = [index.run(path)]
    rx.land(rows, path, until=last, since=early)
    counts += [index.run(path), index.run(path)]
    return index, counts


@query("reindex_runs", sql=f"""WITH {SQL_ARRIVALS},
touched AS (SELECT DISTINCT policy_id FROM arr, cut WHERE arrived > d1)
SELECT 1 AS run, count(*) AS rows_hashed, count(DISTINCT policy_id) AS policies_checked, count(DISTINCT policy_id) AS policies_reembedded,
       count(*) AS chunks_embedded FROM arr, cut WHERE arrived <= d1
UNION ALL
SELECT 2, (SELECT count(*) FROM arr, cut WHERE strftime(arrived, '%Y-%m') >= strftime(d1, '%Y-%m')), (SELECT count(DISTINCT policy_id) FROM arr),
       (SELECT count(*) FROM touched), (SELECT count(*) FROM arr WHERE policy_id IN (SELECT policy_id FROM touched))
UNION ALL SELECT 3, 0, (SELECT count(DISTINCT policy_id) FROM arr), 0, 0""")
def reindex_runs(spark, sf_dir):
    """JOB-2 / AGG-8: what each run read, hashed and embedded; the run over unchanged files does none of it."""
    _, counts = indexed(spark, sf_dir)
    names = ("rows_hashed", "policies_checked", "policies_reembedded", "chunks_embedded")
    return spark.createDataFrame([(k, *[c[n] for n in names]) for k, c in enumerate(counts, 1)],
                                 "run int, " + ", ".join(f"{n} bigint" for n in names))


@query("reindex_manifest", sql=f"""WITH {SQL_ARRIVALS},
sums AS (SELECT policy_id, count(*) AS n, {_SLICES} FROM arr GROUP BY policy_id)
SELECT policy_id, n, sha256(concat_ws('|', n, {", ".join(f"s{i}" for i in range(8))})) AS digest FROM sums""")
def reindex_manifest(spark, sf_dir):
    """SNK-4: the stored manifest after added and subtracted parts equals one made from all rows."""
    return indexed(spark, sf_dir)[0].manifest()


@query("reindex_vectors", sql=f"""WITH {SQL_ARRIVALS},
chunks AS (SELECT CAST(policy_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY policy_id ORDER BY text) AS VARCHAR) AS id, policy_id, text FROM arr),
{_vectors("v", "chunks", ["id"])}
SELECT chunks.id, policy_id, sha256(text) AS text_sha,
       sha256(array_to_string(list_transform(v.v, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',')) AS vector_sha
FROM chunks JOIN v ON v.id = chunks.id""")
def reindex_vectors(spark, sf_dir):
    """SNK-3 / JOB-2: the stored vector table after three runs, embeddings included, equals one made from all rows."""
    v = indexed(spark, sf_dir)[0].vectors()
    # most weights are 0 and need no decimal arithmetic
    rounded = F.transform("embedding", lambda x: F.when(x == 0, "0").otherwise(
        F.round(x.cast("double") * 1000000).cast("bigint").cast("string")))
    return v.select("id", "policy_id", "text_sha", F.sha2(F.array_join(rounded, ","), 256).alias("vector_sha"))
