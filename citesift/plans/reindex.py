"""Incremental reindex over stored state (JOB-2, JON-4, SNK-4, AGG-8).

Policies arrive as rows ``policy_id, text`` in files; a policy's rows may be spread over any number of files.  Four
tables are kept under one folder:

* ``files``: the files read so far, with size, modification time and the run that read them;
* ``parts``: per run, the file, policy, count and hash slices of each row (a multiset hash is additive, so the sums of a
  file can be taken off later);
* ``manifest``: per policy the sums of these over all its files, and the digest;
* ``vectors``: ``id, policy_id, text_sha, embedding``.

A run lists the files and reads only those that are new or changed.  What they hold is added to the manifest's sums, what
superseded files held is subtracted, and only the policies whose sums move get a new digest; only the rows of those are
embedded again.  A run over unchanged files reads no row.  Manifest, parts and vectors are logs by run: a run writes
only what it changed, and a run that is repeated after a failure overwrites its own folders alone, because the list of
files is committed last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citesift.functions.models import encoder
from citesift.operators.keyfilter import may_hold
from citesift.operators.ordinal import ordinal_within
from citesift.session import cut_lineage, free_shuffles
from citesift.sinks.snapshot import current_snapshot, fold_log, read_latest, read_snapshot, write_epoch, write_snapshot

# fixed values: a row's SHA-256 enters the sums as 8 slices of 7 hex digits (28 bits each)
SLICES, SLICE_HEX = 8, 7
SUMS = ["n", *[f"s{i}" for i in range(SLICES)]]


def _same_path(col: str) -> Column:
    """One spelling for paths that sources write as ``file:/x`` or ``file:///x``."""
    return F.regexp_replace(col, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, modified`` of the Parquet files under ``path``; no file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(_same_path("path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def row_slices(rows: DataFrame) -> DataFrame:
    """A count of 1 and the hash slices of each of ``rows (path, policy_id, text)``; null texts count as empty."""
    h = rows.select("path", "policy_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    cut = [F.conv(F.substring("h", 1 + SLICE_HEX * i, SLICE_HEX), 16, 10).cast("int").alias(f"s{i}") for i in range(SLICES)]
    return h.select("path", "policy_id", F.lit(1).alias("n"), *cut)


def part_sums(rows: DataFrame) -> DataFrame:
    """Per file and policy of ``rows (path, policy_id, text)`` the row count and slice sums."""
    return row_slices(rows).groupBy("path", "policy_id").agg(*[F.sum(c).alias(c) for c in SUMS])


def digest_of_sums() -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in SUMS]), 256)


class PolicyIndex:
    """Stored manifest and vector table of policies that arrive in files."""

    def __init__(self, spark: SparkSession, root: str, *, model: str = "hashed"):
        self.spark, self.root, self.model = spark, root, model

    def manifest(self) -> DataFrame:
        """``policy_id, n, digest`` of the policies that have rows."""
        table = read_latest(self.spark, f"{self.root}/manifest", ["policy_id"], unique=True)
        if table is None:
            return self.spark.createDataFrame([], "policy_id bigint, n bigint, digest string")
        return table.where("n > 0").select("policy_id", "n", "digest")

    def vectors(self) -> DataFrame:
        """``id, policy_id, text_sha, embedding``; rows of dropped clauses stay, as nothing is ever deleted."""
        return read_latest(self.spark, f"{self.root}/vectors", ["id"], unique=True, within=["policy_id"])

    def fold(self) -> None:
        """Fold the manifest's and the vectors' runs, but the last, into one table each."""
        fold_log(self.spark, f"{self.root}/manifest", ["policy_id"])
        fold_log(self.spark, f"{self.root}/vectors", ["id"])

    def run(self, path: str) -> dict[str, int]:
        """Bring manifest and vectors up to the files under ``path``; the run's counts.

        ``files_read``, ``rows_hashed``, ``policies_checked`` (all that have rows), ``policies_reembedded`` (new or
        changed) and ``chunks_embedded``.  The counts are observed while the tables are written, not by further scans.
        """
        spark, run = self.spark, (current_snapshot(self.spark, f"{self.root}/files") or 0) + 1
        now = cut_lineage(list_files(spark, path))
        known = read_snapshot(spark, f"{self.root}/files")
        if known is None:
            known = spark.createDataFrame([], "path string, size bigint, modified timestamp, run int")
        fresh = now.join(known, ["path", "size", "modified"], "left_anti")
        left = known.join(now, ["path", "size", "modified"], "left_semi")
        stale = known.join(now, ["path", "size", "modified"], "left_anti").select("path", "run")
        # paths only, as Spark itself lists them to plan a scan
        paths = [r["path"] for r in fresh.select("path").collect()]
        counts = {"files_read": len(paths), "rows_hashed": 0, "policies_reembedded": 0, "chunks_embedded": 0}
        if paths or stale.limit(1).count():
            moved = self._move(run, paths, stale, counts)
            free_shuffles(spark)
            self._embed(run, paths, moved, left, counts)
            free_shuffles(spark)
            files = left.unionByName(fresh.withColumn("run", F.lit(run)))
            write_snapshot(files, f"{self.root}/files")
        counts["policies_checked"] = self.manifest().count()
        return counts

    def _move(self, run: int, paths: list[str], stale: DataFrame, counts: dict) -> DataFrame:
        """Write this run's parts and manifest rows; the policies whose digest moved."""
        spark, changes = self.spark, []
        if paths:
            seen = Observation()
            rows = spark.read.parquet(*paths).select(_same_path("_metadata.file_path").alias("path"), "policy_id", "text")
            write_epoch(row_slices(rows.observe(seen, F.count(F.lit(1)).alias("rows"))), f"{self.root}/parts", run)
            counts["rows_hashed"] = seen.get["rows"]
            changes.append(spark.read.parquet(f"{self.root}/parts/epoch={run}").select("policy_id", *SUMS))
        if run > 1:
            old = spark.read.parquet(f"{self.root}/parts").where(F.col("epoch") < run)
            # lists of files are small: what they are held against stays where it is
            gone = old.join(F.broadcast(stale.withColumnRenamed("run", "epoch")), ["path", "epoch"], "left_semi")
            changes.append(gone.select("policy_id", *[(-F.col(c)).alias(c) for c in SUMS]))
        delta = reduce(DataFrame.unionByName, changes).groupBy("policy_id").agg(*[F.sum(c).alias(f"d_{c}") for c in SUMS])
        delta = delta.where(" or ".join(f"d_{c} <> 0" for c in SUMS))
        before = read_latest(spark, f"{self.root}/manifest", ["policy_id"], before=run, unique=True) if run > 1 else None
        if before is None:
            summed = delta.select("policy_id", *[F.col(f"d_{c}").alias(c) for c in SUMS])
        else:
            # the sums of policies that did not move stay where they are
            delta = cut_lineage(delta)
            before = before.where(may_hold(delta.select("policy_id"), ["policy_id"])).select("policy_id", *SUMS)
            summed = delta.join(before, "policy_id", "left").select(
                "policy_id", *[(F.col(f"d_{c}") + F.coalesce(c, F.lit(0))).alias(c) for c in SUMS])
        # a policy without rows stays in the log with a count of 0: that is how later runs know it went
        write_epoch(summed.withColumn("digest", F.when(F.col("n") > 0, digest_of_sums())), f"{self.root}/manifest", run)
        return spark.read.parquet(f"{self.root}/manifest/epoch={run}").where("n > 0").select("policy_id", "n")

    def _embed(self, run: int, paths: list[str], moved: DataFrame, left: DataFrame, counts: dict) -> None:
        """Embed the rows of the policies that moved (``policy_id``, and ``n`` rows each), from the files that hold them."""
        ids = moved.select("policy_id")
        if run > 1:
            touched = may_hold(ids, ["policy_id"])
            parts = self.spark.read.parquet(f"{self.root}/parts")
            held = F.broadcast(left.withColumnRenamed("run", "epoch"))
            held = parts.join(held, ["path", "epoch"], "left_semi").unionByName(parts.where(F.col("epoch") == run))
            paths = [r["path"] for r in held.where(touched).join(ids, "policy_id", "left_semi").select("path").distinct().collect()]
        if not paths:
            return
        rows = self.spark.read.parquet(*paths).select("policy_id", F.coalesce("text", F.lit("")).alias("text"))
        # the first run moves every policy
        rows = rows.where(touched).join(ids, "policy_id", "left_semi") if run > 1 else rows.where(F.col("policy_id").isNotNull())
        found, chunks = moved.agg(F.count(F.lit(1)).alias("policies"), F.max("n").alias("most")).first(), Observation()
        placed = ordinal_within(rows, ["policy_id"], ["text"], name="pos", group_bound=found["most"] or 0)
        # ids are unique, so a row's vector is made where the row is
        vectors = placed.select(F.concat_ws("-", "policy_id", "pos").alias("id"), "policy_id", F.sha2("text", 256).alias("text_sha"),
                                encoder(self.spark, "text", self.model).alias("embedding"))
        write_epoch(vectors.observe(chunks, F.count(F.lit(1)).alias("chunks")), f"{self.root}/vectors", run)
        counts["policies_reembedded"], counts["chunks_embedded"] = found["policies"], chunks.get["chunks"]


# ---- orders and their lines as policies that arrive over time --------------------------------------------------
# days before the last arrival at which the first run looks
LAST_DAYS = 90


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint").cast("string")


def arrivals(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """``policy_id, at, text``: an order's header arrives on its order date, each of its lines on its ship date."""
    head = orders.select(F.col("o_orderkey").alias("policy_id"), F.col("o_orderdate").alias("at"), F.concat_ws(
        "|", F.lit("h"), F.col("o_custkey").cast("string"), "o_orderstatus", _cents("o_totalprice"), "o_orderpriority").alias("text"))
    line = lineitem.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_orderkey").alias("policy_id"), F.col("l_shipdate").alias("at"), F.concat_ws(
            "|", F.lit("l"), F.col("l_linenumber").cast("string"), "p_name", F.col("l_suppkey").cast("string"), _cents("l_quantity"),
            _cents("l_extendedprice"), "l_returnflag", "l_linestatus").alias("text"))
    return head.unionByName(line)


def last_arrival(orders: DataFrame, lineitem: DataFrame):
    """The latest ``at`` of :func:`arrivals`; no part is looked up for it."""
    return orders.select(F.col("o_orderdate").alias("at")).unionByName(lineitem.select(F.col("l_shipdate").alias("at"))).agg(F.max("at")).first()[0]


def land(rows: DataFrame, path: str, *, until=None, since=None) -> None:
    """Write the months of ``rows`` from ``since`` on, as far as they have arrived by ``until``; other months stay untouched."""
    month = F.date_format("at", "yyyy-MM")
    if until is not None:
        rows = rows.where(F.col("at") <= F.lit(until))
    if since is not None:
        rows = rows.where(month >= F.date_format(F.lit(since), "yyyy-MM"))
    # a month goes into as many files as its size asks for
    rows.select("policy_id", "text", month.alias("month")).hint("rebalance", "month").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(path)
    free_shuffles(rows.sparkSession)
