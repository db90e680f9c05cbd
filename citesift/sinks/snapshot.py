"""Snapshot tables without a table format (SNK-2/3/4/5, H6).

A table lives in ``<root>/snapshot=<n>/`` folders; the live one is the highest ``n`` with a marker file
``<root>/_commits/<n>``.  A writer fills a new folder and only then adds its marker, so a failed or retried job
leaves the previous snapshot live and intact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.operators.keyfilter import may_hold
from citesift.session import cut_lineage


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    fs, path, _ = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [str(x.getPath().getName()) for x in fs.listStatus(path)]
    return [int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()]


def current_snapshot(spark: SparkSession, root: str) -> int | None:
    """The latest committed snapshot; folders without a commit marker are unfinished and never read."""
    return max(_numbers(spark, f"{root}/_commits", ""), default=None)


def _commit(spark: SparkSession, root: str, n: int) -> None:
    """Markers are only ever added: there is no moment without a live snapshot, and creating one is atomic."""
    fs, path, _ = _fs(spark, f"{root}/_commits/{n}")
    fs.create(path, False).close()


def read_snapshot(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The live snapshot, or None when the table was never written (a missing table is empty)."""
    n = current_snapshot(spark, root)
    if n is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/snapshot={n}")


def write_snapshot(df: DataFrame, root: str, *, partition_by: list[str] | None = None,
                   single_file: bool = False) -> int:
    """Write ``df`` as the next snapshot and commit it; returns the snapshot number.

    ``single_file`` mirrors the reference archive's one-file output; it funnels the write through one
    task, so it is off by default.
    """
    spark = df.sparkSession
    # past every folder that exists, so that nothing written before is overwritten, committed or not
    n = max([0, *_numbers(spark, root, "snapshot="), *_numbers(spark, f"{root}/_commits", "")]) + 1
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{root}/snapshot={n}")
    _commit(spark, root, n)
    return n


def upsert(existing: DataFrame | None, updates: DataFrame, key: list[str], *, materialize: bool = True) -> DataFrame:
    """SNK-3 / SNK-5: last write wins by key: rows of ``existing`` whose key is updated are replaced.

    Nothing is ever deleted (Q8).  An anti join plus a union: both sides shuffle on the key once, and AQE
    splits a skewed key of the anti join.  ``updates`` is read twice (its keys and its rows), so by default
    it is first written once as a reliable checkpoint: whatever produced it (a diff, new embeddings) runs
    once, not once per use.
    """
    if existing is None:
        return updates
    if materialize:
        updates = cut_lineage(updates)
    return existing.join(updates.select(*key), key, "left_anti").unionByName(updates)


# ---- epoch logs (stream sinks) ---------------------------------------------------------------------------
def write_epoch(df: DataFrame, root: str, epoch: int) -> None:
    """Write one micro-batch's rows as ``<root>/epoch=<n>``.

    Only the batch's own rows are written (never the accumulated table), and a replayed epoch overwrites
    its own folder and nothing else, so the log is exactly-once under retries.  Digests in hex halve under zstd.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/epoch={epoch}")


def _folded(spark: SparkSession, root: str, before: int | None) -> int | None:
    """The newest fold of a log that holds no epoch from ``before`` on."""
    done = _numbers(spark, f"{root}.folds/_commits", "")
    return max((n for n in done if before is None or n < before), default=None)


def read_latest(spark: SparkSession, root: str, key: list[str], *, before: int | None = None, unique: bool = False,
                within: list[str] | None = None) -> DataFrame | None:
    """The current table of an epoch log: per key, the row of the latest epoch (None if never written).

    ``before`` reads the table as it was before that epoch, so a replayed micro-batch sees the same state as its first
    attempt did.  Epochs that a fold holds are read from the fold.  ``max_by`` is partially aggregated, so a key
    written in many epochs sends one row per partition.

    ``unique`` says that no epoch holds a key twice: the oldest rows, usually nearly all, are then not grouped but only
    held against the keys of the epochs after them, and columns that are not asked for are not read.  ``within`` names
    columns that follow from the key and have fewer values, such as the document of a clause.
    """
    fold = _folded(spark, root, before)
    epochs = sorted(n for n in _numbers(spark, root, "epoch=") if (before is None or n < before) and (fold is None or n > fold))
    if unique and (epochs or fold is not None):
        oldest = f"{root}.folds/upto={fold}" if fold is not None else f"{root}/epoch={epochs.pop(0)}"
        return _overlaid(spark.read.parquet(oldest), [spark.read.parquet(f"{root}/epoch={n}") for n in epochs], key, within or key)
    parts = []
    if epochs:
        parts.append(spark.read.option("basePath", root).parquet(*[f"{root}/epoch={n}" for n in epochs]).withColumn("epoch", F.col("epoch").cast("bigint")))
    if fold is not None:
        parts.append(spark.read.parquet(f"{root}.folds/upto={fold}").withColumn("epoch", F.lit(fold).cast("bigint")))
    if not parts:
        return None if before is None else _nothing_before(spark, root)
    log = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    cols = [c for c in log.columns if c not in key and c != "epoch"]
    latest = log.groupBy(*key).agg(F.max_by(F.struct(*cols), "epoch").alias("_v"))
    return latest.select(*key, *[F.col(f"_v.{c}").alias(c) for c in cols])


def _overlaid(oldest: DataFrame, later: list[DataFrame], key: list[str], within: list[str]) -> DataFrame:
    """``oldest`` with the rows of ``later`` (in order of time) put over those of equal key; no table holds a key twice.

    Only rows whose ``within`` may be among those of later rows are shuffled to be held against them; the others stay.
    """
    if not later:
        return oldest
    cols = [c for c in oldest.columns if c not in key]
    news = later[0].select(*key, *cols)
    if len(later) > 1:
        log = reduce(DataFrame.unionByName, [t.withColumn("epoch", F.lit(i)) for i, t in enumerate(later)])
        news = log.groupBy(*key).agg(F.max_by(F.struct(*cols), "epoch").alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in cols])
    keys = reduce(DataFrame.unionByName, [t.select(*key) for t in later])
    touched, oldest = may_hold(reduce(DataFrame.unionByName, [t.select(*within) for t in later]), within), oldest.select(*key, *cols)
    return oldest.where(~touched).unionByName(oldest.where(touched).join(keys, key, "left_anti")).unionByName(news)


def _nothing_before(spark: SparkSession, root: str) -> DataFrame | None:
    """An empty table with the log's columns if the log has later epochs, else None."""
    later = _numbers(spark, root, "epoch=")
    return spark.read.parquet(f"{root}/epoch={min(later)}").limit(0) if later else None


def fold_log(spark: SparkSession, root: str, key: list[str], *, keep: int = 1) -> int | None:
    """Fold all epochs of a log but the newest ``keep`` into one table, so reading costs the same however old the log is.

    The fold is written beside the log and counts once its marker is there; readers go on meanwhile.  The newest ``keep``
    epochs stay as they are, so the last ones can be replayed.  Folders of epochs that the fold before this one holds are
    deleted: nobody who started after that fold reads them.  Returns the last epoch folded, None if there was none.
    """
    epochs = sorted(_numbers(spark, root, "epoch="))[:-keep] if keep else sorted(_numbers(spark, root, "epoch="))
    last = _folded(spark, root, None)
    if not epochs or (last is not None and epochs[-1] <= last):
        return last
    upto = epochs[-1]
    table = read_latest(spark, root, key, before=upto + 1)
    table.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}.folds/upto={upto}")
    _commit(spark, f"{root}.folds", upto)
    if last is not None:
        fs, _, jvm = _fs(spark, root)
        for n in epochs:
            if n <= last:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/epoch={n}"), True)
    return upto


def commit_epoch(spark: SparkSession, root: str, epoch: int) -> None:
    """Mark the folders of ``epoch`` as complete; readers that ask for committed epochs see them from now on."""
    if epoch not in committed_epochs(spark, root):
        _commit(spark, root, epoch)


def committed_epochs(spark: SparkSession, root: str) -> list[int]:
    return sorted(_numbers(spark, f"{root}/_commits", ""))
