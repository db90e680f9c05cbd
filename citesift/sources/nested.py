"""Nested policy documents as JSON Lines (SRC-1) and plain-text documents (SRC-2)."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.plans.corpus import POLICY_T
from citesift.session import ship_package

# file names handed to a reading task at once, and bytes of text it holds before it passes them on
NAMES, READ_BYTES = 256, 4 << 20


def write_policies_json(policies: DataFrame, path: str) -> None:
    """One JSON object per line, so the scan splits across files and tasks (no multi-line arrays)."""
    policies.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_policies_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Scan with an explicit schema: no inference pass, and key order in the files does not matter."""
    return spark.read.schema(POLICY_T).option("multiLine", str(multiline).lower()).json(path)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The name under which every process sees the folder ``path``; None where only Hadoop's file systems reach it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_text_documents(texts: DataFrame, path: str) -> None:
    """One ``.txt`` file per row of ``texts`` (one column), ended by a newline; a folder that is there is replaced.

    Hadoop's local file system starts processes for every file it makes, to set its mode and that of a checksum file.  So
    tasks write local folders themselves: each fills a hidden folder and names it ``task=<n>`` when it is whole.
    """
    spark = texts.sparkSession
    folder = _local_folder(spark, path)
    if folder is None:
        # so many files are moved into place by the tasks that wrote them, not one by one by the driver
        (texts.write.mode("overwrite").option("maxRecordsPerFile", 1)
         .option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path))
        return
    shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(folder)
    ship_package(spark)
    texts.mapInArrow(lambda batches: _write_task(batches, folder, TaskContext.get().partitionId()), "files bigint").agg(F.sum("files")).first()


def _write_task(batches: Iterator[pa.RecordBatch], folder: str, task: int) -> Iterator[pa.RecordBatch]:
    filled, n = f"{folder}/.{uuid.uuid4().hex}", 0
    os.makedirs(filled)
    try:
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                with open(f"{filled}/{n:09d}.txt", "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                n += 1
        if n:
            try:
                os.rename(filled, f"{folder}/task={task:05d}")
            except OSError:
                # an earlier attempt of this task wrote the same files
                if not os.path.isdir(f"{folder}/task={task:05d}"):
                    raise
    finally:
        shutil.rmtree(filled, ignore_errors=True)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])


def read_text_documents(spark: SparkSession, path: str, glob: str = "*.txt", *, recursive: bool = False) -> DataFrame:
    """SRC-2: one row per file (whole text) with its file name; a folder without any is an error.

    Files of the folders below are read too if ``recursive``.  A local folder is listed and read in the tasks, so the driver
    holds no list of files and a task reads many; elsewhere Spark's scan does both.
    """
    folder = _local_folder(spark, path)
    if folder is not None and os.path.isdir(folder) and not set(glob) & set("{}[]\\"):
        names = _names(spark, folder, glob, recursive)
        # the names, not the texts, are dealt over the cluster
        dealt = names.repartition(4 * spark.sparkContext.defaultParallelism)
        df = dealt.mapInArrow(_read_files, "file_name string, text binary").withColumn("text", F.col("text").cast("string"))
    else:
        df = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
              .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")))
        names = df.select("file_name")
    # asks one task first; isEmpty would ask all
    if not names.head(1):
        raise FileNotFoundError(f"no {glob} documents under {path}")
    return df


def _names(spark: SparkSession, folder: str, glob: str, recursive: bool) -> DataFrame:
    """``folder, names``: the files of a local folder, some at a time, listed by a task for each folder right below it."""
    below = [e.path for e in os.scandir(folder) if e.is_dir() and not e.name.startswith((".", "_"))] if recursive else []
    ship_package(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, names in _walk(root, glob, deep):
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([names], pa.list_(pa.string()))], ["folder", "names"])

    roots = spark.createDataFrame([(folder, False), *[(b, True) for b in sorted(below)]], "root string, deep boolean")
    return roots.mapInArrow(listed, "folder string, names array<string>")


def _walk(root: str, glob: str, deep: bool) -> Iterator[tuple[str, list[str]]]:
    """``NAMES`` files at a time; names that start with ``.`` or ``_`` are hidden, as in Spark's own scans."""
    names, below = [], []
    with os.scandir(root) as entries:
        for e in entries:
            if e.name.startswith((".", "_")):
                continue
            if e.is_dir():
                below.append(e.path)
            elif fnmatchcase(e.name, glob):
                names.append(e.name)
                if len(names) == NAMES:
                    yield root, names
                    names = []
    if names:
        yield root, names
    if deep:
        for b in below:
            yield from _walk(b, glob, deep)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(names, texts):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["file_name", "text"])

    for batch in batches:
        for folder, files in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            names, texts, size = [], [], 0
            for name in files:
                with open(f"{folder}/{name}", "rb") as f:
                    texts.append(f.read())
                names.append(name)
                size += len(texts[-1])
                if size >= READ_BYTES:
                    yield rows(names, texts)
                    names, texts, size = [], [], 0
            if names:
                yield rows(names, texts)
