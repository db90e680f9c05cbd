"""Written intermediate tables in the cluster's shared folder, and scans of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from citesift.session import ensure_checkpoint_dir, ship_package
from citesift.sources.tables import table_path


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Tables:
    """Parquet tables under the shared checkpoint folder that cut lineage between the steps of one job.

    A written table survives the loss of any executor.  :meth:`drop` removes a table as soon as no later
    step reads it, so the folder holds only what is still needed.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        ship_package(spark)
        base = ensure_checkpoint_dir(spark).rstrip("/")
        self.base = f"{base}/{job}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)
