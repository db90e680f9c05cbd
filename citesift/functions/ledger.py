"""A ledger of paid calls (UDF-2, UDF-3): a provider is asked for each different prompt once, whatever fails meanwhile.

Prompts are known by their SHA-256.  Those that the ledger holds are not sent.  The others are dealt by hash into as many
buckets as calls may be in flight; a bucket is one task, and a task writes every answer into its bucket's folder before it
asks for the next.  A task that is lost is run again by Spark, and the new attempt first reads what its bucket already
holds, so nothing is paid for twice.  When all buckets are done their answers become one more part of the ledger.

The folder must be one that all executors share and that ``pyarrow`` can open (``file:``, ``hdfs:``, ``s3:``, ``gs:``).  Two
attempts of one task that run at the same time may both pay, so speculation should be off while paid calls run.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.functions.models import DEFAULT_MAX_TOKENS, PROVIDERS, call_with_retry, get_provider
from citesift.operators.attempts import FAILURE_TRANSIENT, LLM_BACKOFF_BASE_S, LLM_MAX_ATTEMPTS
from citesift.session import cut_lineage, ship_package
from citesift.sinks.snapshot import commit_epoch, committed_epochs

# calls in flight at once
IN_FLIGHT = 64
ANSWER = "prompt_sha string, completion string, attempts int, failure_type string"


def _uri(path: str) -> str:
    return path if ":" in path.split("/", 1)[0] else f"file://{path}"


def _written(system: fs.FileSystem, folder: str) -> dict[str, dict]:
    """What the attempts before this one have paid for in a bucket."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out = {}
    for info in found:
        if info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                answer = json.loads(f.read())
            out[answer["prompt_sha"]] = answer
    return out


def _call(folder: str, make: Callable, max_tokens: int, max_attempts: int, backoff_s: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, known, ready = None, {}, set()
        system, root = fs.FileSystem.from_uri(folder)
        for rows in batches:
            out = []
            for bucket, sha, prompt in zip(rows["bucket"], rows["prompt_sha"], rows["prompt"]):
                place = f"{root}/bucket={bucket}"
                if bucket not in ready:
                    system.create_dir(place, recursive=True)
                    known |= _written(system, place)
                    ready.add(bucket)
                if sha not in known:
                    provider = provider or make()
                    text, n, failure = call_with_retry(provider, prompt, max_tokens=max_tokens, max_attempts=max_attempts, backoff_s=backoff_s)
                    known[sha] = {"prompt_sha": sha, "completion": text, "attempts": n, "failure_type": failure}
                    # written under another name first: a reader never sees half an answer
                    part = f"{place}/{uuid.uuid4().hex}"
                    with system.open_output_stream(f"{part}.part") as f:
                        f.write(json.dumps(known[sha]).encode("utf-8"))
                    system.move(f"{part}.part", f"{part}.json")
                out.append(known.pop(sha))
            yield pd.DataFrame(out, columns=["prompt_sha", "completion", "attempts", "failure_type"])

    return run


class Ledger:
    """Answers by prompt under ``root``; :meth:`complete` pays only for prompts that are not there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def answers(self) -> DataFrame:
        """``prompt_sha, completion, attempts, failure_type`` of every prompt paid for; one sent again has its last answer."""
        parts = [f"{self.root}/answers/part={n}" for n in committed_epochs(self.spark, self.root)]
        if not parts:
            return self.spark.createDataFrame([], ANSWER)
        log = self.spark.read.option("basePath", f"{self.root}/answers").schema(ANSWER + ", part int").parquet(*parts)
        last = log.groupBy("prompt_sha").agg(F.max_by(F.struct("completion", "attempts", "failure_type"), "part").alias("a"))
        return last.select("prompt_sha", "a.*")

    def complete(self, df: DataFrame, prompt_col: str, *, provider: str, out_col: str = "completion", in_flight: int = IN_FLIGHT,
                 retry_failed: bool = False, max_tokens: int = DEFAULT_MAX_TOKENS, max_attempts: int = LLM_MAX_ATTEMPTS,
                 backoff_s: float = LLM_BACKOFF_BASE_S) -> tuple[DataFrame, int]:
        """``df`` with ``out_col``, ``attempts`` and ``failure_type``, and how many prompts were sent.

        Equal prompts are one call.  A null prompt is not sent and gets nulls and 0 attempts.  A prompt whose call failed stays
        failed; with ``retry_failed`` those that failed for a transient reason are sent again.
        """
        get_provider(provider)  # an unknown name fails here
        ship_package(self.spark)
        wanted = df.where(F.col(prompt_col).isNotNull()).select(F.sha2(prompt_col, 256).alias("prompt_sha"), F.col(prompt_col).alias("prompt"))
        paid = self.answers()
        settled = paid.where(F.col("failure_type").isNull() | (F.col("failure_type") != FAILURE_TRANSIENT)) if retry_failed else paid
        n = max(committed_epochs(self.spark, self.root), default=0) + 1
        bucket = F.pmod(F.conv(F.substring("prompt_sha", 1, 8), 16, 10).cast("bigint"), F.lit(in_flight)).cast("int")
        todo = wanted.groupBy("prompt_sha").agg(F.first("prompt").alias("prompt")).join(settled.select("prompt_sha"), "prompt_sha", "left_anti")
        todo = cut_lineage(todo.withColumn("bucket", bucket))
        sent = todo.count()
        if sent:
            calls = _call(_uri(f"{self.root}/calls/part={n}"), PROVIDERS[provider], max_tokens, max_attempts, backoff_s)
            done = todo.repartition(in_flight, "bucket").mapInPandas(calls, ANSWER)
            done.write.mode("overwrite").parquet(f"{self.root}/answers/part={n}")
            commit_epoch(self.spark, self.root, n)
        latest = self.answers().toDF("_sha", out_col, "attempts", "failure_type")
        out = df.join(latest, F.sha2(prompt_col, 256) == F.col("_sha"), "left").select(
            *df.columns, out_col, F.coalesce("attempts", F.lit(0)).alias("attempts"), "failure_type")
        return out, sent


def prompt_sha(prompt: str) -> str:
    return hashlib.sha256(prompt.encode("utf-8")).hexdigest()
