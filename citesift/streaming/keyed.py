"""Budget gate with keyed state inside the stream (STR-1, STR-2).

Each user's spend is a value in Spark's state store (``transformWithState``), so a micro-batch reads and writes the state of
the users it brings and of nobody else.  Calls delivered more than once are dropped before the gate by their key.  State can
expire: ``ttl`` forgets a user that long after their last call, as one does when a run is over; it is off by default,
because a counter that forgets allows again.

Decisions go to two sinks, the calls that were let through and those that were refused (dead letters), one folder per
epoch, so a repeated micro-batch overwrites its own folders only.
"""

from __future__ import annotations

import heapq
from datetime import timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from citesift.operators.budget import COST_PER_CALL
from citesift.session import work_dir
from citesift.sinks.snapshot import write_epoch
from citesift.streaming.jobs import EVENTS_SCHEMA, table_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "user_id bigint, event_id bigint, seq int, tokens_spent bigint, within_budget boolean"


def budget_gate(budget: int, cost: int, ttl: timedelta | None) -> StatefulProcessor:
    """Calls of one user in (ts, event_id) order; the first refusal ends the user.

    The class is made here so that it travels by value: the process that prepares the state has no packages shipped to it.
    """
    ttl_ms = None if ttl is None else int(ttl.total_seconds() * 1000)

    class BudgetGate(StatefulProcessor):
        def init(self, handle) -> None:
            self.spend = handle.getValueState("spend", "spent bigint, calls bigint, refused boolean", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            spent, calls, refused = self.spend.get() if self.spend.exists() else (0, 0, False)
            # no more calls can matter than the budget pays for, and one that is refused
            most = 0 if refused else max(0, (budget - spent) // cost) + 1
            first: list[tuple] = []
            for part in rows:
                first = heapq.nsmallest(most, first + list(zip(part["ts"], part["event_id"]))) if most else []
            out = []
            for _, event in first:
                spent, calls = spent + cost, calls + 1
                refused = spent > budget
                out.append((key[0], event, calls, spent, not refused))
            if out:
                self.spend.update((int(spent), int(calls), bool(refused)))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "seq", "tokens_spent", "within_budget"])

        def close(self) -> None:
            pass

    return BudgetGate()


def stream_gate_keyed(spark: SparkSession, sf_dir: str, *, budget: int, cost: int = COST_PER_CALL, root: str | None = None,
                      ttl: timedelta | None = None, files_per_trigger: int = 1) -> tuple[DataFrame, DataFrame]:
    """The calls let through and the calls refused, over all that has arrived; ``root`` keeps progress, state and both tables.

    Called again with the same ``root`` it goes on with the files that came since.  Within a micro-batch calls are taken in
    (ts, event_id) order; over micro-batches in the order they arrive, so a late call is gated after those before it.  With a
    ``ttl`` each call of this function is one micro-batch.
    """
    root = root or work_dir(spark, "stream-gate-keyed")
    calls = table_stream(spark, sf_dir, "events", EVENTS_SCHEMA, files_per_trigger).select("user_id", "event_id", "ts")
    once = calls.where(F.col("user_id").isNotNull()).dropDuplicates(["user_id", "event_id"])
    decided = once.groupBy("user_id").transformWithStateInPandas(
        budget_gate(budget, cost, ttl), DECISIONS, "append", "processingTime" if ttl is not None else "none")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        write_epoch(batch.where("within_budget"), f"{root}/allowed", epoch)
        write_epoch(batch.where("not within_budget"), f"{root}/refused", epoch)
        batch.unpersist()

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        # with processing time a stateful query always has one more batch to run: then all that has come is one micro-batch
        until = {"availableNow": True} if ttl is None else {"once": True}
        q = decided.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(**until).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return tuple(spark.read.schema(f"{DECISIONS}, epoch int").parquet(f"{root}/{t}").drop("epoch") for t in ("allowed", "refused"))


def decisions(tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Both sinks as one table."""
    return reduce(DataFrame.unionByName, tables)
