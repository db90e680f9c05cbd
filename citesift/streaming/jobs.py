"""Structured Streaming variants (STR-1..4).

All four read files with ``readStream`` and keep their results through ``foreachBatch``, so nothing is
collected on the driver.  Progress and results live in a folder that the caller names (``root``); called again
with it, a query goes on where it stopped.  Results that are a keyed
table (counter, claim outcomes, manifest, vectors) go to an epoch log: each micro-batch writes only its own rows to its
epoch's folder, and the table is the latest row per key; nothing accumulated is rewritten per batch, and every
``FOLD_EVERY`` batches old epochs are folded into one table.  Run with ``trigger(availableNow=True)`` the final tables equal the batch
jobs over the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.functions.models import embed
from citesift.operators.budget import COST_PER_CALL, sequential_gate
from citesift.plans import agentic
from citesift.plans import claims as cl
from citesift.plans import corpus as cp
from citesift.session import cut_lineage, work_dir
from citesift.sinks.snapshot import fold_log, read_latest, write_epoch

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
                 "props string")
EMB_SCHEMA = "vec_id bigint, embedding array<float>, label int"
DOCS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# micro-batches after which a log is folded, so that reading it does not grow with its age
FOLD_EVERY = 16


def _fold(spark: SparkSession, root: str, key: list[str], epoch: int) -> None:
    if epoch % FOLD_EVERY == FOLD_EVERY - 1:
        fold_log(spark, root, key)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over one table inside ``sf_dir``: ``<name>.parquet`` and any later ``<name>-*.parquet``, each a
    file or a folder of files, taken in arrival order."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(_arrived(sf_dir, name)))


def _arrived(sf_dir: str, name: str) -> str:
    """The table's files and folders as one path: a filter on names would miss the files inside a folder."""
    return f"{sf_dir.rstrip('/')}/{name}{{,-*}}.parquet"


def _run(df: DataFrame, fn, root: str, mode: str = "append") -> None:
    """Run to the end of what has arrived; progress is kept in ``<root>/checkpoint``."""
    q = (df.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ---- STR-1 ---------------------------------------------------------------------------------------------
def stream_spend_counter(spark: SparkSession, sf_dir: str, *, root: str | None = None, deliveries=None) -> DataFrame:
    """Keyed spend counter fed by gate calls.

    A call counts once however often and however late it is delivered: the keys seen are kept without expiry,
    so nothing arrives too late to count (the state grows with the number of distinct calls).  ``deliveries``
    may map the arriving calls to those delivered.  The sink is an epoch log: a micro-batch writes only the
    totals it changed.  ``root`` holds progress and totals; called again with the same ``root``, the stream
    goes on with the files that arrived since.
    """
    root = root or work_dir(spark, "stream-counter")
    calls = table_stream(spark, sf_dir, "events", EVENTS_SCHEMA).select("user_id", "event_id", "event_type")
    once = (deliveries(calls) if deliveries else calls).dropDuplicates(["user_id", "event_id"])
    counts = once.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"),
                                         F.sum(F.lit(COST_PER_CALL)).cast("bigint").alias("tokens_spent"))

    def sink(batch: DataFrame, epoch: int) -> None:
        # update mode: each batch carries the new totals of only the keys it touched; they are appended as
        # this epoch's folder, and readers take each key's latest total
        write_epoch(batch, f"{root}/totals", epoch)
        _fold(spark, f"{root}/totals", ["user_id"], epoch)

    _run(counts, sink, root, "update")
    return read_latest(spark, f"{root}/totals", ["user_id"])


# ---- STR-2 ---------------------------------------------------------------------------------------------
def stream_gate(spark: SparkSession, sf_dir: str, *, budget: int, root: str | None = None) -> DataFrame:
    """Gate decisions per micro-batch against the running counter: calls are ordered by (ts, event_id) inside
    the batch and continue the spend of earlier batches; a refused user stays refused.  Allowed and refused
    calls land in one decisions table (the refused ones are the dead-letter side output)."""
    root = root or work_dir(spark, "stream-gate")
    ev = table_stream(spark, sf_dir, "events", EVENTS_SCHEMA).select("user_id", "event_id", "ts")
    state_root, out_root = f"{root}/state", f"{root}/decisions"

    def per_batch(batch: DataFrame, epoch: int) -> None:
        # the state as it stood before this epoch, so a replayed batch decides exactly as its first attempt
        state = read_latest(spark, state_root, ["user_id"], before=epoch)
        if state is None:
            state = spark.createDataFrame([], "user_id bigint, spent bigint, calls bigint, refused boolean")
        live = batch.join(state.where(F.col("refused")).select("user_id"), "user_id", "left_anti")
        prior = live.join(state.select("user_id", "spent", "calls"), "user_id", "left")
        gated = sequential_gate(prior, ["user_id"], ["ts", "event_id"], budget=budget,
                                prior=F.coalesce(F.col("spent"), F.lit(0)))
        decided = gated.select("user_id", "event_id",
                               (F.col("seq") + F.coalesce(F.col("calls"), F.lit(0))).cast("int").alias("seq"),
                               "tokens_spent", "within_budget")
        # one folder per epoch: a replayed micro-batch overwrites its own folder, nothing else
        write_epoch(decided, out_root, epoch)
        decided = spark.read.parquet(f"{out_root}/epoch={epoch}")
        new_state = (decided.groupBy("user_id")
                     .agg(F.max("tokens_spent").alias("spent"), F.max("seq").cast("bigint").alias("calls"),
                          F.max(~F.col("within_budget")).alias("refused")))
        # only the users this batch touched; a refused user never reappears, so their last row stays refused
        write_epoch(new_state, state_root, epoch)
        _fold(spark, state_root, ["user_id"], epoch)

    _run(ev, per_batch, root)
    return spark.read.parquet(out_root).drop("epoch")


def _known(spark: SparkSession, log: str, batch: DataFrame, key: list[str], unit: str, epoch: int) -> DataFrame:
    """All rows known of the units that ``batch`` touches: those of earlier epochs, replaced by the batch's own.

    The batch's rows are added to the log first, so a unit whose rows arrive in several files is complete as
    soon as its last row is there.
    """
    write_epoch(batch, log, epoch)
    _fold(spark, log, key, epoch)
    batch = spark.read.parquet(f"{log}/epoch={epoch}")
    before = read_latest(spark, log, key, before=epoch)
    if before is None:
        return batch
    touched = batch.select(unit).distinct()
    older = before.join(touched, unit, "left_semi").join(batch.select(*key), key, "left_anti")
    return older.select(*batch.columns).unionByName(batch)


# ---- STR-3 ---------------------------------------------------------------------------------------------
def stream_claim_intake(spark: SparkSession, sf_dir: str, knn, *, root: str | None = None) -> DataFrame:
    """Claims (their search vectors) go through the loop as they arrive; a claim whose vectors come in several
    files is run again over all of them.  Outcomes are an epoch log read as the latest row per claim, so a
    replayed micro-batch does not duplicate an answer."""
    root = root or work_dir(spark, "stream-intake")
    corpus = cl.corpus_vectors(spark.read.schema(EMB_SCHEMA).parquet(_arrived(sf_dir, "embeddings")))
    emb = table_stream(spark, sf_dir, "embeddings", EMB_SCHEMA)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        searches = batch.where(F.col("vec_id") % cl.CLAIM_STRIDE < cl.QUERIES_PER_CLAIM).withColumn(
            "claim_id", F.col("vec_id") - F.col("vec_id") % cl.CLAIM_STRIDE)
        known = _known(spark, f"{root}/searches", searches, ["vec_id"], "claim_id", epoch)
        q = cl.query_vectors(known)
        hits = knn(q, corpus)
        outcomes, _, _ = agentic.run_loop(q.select("claim_id", "iteration"), hits, cl.claims(known))
        write_epoch(outcomes, f"{root}/outcomes", epoch)
        _fold(spark, f"{root}/outcomes", ["claim_id"], epoch)

    _run(emb, per_batch, root)
    return read_latest(spark, f"{root}/outcomes", ["claim_id"])


# ---- STR-4 ---------------------------------------------------------------------------------------------
def stream_reindex(spark: SparkSession, sf_dir: str, *, root: str | None = None, model: str = "hashed") -> tuple[DataFrame, DataFrame]:
    """Incremental indexing as documents arrive: merge a policy's clauses with those stored, digest it, compare
    with the manifest, embed only the chunks of new or changed policies, then record the digests.

    Returns the manifest (``policy_id, digest``) and the vector table (``id, policy_id, text_sha, embedding``).
    """
    root = root or work_dir(spark, "stream-reindex")
    docs = table_stream(spark, sf_dir, "documents", DOCS_SCHEMA)
    vec_root, man_root = f"{root}/vectors", f"{root}/manifest"

    def per_batch(batch: DataFrame, epoch: int) -> None:
        clauses = _known(spark, f"{root}/clauses", cp.document_clauses(batch), ["clause_id"], "policy_id", epoch)
        policies = cp.nest_policies(clauses)
        digests = cp.policy_digest(policies)
        manifest = read_latest(spark, man_root, ["policy_id"], before=epoch)
        if manifest is not None:
            # only this batch's policies are looked up in the manifest
            manifest = manifest.join(digests.select("policy_id"), "policy_id", "left_semi")
        diff = cp.manifest_diff(digests, manifest)
        todo = diff.where(F.col("status").isin("new", "changed")).select("policy_id")
        chunks = cp.chunk_by_clause(policies.join(todo, "policy_id", "left_semi"))
        rows = chunks.select("id", F.col("metadata.policy_id").alias("policy_id"), F.sha2("text", 256).alias("text_sha"), "text")
        # the chunks are read for their keys and for the model: written once, so the diff runs once
        rows = cut_lineage(rows)
        vectors = embed(rows, "id", "text", model=model)
        # vectors first, manifest after (a crash between the two only re-embeds, never skips)
        write_epoch(rows.drop("text").join(vectors, "id", "left"), vec_root, epoch)
        write_epoch(digests, man_root, epoch)
        _fold(spark, vec_root, ["id"], epoch)
        _fold(spark, man_root, ["policy_id"], epoch)

    _run(docs, per_batch, root)
    return read_latest(spark, man_root, ["policy_id"]), read_latest(spark, vec_root, ["id"])
