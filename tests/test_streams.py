"""Streams over several micro-batches equal the batch jobs (epoch-log sinks, state carried across epochs)."""

import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from citesift.operators.budget import sequential_gate, spend_counter
from citesift.streaming import jobs
from tests.conftest import SF_SMALL

BUDGET = 1500  # five calls per user, so users are refused in the middle of the stream


def _split_events(tmp_path, parts=3):
    t = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    step = -(-t.num_rows // parts)
    for i in range(parts):
        path = tmp_path / f"events-{i}.parquet"
        pq.write_table(t.slice(i * step, step), path)
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))  # arrival order = time order
    return str(tmp_path)


def test_gate_stream_over_batches_equals_batch_gate(spark, tmp_path):
    d = _split_events(tmp_path)
    got = jobs.stream_gate(spark, d, budget=BUDGET).select("user_id", "event_id", "seq", "tokens_spent",
                                                             "within_budget")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", "event_id", "ts")
    want = sequential_gate(ev, ["user_id"], ["ts", "event_id"], budget=BUDGET).select(
        "user_id", "event_id", F.col("seq").cast("int").alias("seq"), "tokens_spent", "within_budget")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.where(~F.col("within_budget")).count() > 0


def test_counter_stream_over_batches_equals_batch_counter(spark, tmp_path):
    d = _split_events(tmp_path)
    got = jobs.stream_spend_counter(spark, d).select("user_id", "calls", "tokens_spent")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    want = spend_counter(ev, ["user_id"], "event_id").select("user_id", "calls", "tokens_spent")
    assert sorted(got.collect()) == sorted(want.collect())


def test_reindex_stream_reembeds_only_changed_policies(spark, tmp_path, monkeypatch):
    from citesift.plans import corpus as cp

    t = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pandas().sort_values("doc_id")
    pol = t["doc_id"] // 20
    first, second = t[pol < 3], t[pol >= 3]
    # third delivery: policy 0 unchanged, policy 1 with one clause edited
    again = t[pol < 2].copy()
    edited_id = again["doc_id"].iloc[25]
    again.loc[again["doc_id"] == edited_id, "text"] = again.loc[again["doc_id"] == edited_id, "text"] + " (amended)"
    for i, part in enumerate((first, second, again)):
        path = tmp_path / f"documents-{i}.parquet"
        part.to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))

    written = []
    real = jobs.write_epoch

    def spy(df, root, epoch):
        real(df, root, epoch)
        if root.endswith("/vectors"):
            ids = spark.read.parquet(f"{root}/epoch={epoch}").select("policy_id").distinct().collect()
            written.append((epoch, sorted(r["policy_id"] for r in ids)))

    monkeypatch.setattr(jobs, "write_epoch", spy)
    manifest, vectors = jobs.stream_reindex(spark, str(tmp_path))
    assert written[-1] == (2, ["POL-001"])  # only the edited policy is re-chunked in the last batch

    current = t.set_index("doc_id")
    current.loc[edited_id, "text"] = again.set_index("doc_id").loc[edited_id, "text"]
    docs = spark.createDataFrame(current.reset_index())
    want = {r["policy_id"]: r["digest"]
            for r in cp.policy_digest(cp.nest_policies(cp.document_clauses(docs))).collect()}
    assert {r["policy_id"]: r["digest"] for r in manifest.collect()} == want
    assert vectors.count() == len(t)


def test_epoch_log_replay_reads_state_before_itself(spark, tmp_path):
    from citesift.sinks.snapshot import read_latest, write_epoch

    root = str(tmp_path / "log")
    assert read_latest(spark, root, ["k"]) is None
    write_epoch(spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), root, 0)
    write_epoch(spark.createDataFrame([(1, 11)], "k int, v int"), root, 1)
    # epoch 1 replayed after a partial first attempt: it must see the table as of epoch 0, not its own rows
    assert sorted(read_latest(spark, root, ["k"], before=1).collect()) == [(1, 10), (2, 20)]
    write_epoch(spark.createDataFrame([(1, 12)], "k int, v int"), root, 1)  # the replay overwrites only epoch 1
    assert sorted(read_latest(spark, root, ["k"]).collect()) == [(1, 12), (2, 20)]


def _deliver(table, folder, name, order):
    """Write the slices of a table as files that arrive in the given order."""
    for at, part in enumerate(order):
        path = folder / f"{name}-{len(list(folder.glob('*.parquet')))}.parquet"
        pq.write_table(part, path)
        os.utime(path, (1_700_000_000 + at * 10, 1_700_000_000 + at * 10))


def test_counter_counts_late_and_repeated_calls_and_resumes(spark, tmp_path):
    t = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    step = -(-t.num_rows // 4)
    parts = [t.slice(i * step, step) for i in range(4)]
    source, root = tmp_path / "in", str(tmp_path / "root")
    source.mkdir()
    _deliver(t, source, "events", [parts[3], parts[2], parts[2]])  # newest first, one file twice
    jobs.stream_spend_counter(spark, str(source), root=root)
    _deliver(t, source, "events", [parts[0], parts[1]])
    got = jobs.stream_spend_counter(spark, str(source), root=root).select("user_id", "calls", "tokens_spent")
    want = spend_counter(spark.read.parquet(f"{SF_SMALL}/events.parquet"), ["user_id"], "event_id").select(
        "user_id", "calls", "tokens_spent")
    assert sorted(got.collect()) == sorted(want.collect())


def test_intake_joins_a_claim_split_over_files(spark, tmp_path):
    from citesift.operators.knn import knn_join
    from citesift.plans import agentic
    from citesift.plans import claims as cl

    t = pq.read_table(f"{SF_SMALL}/embeddings.parquet").sort_by("vec_id")
    cuts = [0, 1, 27, 252, t.num_rows]  # inside claims
    _deliver(t, tmp_path, "embeddings", [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:])][::-1])

    def knn(q, corpus):
        return knn_join(q, corpus, 5, query_keys=["claim_id", "iteration"], corpus_key="id")

    got = jobs.stream_claim_intake(spark, str(tmp_path), knn, root=str(tmp_path / "root"))
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = cl.query_vectors(emb)
    want, _, _ = agentic.run_loop(q.select("claim_id", "iteration"), knn(q, cl.corpus_vectors(emb)), cl.claims(emb))
    cols = ["claim_id", "status", "iterations", "tokens_spent", "citations"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_reindex_joins_a_policy_split_over_files_and_embeds(spark, tmp_path):
    from citesift.functions.models import embed
    from citesift.plans import corpus as cp

    t = pq.read_table(f"{SF_SMALL}/documents.parquet").sort_by("doc_id")
    source, root = tmp_path / "in", str(tmp_path / "root")
    source.mkdir()
    cuts = [0, 7, 33, t.num_rows]  # inside policies
    _deliver(t, source, "documents", [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:])][::-1])
    manifest, vectors = jobs.stream_reindex(spark, str(source), root=root)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    policies = cp.nest_policies(cp.document_clauses(docs))
    assert sorted(manifest.select("policy_id", "digest").collect()) == sorted(
        cp.policy_digest(policies).select("policy_id", "digest").collect())
    chunks = cp.chunk_by_clause(policies)
    want = {r["id"]: r["embedding"] for r in embed(chunks, "id", "text").collect()}
    got = {r["id"]: r["embedding"] for r in vectors.collect()}
    assert set(got) == {r["id"] for r in chunks.select("id").collect()}
    assert all(got[i] == want.get(i) for i in got)
    # nothing new: the next run embeds nothing and changes nothing
    before = vectors.count()
    jobs.stream_reindex(spark, str(source), root=root)
    assert spark.read.parquet(f"{root}/vectors").count() >= before
    assert sorted(os.listdir(f"{root}/vectors")) == sorted(f for f in os.listdir(f"{root}/vectors"))


def test_tables_that_are_folders_of_files_are_read_whole(spark, tmp_path):
    from citesift.catalog.streams import stream_claim_intake, stream_reindex

    for name, key in (("embeddings", "vec_id"), ("documents", "doc_id")):
        t = pq.read_table(f"{SF_SMALL}/{name}.parquet").sort_by(key)
        (tmp_path / f"{name}.parquet").mkdir()
        half = t.num_rows // 2
        for i, part in enumerate((t.slice(0, half), t.slice(half))):
            pq.write_table(part, tmp_path / f"{name}.parquet" / f"part-{i}.parquet")
    for q in (stream_claim_intake, stream_reindex):
        got, want = sorted(q(spark, str(tmp_path)).collect()), sorted(q(spark, SF_SMALL).collect())
        assert got and got == want
