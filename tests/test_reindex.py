import os

from pyspark.sql import functions as F

from citesift.plans import reindex as rx


def _land(spark, path, files):
    """Each file is ``name -> [(policy_id, text)]``; a name that is given again is replaced, None removes it."""
    for name, rows in files.items():
        for f in [x for x in os.listdir(path) if x.startswith(f"{name}.")]:
            os.remove(f"{path}/{f}")
        if rows is not None:
            import pyarrow as pa
            import pyarrow.parquet as pq

            pq.write_table(pa.table({"policy_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}),
                           f"{path}/{name}.{len(rows)}-{abs(hash(tuple(rows)))}.parquet")


def _expected(spark, files):
    rows = [(p, t or "") for r in files.values() if r for p, t in r]
    df = spark.createDataFrame([("x", p, t) for p, t in rows], "path string, policy_id bigint, text string")
    return {r.policy_id: (r.n, r.digest) for r in rx.part_sums(df).withColumn("digest", rx.digest_of_sums()).collect()}


def test_runs_follow_added_changed_and_removed_files(spark, tmp_path):
    path, files = tmp_path / "in", {}
    path.mkdir()
    index = rx.PolicyIndex(spark, str(tmp_path / "state"))

    def step(change):
        files.update(change)
        _land(spark, str(path), change)
        counts = index.run(str(path))
        assert {r.policy_id: (r.n, r.digest) for r in index.manifest().collect()} == _expected(spark, files)
        return counts

    c = step({"a": [(1, "red widget"), (2, "blue ring")], "b": [(1, "small bolt"), (3, None)]})
    assert c == {"files_read": 2, "rows_hashed": 4, "policies_checked": 3, "policies_reembedded": 3, "chunks_embedded": 4}
    assert step({}) == {"files_read": 0, "rows_hashed": 0, "policies_checked": 3, "policies_reembedded": 0, "chunks_embedded": 0}
    # one file changes: only the policies whose rows differ are embedded, from every file that holds them
    c = step({"b": [(1, "large bolt"), (3, None)]})
    assert c == {"files_read": 1, "rows_hashed": 2, "policies_checked": 3, "policies_reembedded": 1, "chunks_embedded": 2}
    # rows move between files: no sum moves, nothing is embedded
    c = step({"a": [(2, "blue ring")], "b": [(1, "red widget"), (1, "large bolt"), (3, None)]})
    assert (c["policies_reembedded"], c["chunks_embedded"], c["rows_hashed"]) == (0, 0, 4)
    # a file goes, a policy goes with it, another one comes
    c = step({"a": None, "c": [(9, "green gear")] * 3})
    assert (c["policies_checked"], c["policies_reembedded"], c["chunks_embedded"]) == (3, 1, 3)
    index.fold()
    c = step({"a": [(2, "blue ring")]})
    assert (c["policies_checked"], c["policies_reembedded"]) == (4, 1)
    got = {r.id: r.text_sha for r in index.vectors().collect()}
    assert {k for k in got if k.startswith("9-")} == {"9-1", "9-2", "9-3"} and "2-1" in got
    assert all(v is not None for v in got.values())


def test_a_run_that_failed_before_its_files_were_committed_is_repeated(spark, tmp_path, monkeypatch):
    path = tmp_path / "in"
    path.mkdir()
    index = rx.PolicyIndex(spark, str(tmp_path / "state"))
    first, second = {"a": [(1, "one"), (2, "two")]}, {"b": [(2, "three"), (4, "four")]}
    _land(spark, str(path), first)
    index.run(str(path))
    _land(spark, str(path), second)

    def broken(*a, **k):
        raise RuntimeError("lost")
    monkeypatch.setattr(rx.PolicyIndex, "_embed", broken)
    try:
        index.run(str(path))
    except RuntimeError:
        pass
    monkeypatch.undo()
    c = index.run(str(path))
    assert (c["rows_hashed"], c["policies_reembedded"], c["chunks_embedded"]) == (2, 2, 3)
    assert {r.policy_id: (r.n, r.digest) for r in index.manifest().collect()} == _expected(spark, {**first, **second})


def test_landing_rewrites_only_the_months_from_a_date_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2020-{1 + i % 6:02}-15", f"t{i}") for i in range(24)], "policy_id bigint, at string, text string").withColumn(
        "at", F.col("at").cast("timestamp"))
    path = str(tmp_path / "land")
    rx.land(rows, path, until="2020-04-20")
    before = {r.path: r.modified for r in rx.list_files(spark, path).collect()}
    assert len(before) == 4
    rx.land(rows, path, until="2020-06-30", since="2020-04-20")
    after = {r.path: r.modified for r in rx.list_files(spark, path).collect()}
    kept = [p for p in before if after.get(p) == before[p]]
    assert len(after) == 6 and len(kept) == 3
    assert spark.read.parquet(path).count() == 24


def test_vectors_made_within_rows_equal_those_of_counted_tokens(spark):
    from citesift.functions.models import embed, encoder

    texts = ["l|1|red widget|N|O", "Straße ÉCOLE école", "", None, "12 34", "a a a b " * 9000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.embedding for r in embed(df, "id", "text").collect()}
    got = {r.id: r.v for r in df.repartition(2).select("id", encoder(spark, "text").alias("v")).collect()}
    assert got == {i: want.get(i) for i in range(len(texts))} and got[0] is not None and got[4] is None


def test_the_index_writes_no_tokens_and_shuffles_no_vectors(spark, tmp_path):
    """One shuffle places the rows of a policy; vectors, sums and the first manifest need none of their own."""
    path = tmp_path / "in"
    path.mkdir()
    _land(spark, str(path), {"a": [(i, f"red widget {i}") for i in range(50)]})
    index = rx.PolicyIndex(spark, str(tmp_path / "state"))
    index.run(str(path))
    plan = index.vectors()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert spark.read.parquet(f"{tmp_path}/state/parts/epoch=1").count() == 50


def test_a_key_filter_misses_no_key_and_passes_few_others(spark, monkeypatch):
    from citesift.operators import keyfilter

    keys = spark.createDataFrame([(i * 7, f"k{i}") for i in range(200)] + [(None, "k"), (5, None)], "a bigint, b string")
    rows = keys.unionByName(spark.range(10_000, 15_000).select(F.col("id").alias("a"), F.lit("other").alias("b")))
    for bits, most in ((keyfilter.MOST_BITS, 600), (1 << 13, 600), (8, 6000)):
        monkeypatch.setattr(keyfilter, "MOST_BITS", bits)
        passed = rows.where(keyfilter.may_hold(keys, ["a", "b"]))
        assert passed.join(keys.distinct(), (rows.a.eqNullSafe(keys.a)) & (rows.b.eqNullSafe(keys.b)), "left_semi").count() == 202
        assert 202 <= passed.count() <= most
    assert rows.where(keyfilter.may_hold(keys.limit(0), ["a", "b"])).count() == 0


def test_later_rows_lie_over_older_ones_and_the_rest_is_not_shuffled(spark, tmp_path, monkeypatch):
    from citesift.operators import keyfilter
    from citesift.sinks.snapshot import fold_log, read_latest, write_epoch

    root = str(tmp_path / "log")
    epochs = [[(f"{p}-{i}", p, f"e{e}") for p in ps for i in range(n)] for e, (ps, n) in enumerate([(range(300), 4), ([3, 5, 900], 2), ([5, 7], 5)])]
    for e, rows in enumerate(epochs, 1):
        write_epoch(spark.createDataFrame(rows, "id string, doc int, v string"), root, e)
    want = {r[0]: r for rows in epochs for r in rows}
    for bits in (keyfilter.MOST_BITS, 8):
        monkeypatch.setattr(keyfilter, "MOST_BITS", bits)
        got = read_latest(spark, root, ["id"], unique=True, within=["doc"])
        assert {r.id: tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {r.id: tuple(r) for r in read_latest(spark, root, ["id"], unique=True).collect()} == want
    # the rows that no later one can replace reach the result by a branch of their own
    monkeypatch.undo()
    sent = []
    held = keyfilter.may_hold
    monkeypatch.setattr("citesift.sinks.snapshot.may_hold", lambda keys, cols: sent.append((keys, cols)) or held(keys, cols))
    read_latest(spark, root, ["id"], unique=True, within=["doc"])
    (keys, cols), = sent
    assert cols == ["doc"] and spark.read.parquet(f"{root}/epoch=1").where(held(keys, cols)).count() < 30
    fold_log(spark, root, ["id"])
    assert {r.id: tuple(r) for r in read_latest(spark, root, ["id"], unique=True, within=["doc"]).collect()} == want


def test_logs_and_landed_files_are_compressed_well(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.createDataFrame([(i, f"2020-0{1 + i % 3}-15", f"t{i}") for i in range(24)], "policy_id bigint, at string, text string").withColumn(
        "at", F.col("at").cast("timestamp"))
    rx.land(rows, str(tmp_path / "in"), until="2020-12-31")
    rx.PolicyIndex(spark, str(tmp_path / "state")).run(str(tmp_path / "in"))
    for t in ("in", "state/parts", "state/manifest", "state/vectors"):
        files = [f for f in (tmp_path / t).rglob("*.parquet")]
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
