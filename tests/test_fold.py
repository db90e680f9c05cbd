import os

from citesift.sinks.snapshot import fold_log, read_latest, write_epoch


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _write(spark, root, epoch, rows):
    write_epoch(spark.createDataFrame(rows, "k int, v string"), root, epoch)


def _state(epochs, before=None):
    out = {}
    for n in sorted(epochs):
        if before is None or n < before:
            out |= dict(epochs[n])
    return sorted(out.items())


def test_folded_log_reads_like_the_log(spark, tmp_path):
    root, epochs = str(tmp_path / "log"), {}
    assert fold_log(spark, root, ["k"]) is None and read_latest(spark, root, ["k"]) is None
    for n in range(9):
        epochs[n] = [(k, f"{n}-{k}") for k in range(n % 3, 10, 3 + n % 2)] + [(100 + n, "own")]
        _write(spark, root, n, epochs[n])
        if n in (2, 5, 8):
            assert fold_log(spark, root, ["k"]) == n - 1
        assert _rows(read_latest(spark, root, ["k"])) == _state(epochs)
        # the last epoch may be replayed: what it reads, and what it writes again, is as before
        assert n == 0 or _rows(read_latest(spark, root, ["k"], before=n)) == _state(epochs, n)
        _write(spark, root, n, epochs[n])
        assert _rows(read_latest(spark, root, ["k"])) == _state(epochs)
    # epochs that an earlier fold holds are gone, however old the log is
    assert sorted(x for x in os.listdir(root) if x.startswith("epoch=")) == [f"epoch={n}" for n in (5, 6, 7, 8)]
    assert fold_log(spark, root, ["k"]) == 7


def test_a_fold_without_its_marker_does_not_count(spark, tmp_path):
    root = str(tmp_path / "log")
    for n in range(3):
        _write(spark, root, n, [(1, f"v{n}")])
    spark.createDataFrame([(1, "half written")], "k int, v string").write.parquet(f"{root}.folds/upto=1")
    assert _rows(read_latest(spark, root, ["k"])) == [(1, "v2")] and _rows(read_latest(spark, root, ["k"], before=2)) == [(1, "v1")]
    assert fold_log(spark, root, ["k"]) == 1
    assert _rows(read_latest(spark, root, ["k"], before=2)) == [(1, "v1")]
