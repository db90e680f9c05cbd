import os

import pytest
from pyspark.sql import functions as F

from citesift.sources import nested


def _files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names)


def test_each_row_is_one_file_and_each_file_one_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nested, "NAMES", 3)
    texts = ["", None, "two\nlines", "wörter", "x" * 5000, *["again"] * 20]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    path = str(tmp_path / "docs")
    for _ in range(2):
        nested.write_text_documents(df, path)
        # a file a row and nothing beside it: no checksums, no folders of attempts
        assert len(_files(path)) == len(texts) and all(f.endswith(".txt") for f in _files(path))
    got = nested.read_text_documents(spark, f"file://{path}", recursive=True)
    assert sorted(r.text for r in got.collect()) == sorted((t or "") + "\n" for t in texts)
    assert got.columns == ["file_name", "text"] and got.where(F.length("text") == 5001).count() == 1


def test_an_attempt_that_is_repeated_adds_no_file(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "c"])], ["text"])
    for _ in range(2):
        assert [b.column(0).to_pylist() for b in nested._write_task(iter([batch]), str(tmp_path), 7)] == [[3]]
    assert os.listdir(tmp_path) == ["task=00007"] and len(_files(tmp_path)) == 3


def test_local_and_scanned_folders_read_alike(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for name, text in {"a.txt": b"one", "b.txt": b"\xff\xfe two", "c.md": b"no", "_d.txt": b"hidden", ".e.txt": b"hidden", "below/f.txt": b"deep"}.items():
        (tmp_path / name).write_bytes(text)
    for recursive, n in ((False, 2), (True, 3)):
        own, scanned = (nested.read_text_documents(spark, str(tmp_path), g, recursive=recursive) for g in ("*.txt", "*.{txt}"))
        rows = [sorted((r.file_name, bytes(r.b)) for r in d.select("file_name", F.col("text").cast("binary").alias("b")).collect()) for d in (own, scanned)]
        assert rows[0] == rows[1] and len(rows[0]) == n
    for glob in ("*.rtf", "*.{rtf}"):
        with pytest.raises(FileNotFoundError):
            nested.read_text_documents(spark, str(tmp_path), glob)


def test_a_look_for_any_document_does_not_read_all(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_text("word " * i)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for glob in ("*.txt", "*.{txt}"):
            sc.setJobGroup(f"look {glob}", "")
            nested.read_text_documents(spark, str(tmp_path), glob)
            jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"look {glob}")]
            tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
            assert sum(tasks) < 10, tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        sc._jsc.clearJobGroup()
