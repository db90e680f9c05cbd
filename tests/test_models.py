"""Provider registry, retry classification and the embedding-model slot (UDF-1..3)."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from citesift.functions import models as m


class Flaky(m.Provider):
    """Fails by the prompt's text: 't1' transient once, 'tt' transient always, 'p' permanent."""

    seen: dict = {}

    def complete(self, prompt, max_tokens=512):
        n = Flaky.seen.get(prompt, 0) + 1
        Flaky.seen[prompt] = n
        if prompt == "p":
            raise m.PermanentProviderError("refused")
        if prompt == "tt" or (prompt == "t1" and n == 1):
            raise m.TransientProviderError("timeout")
        return f"ok:{prompt}"


def test_retry_classification_per_prompt():
    Flaky.seen = {}
    waits = []
    run = lambda p: m.call_with_retry(Flaky(), p, sleep=waits.append)
    assert run("a") == ("ok:a", 1, None)
    assert run("t1") == ("ok:t1", 2, None)
    assert run("tt") == (None, 2, "transient_retries_exhausted")
    assert run("p") == (None, 1, "permanent")
    assert waits == [0.5, 0.5]  # one back-off before each second attempt


def test_unknown_provider_is_an_error(spark):
    df = spark.createDataFrame([("x",)], "q string")
    with pytest.raises(ValueError):
        m.complete(df, "q", provider="nope")


class Stub(m.Provider):
    """The same answer per prompt as a column."""

    def complete(self, prompt, max_tokens=512):
        return f"<{prompt}>"

    def column(self, prompt):
        return F.concat(F.lit("<"), prompt, F.lit(">"))


def test_mapinpandas_path_equals_column_path(spark):
    m.register_provider("stub", Stub)
    df = spark.createDataFrame([(1, "hello"), (2, "wörld\\nline"), (3, None)], "id int, q string")
    a = m.complete(df, "q", provider="stub", prefer_column=False).orderBy("id").collect()
    b = m.complete(df, "q", provider="stub").orderBy("id").collect()
    assert a == b
    assert a[2]["completion"] is None and a[2]["attempts"] == 0


def test_a_faulty_provider_fails_the_job():
    class Broken(m.Provider):
        def complete(self, prompt, max_tokens=512):
            raise KeyError("not a provider error")

    with pytest.raises(KeyError):
        m.call_with_retry(Broken(), "x")


def test_failures_are_rows_not_job_errors(spark):
    m.register_provider("flaky", Flaky)
    df = spark.createDataFrame([("a",), ("p",), ("tt",)], "q string")
    got = {r["q"]: (r["completion"], r["attempts"], r["failure_type"])
           for r in m.complete(df, "q", provider="flaky", backoff_s=0.0).collect()}
    assert got == {"a": ("ok:a", 1, None), "p": (None, 1, "permanent"),
                   "tt": (None, 2, "transient_retries_exhausted")}


def test_embedding_model_slot_builds_once_per_task(spark):
    def factory():
        built = [0]
        built[0] += 1
        return lambda texts: [[float(len(t)), float(built[0])] for t in texts]

    m.register_embedder("length", factory)
    df = spark.range(50).select(F.col("id"), F.repeat(F.lit("ab"), (F.col("id") % 4).cast("int")).alias("t"))
    rows = m.embed(df.coalesce(1), "id", "t", model="length").collect()
    assert {r["id"]: r["embedding"][0] for r in rows} == {i: float(2 * (i % 4)) for i in range(50)}
    assert {r["embedding"][1] for r in rows} == {1.0}
    with pytest.raises(ValueError):
        m.embed(df, "id", "t", model="missing")


def test_provider_path_runs_from_any_directory(tmp_path):
    # a driver started outside the repository: workers must still import the package (shipped by addPyFile)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from citesift.session import get_spark\n"
            "import __spark_entry__ as E\n"
            "s = get_spark('local[2]', shuffle_partitions=2)\n"
            "print('rows', E.queries()['provider_completion'](s, '/root/testdata/sf0.001').count())\n"
            "s.stop()\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 48" in out.stdout, out.stderr[-2000:]
