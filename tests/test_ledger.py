import os
from collections import Counter

import pytest

from citesift.functions import models as m
from citesift.functions.ledger import Ledger, prompt_sha


class Counting(m.Provider):
    """Notes every call in a file that all tasks share; may end its whole worker after some calls."""

    def complete(self, prompt, max_tokens=512):
        with open(os.environ["LEDGER_NOTES"], "a") as f:
            f.write(prompt + "\n")
        if prompt.startswith("slow"):
            raise m.TransientProviderError("later")
        if prompt == "bad":
            raise m.PermanentProviderError("no")
        return prompt.upper()


class Dying(Counting):
    """Its third call of the first worker is the worker's last."""

    def __init__(self):
        self.n = 0

    def complete(self, prompt, max_tokens=512):
        self.n += 1
        if self.n == 3 and not os.path.exists(os.environ["LEDGER_NOTES"] + ".died"):
            open(os.environ["LEDGER_NOTES"] + ".died", "w").close()
            raise RuntimeError("the task is lost")
        return super().complete(prompt, max_tokens)


@pytest.fixture
def notes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "notes")

    def bound(cls):
        class Here(cls):
            def complete(self, prompt, max_tokens=512):
                os.environ["LEDGER_NOTES"] = path
                return cls.complete(self, prompt, max_tokens)
        return Here
    m.register_provider("counting", bound(Counting))
    m.register_provider("dying", bound(Dying))
    return lambda: Counter(open(path).read().split("\n")[:-1]) if os.path.exists(path) else Counter()


def _df(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id int, p string").repartition(3)


def test_each_prompt_is_paid_for_once_over_runs(spark, tmp_path, notes):
    ledger = Ledger(spark, str(tmp_path / "l"))
    kw = dict(provider="counting", in_flight=3, backoff_s=0.0, max_attempts=2)
    out, sent = ledger.complete(_df(spark, ["a", "b", "a", None, "bad", "slow1", ""]), "p", **kw)
    got = sorted((r.id, r.completion, r.attempts, r.failure_type) for r in out.collect())
    assert got == [(0, "A", 1, None), (1, "B", 1, None), (2, "A", 1, None), (3, None, 0, None), (4, None, 1, "permanent"),
                   (5, None, 2, "transient_retries_exhausted"), (6, "", 1, None)]
    assert sent == 5 and notes()["a"] == 1
    out, sent = ledger.complete(_df(spark, ["c", "a", "bad", "slow1"]), "p", **kw)
    assert sent == 1 and {r.p: r.completion for r in out.collect()} == {"c": "C", "a": "A", "bad": None, "slow1": None}
    assert ledger.complete(_df(spark, ["c", "a"]), "p", **kw)[1] == 0
    assert ledger.complete(_df(spark, ["slow1", "bad", "a"]), "p", retry_failed=True, **kw)[1] == 1
    assert notes()["slow1"] == 4 and notes()["bad"] == 1 and notes()["a"] == 1
    assert ledger.answers().count() == 6


def test_a_task_lost_half_way_pays_for_nothing_twice(spark, tmp_path, notes):
    ledger = Ledger(spark, str(tmp_path / "l"))
    prompts = [f"prompt {i}" for i in range(12)]
    kw = dict(provider="dying", in_flight=1, backoff_s=0.0)
    try:
        ledger.complete(_df(spark, prompts), "p", **kw)
    except Exception:
        # a local session does not run a lost task again: the job fails, and is started once more
        out, sent = ledger.complete(_df(spark, prompts), "p", **kw)
        assert {r.p: r.completion for r in out.collect()} == {p: p.upper() for p in prompts}
    assert notes() == Counter({p: 1 for p in prompts})


def test_unknown_provider_and_no_prompts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    with pytest.raises(ValueError):
        ledger.complete(_df(spark, ["a"]), "p", provider="nobody")
    out, sent = ledger.complete(_df(spark, [None, None]), "p", provider="deterministic")
    assert sent == 0 and out.where("attempts = 0").count() == 2 and len(prompt_sha("a")) == 64
