import random
from datetime import timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from citesift.operators.budget import sequential_gate
from citesift.streaming.keyed import decisions, stream_gate_keyed


def _events(n, users, seed=1):
    rnd = random.Random(seed)
    return [{"event_id": i, "ts": 1_000_000 * (i // 2), "user_id": None if i % 97 == 0 else rnd.choice(users), "event_type": "x", "value": 1.0,
             "props": None} for i in range(n)]


def _write(folder, name, rows):
    kinds = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()}
    pq.write_table(pa.table({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()}), f"{folder}/{name}.parquet")


def _batch(spark, rows, budget):
    df = spark.createDataFrame([(r["user_id"], r["event_id"], r["ts"]) for r in rows if r["user_id"] is not None], "user_id bigint, event_id bigint, ts bigint")
    g = sequential_gate(df, ["user_id"], ["ts", "event_id"], budget=budget)
    return sorted((r.user_id, r.event_id, r.seq, r.tokens_spent, r.within_budget) for r in g.collect())


def _rows(tables):
    return sorted((r.user_id, r.event_id, r.seq, r.tokens_spent, r.within_budget) for r in decisions(tables).collect())


def test_split_doubled_and_restarted_delivery_equals_the_batch_gate(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rows = _events(400, [1] * 5 + list(range(2, 12)))
    _write(folder, "events", rows[:100])
    # a second delivery of calls that are known, beside new ones
    _write(folder, "events-1", rows[50:200])
    stream_gate_keyed(spark, str(folder), budget=3000, root=root)
    assert _rows(stream_gate_keyed(spark, str(folder), budget=3000, root=root)) == _batch(spark, rows[:200], 3000)
    _write(folder, "events-2", rows[200:] + rows[:10])
    allowed, refused = stream_gate_keyed(spark, str(folder), budget=3000, root=root)
    assert _rows((allowed, refused)) == _batch(spark, rows, 3000)
    assert allowed.where("not within_budget").count() == 0 and refused.where("within_budget").count() == 0
    # one refusal a user at most, whoever goes on calling
    assert refused.count() == refused.select("user_id").distinct().count() > 0


def test_late_calls_are_gated_when_they_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [dict(r, user_id=1) for r in _events(12, [1])]
    _write(folder, "events", rows[6:])
    root = str(tmp_path / "out")
    stream_gate_keyed(spark, str(folder), budget=2400, root=root)
    _write(folder, "events-1", rows[:6])
    got = _rows(stream_gate_keyed(spark, str(folder), budget=2400, root=root))
    # six calls of the first file, then those that came late until the budget of eight calls is spent
    assert [g[1] for g in sorted(got, key=lambda g: g[2])] == [6, 7, 8, 9, 10, 11, 0, 1, 2]
    assert [g[4] for g in sorted(got, key=lambda g: g[2])] == [True] * 8 + [False]


def test_state_that_expired_is_forgotten(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    rows = [dict(r, user_id=1) for r in _events(10, [1])]
    _write(folder, "events", rows[:5])
    root, ttl = str(tmp_path / "out"), timedelta(seconds=2)
    stream_gate_keyed(spark, str(folder), budget=900, root=root, ttl=ttl)
    time.sleep(4)
    _write(folder, "events-1", rows[5:])
    got = _rows(stream_gate_keyed(spark, str(folder), budget=900, root=root, ttl=ttl))
    assert [g[4] for g in got] == [True, True, True, False] * 2
