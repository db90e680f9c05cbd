import hashlib
import random
import re

from pyspark.sql import types as T

from citesift.llm.repeat_automata import remove_repeats, repeat_digests
from tests.conftest import SF_MID

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("n_removed", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=50):
    split = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (key, *_), words in zip(rows, split):
        if key is not None:
            for s in range(len(words) - length + 1):
                w = tuple(words[s:s + length])
                first[w] = min(first.get(w, key), key)
    out = []
    for (key, *_), words in zip(rows, split):
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if key is not None and first[tuple(words[s:s + length])] < key:
                gone[s:s + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((key, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus():
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdeéñ", k=rnd.randint(1, 6))) for _ in range(400)] + ["same", "中文,"]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 60, 120, 400)]
    rows = []
    for i in range(160):
        words = text(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.choice([0, 0, rnd.randrange(len(p))])
            at = rnd.randrange(len(words) + 1)
            words[at:at] = p[a:]
        rows.append((i * 3, rnd.choice([" ", "\n", "\t ", "  "]).join(words), ""))
    rows += [(1000 + i, " ".join(passages[4]), "") for i in range(30)]
    rows += [(2000 + i, " ".join(["same"] * n), "") for i, n in enumerate((40, 50, 51, 300, 80, 50))]
    rows += [(7, None, ""), (8, "", ""), (None, rows[5][1], ""), (None, " ".join(passages[5]), ""), (3, rows[1][1], ""),
             (9, " \n ", ""), (3000, " ".join(text(60_000)), ""), (12, " ".join(passages[5]), ""), (12, " ".join(passages[5]), "")]
    rnd.shuffle(rows)
    return rows


def test_equal_to_brute_force(spark, monkeypatch):
    from citesift.llm import repeat_automata as R

    monkeypatch.setattr(R, "SHARD_WORDS", 300)
    monkeypatch.setattr(R, "PIECE", 70)
    monkeypatch.setattr(R, "SLICE_BYTES", 5000)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = repeat_digests(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    cut = remove_repeats(df)
    assert cut.columns == df.columns
    texts = sorted((str(k), kept if n else (t or "")) for (k, t, _), (_, _, n, _, kept) in zip(rows, want))
    assert sorted((str(r.doc_id), r.text or "") for r in cut.collect()) == texts


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeat_digests(empty).count() == 0 and remove_repeats(empty).count() == 0


def test_query_over_the_whole_table(spark):
    from citesift.llm.queries import op1_repeat_automata

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    got = op1_repeat_automata(spark, SF_MID).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(w[:4] for w in brute(rows))


def test_passages_and_cuts_are_made_block_by_block():
    """A batch of long texts is never held as Python objects whole: each block gives a batch of its own."""
    import pyarrow as pa

    from citesift.llm import repeat_automata as ra
    from citesift.llm import words as W

    text = " ".join(f"w{i}" for i in range(W.BLOCK_BYTES // 8))
    n = 5
    runs = pa.array([[{"shard": 3, "first": 2, "last": 5}]] * n, pa.list_(pa.struct([("shard", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])))
    got = list(ra._passages(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n), runs], names=["doc_id", "text", "runs"])])))
    assert len(got) > 1 and [r for b in got for r in b.to_pylist()] == [{"shard": 3, "owner": i, "n_words": 3, "words": b"w2 w3 w4"} for i in range(n)]
    spans = pa.array([[[{"first": 0, "last": 3}]]] * n, pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))))
    cut = list(ra._cut(iter([pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([0] * n), pa.array([text] * n), spans], names=["doc_id", "h1", "text", "spans"])])))
    assert len(cut) > 1
    assert [(r["doc_id"], r["n_removed"], r["kept"]) for b in cut for r in b.to_pylist()] == [(i, 3, text.split(" ", 3)[3]) for i in range(n)]
