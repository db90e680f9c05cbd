import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

from citesift.llm.weighted_minhash import drop_near_texts, near_texts
from tests.conftest import SF_MID

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("class_id", T.StringType())])


def bag(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def weighted(rows):
    """TF-IDF weights as the operator takes them: document frequencies in hashed cells."""
    import numpy as np

    from citesift.llm import weighted_minhash as M

    raws = [np.frombuffer((t or "").encode(), dtype=np.uint8) for _, t, *_ in rows]
    sets = [M.shingles(r, np.array([0, len(r)]), 5) for r in raws]
    held = np.zeros(1 << M.CELL_BITS)
    for _, value, _ in sets:
        held += np.bincount(M._cells(value), minlength=len(held))
    idf = 1 + np.log1p(len(rows) / np.maximum(held, 1)) / np.log1p(len(rows))
    return [dict(zip(v.tolist(), ((1 + np.log(n)) * idf[M._cells(v)]).tolist())) for _, v, n in sets]


def similarity(a, b):
    inner = sum(min(w, b[s]) for s, w in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - inner
    return inner / total if total else 0.0


def brute(rows, similar=0.8):
    """Component of every row by comparing all pairs that share a shingle."""
    sets, where = weighted(rows), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen = set()
    for at in where.values():
        for x, i in enumerate(at):
            for j in at[x + 1:]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if find(i) != find(j) and similarity(sets[i], sets[j]) >= similar:
                        parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for at in groups.values():
        ids = [rows[i][0] for i in at if rows[i][0] is not None]
        for i in at:
            out[i] = min(ids, default=None) if sets[i] else rows[i][0]
    return [out[i] for i in range(len(rows))]


def corpus():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("abcdefé", k=rnd.randint(2, 7))) for _ in range(900)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 220))), "") for i in range(120)]
    license_line = " ".join(rnd.choices(vocabulary, k=12))
    rows += [(200 + i, " ".join(rnd.choices(vocabulary, k=30)) + " " + license_line, "") for i in range(60)]
    base = rnd.choices(vocabulary, k=200)
    for i in range(50):
        words = list(base)
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(200)] = rnd.choice(vocabulary)
        rows.append((400 + i, " ".join(words), ""))
    for i in range(60):
        words = rows[rnd.randrange(120)][1].split()
        for _ in range(len(words) // 60):
            words[rnd.randrange(len(words))] = "edit"
        rows.append((500 + i, rnd.choice([" ", "\n"]).join(words), ""))
    rows += [(600 + i, " ".join(base), "") for i in range(20)]
    rows += [(700, None, ""), (701, "", ""), (702, " \t", ""), (703, "a b", ""), (704, "a b", ""), (None, rows[3][1], ""),
             (None, "only null keys here " * 9, ""), (705, "x " * 30_000, ""), (3, rows[3][1], ""), (706, "same " * 300, "")]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_texts(df).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = [(r[0], c) for r, c in zip(rows, brute(rows))]
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    kept = drop_near_texts(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=lambda x: (x is None, x or 0)) == sorted({c for _, c in want}, key=lambda x: (x is None, x or 0))


def test_crowded_groups_meet_in_blocks(spark, monkeypatch):
    """With one sample a band, texts that only share some shingles meet and must all be told apart."""
    from citesift.llm import weighted_minhash as M

    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "SLICE_PAIRS", 5)
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(3000)]
    shared = " ".join(words[:9])
    rows = [(i, shared + " " + " ".join(rnd.sample(words, 14 if i % 3 else 2)), "") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "") for i in range(0, 60, 3)]
    got = {r.doc_id: r.class_id for r in near_texts(spark.createDataFrame(rows, SCHEMA), bands=24, rows=1).collect()}
    assert got == {r[0]: c for r, c in zip(rows, brute(rows))}


def test_one_row_stays_of_every_class_with_null_or_shared_keys(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(2000)]
    texts = [" ".join(rnd.sample(words, 60)) for _ in range(9)]
    rows = [(None, t, "null") for t in texts[:5]] + [(None, texts[0], "copy"), (None, texts[1] + " tail", "near"), (None, "", "bare")]
    rows += [(7, texts[5], "one"), (7, texts[6], "other"), (8, texts[6] + " tail", "near"), (None, texts[7], "null"), (9, texts[7], "key")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = drop_near_texts(df).collect()
    sets, classes = weighted(rows), []
    for i in range(len(rows)):
        mates = [c for c in classes if any(similarity(sets[i], sets[j]) >= 0.8 for j in c)]
        classes = [c for c in classes if c not in mates] + [sum(mates, []) + [i]]
    home = {(rows[i][0], rows[i][1]): n for n, c in enumerate(classes) for i in c}
    assert sorted(home[r.doc_id, r.text] for r in kept) == list(range(len(classes))) and len(kept) == 9
    assert {r.doc_id for r in kept if r.text in texts[5:8]} == {7, 9} and sum(r.text == "" for r in kept) == 1
    ids = {r.doc_id: r.class_id for r in near_texts(df).collect() if r.doc_id is not None}
    assert ids == {7: 7, 8: 7, 9: 9}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_texts(empty).count() == 0 and drop_near_texts(empty).count() == 0


def test_query_over_the_whole_table(spark):
    from citesift.llm.queries import op7_weighted_minhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in op7_weighted_minhash(spark, SF_MID).collect()}
    assert got == {r[0]: c for r, c in zip(rows, brute(rows))}
