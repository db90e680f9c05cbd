import random
import zlib

from pyspark.sql import types as T

from citesift.llm.toxicity import Lexicon, _word_codes, cells, fit, toxicity_scores

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("score", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(1)
    lexicon = Lexicon(["moron", "trash", "vequ", "disgusting", "scum"], [False, False, True, False, True], [1, 1, 1, 2, 1])
    texts = []
    for _ in range(4000):
        w = list(rnd.choice(lexicon.terms))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            w[i:i + rnd.randint(0, 1)] = rnd.choice(["", "x", "é", "s", "1"])
        texts.append("".join(w) + rnd.choice(["", "", "ai", "zz"]))
    texts = [t for t in texts if t]
    codes, begin, end, _ = _word_codes(texts)
    assert len(begin) == len(texts)
    w, term, edits = lexicon.hits(codes, begin, end)
    got = {int(i): int(e) for i, e in zip(w, edits)}
    for i, text in enumerate(texts):
        found = []
        for t, term_text in enumerate(lexicon.terms):
            heads = [text[:k] for k in range(len(text) + 1)] if lexicon.stems[t] else [text]
            d = min(distance(h, term_text) for h in heads)
            if d <= lexicon.limits[t]:
                found.append(d)
        assert got.get(i) == min(found, default=None), text


def test_signs_around_a_word_are_no_part_of_it():
    lexicon = Lexicon(["stupid"], [False], [1])
    assert cells(lexicon, ["STUPID!!", "stupid###", "&&&stupid$$$", "st*pid", "s-t-u-p-i-d", "**stupid**"]) == [
        {(0, 0, False)}, {(0, 0, False)}, {(0, 0, False)}, {(0, 1, False)}, set(), {(0, 0, False)}]


def test_quotation_is_told_from_abuse():
    lexicon = Lexicon(["idiot"], [False], [1])
    assert cells(lexicon, ["you are an idiot today", "he said \"what an idiot\" again", "«idiot» war das Wort", "“ a b c” idiot ”",
                           "an idoit", "idi0t, really", ""]) == [
        {(0, 0, False)}, {(0, 0, True)}, {(0, 0, True)}, {(0, 0, False)}, set(), {(0, 1, False)}, set()]


def _table(n=900):
    rnd = random.Random(2)
    clean = ["house", "river", "window", "losing", "stupor", "market", "green"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        ws = rnd.choices(clean, k=rnd.randint(3, 60))
        if toxic:
            ws.insert(rnd.randrange(len(ws)), rnd.choice(["Loser!", "stupid", "bragnoxio", "bragnoxen", "bragnoxu"]))
        if i % 60 == 0:
            # one toxic text with many copies: the words it happens to hold are no terms
            ws += "only copies hold these wordlings besides".split()
        docs.append((i, " ".join(ws), "clash"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learning_held_out_rows_and_edge_cases(spark):
    docs, labels = _table()
    more = [(None, "you loser", ""), (5000, None, ""), (5001, "", ""), (5002, "what a stupit thing", ""),
            (5003, "green " * 40_000 + "loser", ""), (5003, "river", ""), (5004, "bragnoxille", "")]
    df = spark.createDataFrame(docs + more, DOCS)
    extra = [(1, 1, None), (None, 1, 1), (3, 0, 0), (3, 0, 0)]
    model = fit(df, spark.createDataFrame(labels + extra, LABELS))
    assert sorted(model.lexicon.terms) == ["bragnox", "loser", "stupid"]
    out = toxicity_scores(df, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert all(0 <= x <= 1 for x in got.values())
    assert all((got[i, t] >= 0.7) == (i % 6 == 0) for i, t, _ in docs)
    for (i, t, _), toxic in zip(more, [1, 0, 0, 1, 1, 0, 1]):
        assert (got[i, t] >= 0.7) == bool(toxic), (i, t)
    # labels of held-out rows change nothing
    turned = [(i, q, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, q, x in labels]
    again = fit(df, spark.createDataFrame(turned, LABELS))
    assert again.weights == model.weights and again.lexicon.terms == model.lexicon.terms


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity_scores(docs, fit(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "a b", "")], DOCS)
    assert 0 <= toxicity_scores(some, fit(some, labels)).first().score <= 1


def test_query_held_out_accuracy(spark):
    """Some labels of the small tables are turned round, so no scorer agrees with all of them."""
    from citesift.llm.queries import op4_toxicity

    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op4_toxicity(spark, sf_dir).collect()
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)


def test_short_and_rare_words_are_terms(spark):
    """A telling word of three letters, and one that 9 of 2,000 toxic texts hold."""
    rnd = random.Random(4)
    neutral = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(400)]
    ids = [i for i in range(30_000) if zlib.crc32(str(i).encode()) % 3 != 1][:12_000]
    word = lambda i: "zog" if i < 300 else "grimbolt" if i < 309 else "blarghed" if i < 2000 else ""
    rows = [(d, " ".join([*rnd.choices(neutral, k=5), word(i), *rnd.choices(neutral, k=3)]), int(i < 2000)) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert {"zog", "grimbolt"} <= {n if len(n) < 4 else "grimbolt" if "grimbolt".startswith(n) else n for n in model.lexicon.terms}
    texts = [(n, "some " + w + " here") for n, w in enumerate(["zog", "grimbolt", "zogs", "zo", "zag", "nothing"])]
    got = {r.doc_id: r.score for r in toxicity_scores(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    assert [got[n] >= 0.7 for n in range(6)] == [True, True, False, False, False, False]
