import hashlib
import random
from collections import defaultdict

from pyspark.sql import types as T

from citesift.llm.chat_masks import escape, format_chats, parse, read_back, render, unescape

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("formatted", T.StringType())])
PARTS = ["\\", "###", "### ", "</turn>", " </turn>\n", ": ", ":", " ", "\n", "é", "中文", "👍", "ok", "", "<|endoftext|>",
         "### assistant: ", "\\\\", "#", "<", "/turn>", "\r\n", "  "]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expect(rows):
    chats = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        chats[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in chats.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[3]}\n{t[5]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_escaping_is_reversible():
    rnd = random.Random(3)
    for _ in range(3000):
        turns = [("".join(rnd.choices(PARTS, k=rnd.randint(0, 3))) or "user", "".join(rnd.choices(PARTS, k=rnd.randint(0, 9))))
                 for _ in range(rnd.randint(0, 4))]
        assert all(unescape(escape(t)) == t for _, t in turns)
        assert parse(render(turns)[0]) == turns


def test_read_back_equals_the_input(spark):
    rnd = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 6)):
            rows.append((conv, turn if rnd.random() > .1 else None, rnd.choice(["user", "assistant", "system", None]),
                         None if rnd.random() < .1 else "".join(rnd.choices(PARTS, k=rnd.randint(0, 12))), "clash"))
    rows += [(None, 0, "assistant", "no id", ""), (None, 1, "assistant", "", "")]
    rows += [(500, 1, "assistant", "twice", "")] * 2 + [(501, 0, "assistant", "wört 中 " * 30_000, "")]
    out = format_chats(spark.createDataFrame(rows, SCHEMA))
    want = expect(rows)
    got = read_back(out).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    for r in out.collect():
        assert all(0 <= x["first"] <= x["last"] <= len(r.token_ids) for x in r.loss_tokens)
        assert all(a["end"] <= b["begin"] for a, b in zip(r.loss_spans, r.loss_spans[1:]))


def test_empty_table(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_over_the_whole_table(spark):
    from citesift.llm.queries import op10_chat_masks
    from tests.conftest import SF_MID

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = op10_chat_masks(spark, SF_MID).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expect(rows)
