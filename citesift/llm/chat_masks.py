"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of the turns are
intersected with the sorted spans of the tokens by binary search.  The loss mask is kept as one token range
and one character span per assistant turn; a token that reaches over a turn's end is cut to the span.

The template writes ``### Role: text </turn>`` and a newline per turn.  Inside roles and texts every string
that the template or the reader gives a meaning to is preceded by a backslash, and so is a backslash itself,
which makes rendering reversible whatever the texts contain.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.session import ship_package

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
MASKED_ROLE = "assistant"
# how many characters are encoded at a time
BATCH_CHARS = 1 << 20

_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
# inside a text every closing string has a backslash before it, so a space before it means the end of a turn
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
_WORKER: dict = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def escape_role(role: str) -> str:
    return _ESCAPE_ROLE.sub(lambda m: "\\" + m.group(), role)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group(1), text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the character span of each masked text in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = f"{OPEN}{escape_role(role)}{AFTER_ROLE}"
        body = escape(text)
        if role == MASKED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def _tokenizer(path: str):
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        # offsets must cover every character, the spaces before words included
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        _WORKER[path] = t
    return _WORKER[path]


def token_ranges(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span the range ``first .. last - 1`` of tokens that overlap it (empty spans: an empty range)."""
    if not len(spans):
        return []
    starts, ends = offsets[:, 0], offsets[:, 1]
    lo = np.searchsorted(ends, [s for s, _ in spans], side="right")
    hi = np.searchsorted(starts, [e for _, e in spans], side="left")
    return [(int(a), int(max(a, b))) if e > s else (int(a), int(a)) for a, b, (s, e) in zip(lo, hi, spans)]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation, as they were before rendering."""
    turns = []
    for turn in formatted.split(CLOSE)[:-1]:
        head = _HEAD.match(turn)
        turns.append((unescape(head.group(1)), unescape(turn[head.end():])))
    return turns


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > BATCH_CHARS and i > start:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


PAIR = pa.struct([("first", pa.int32()), ("last", pa.int32())])
SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, token_ids, loss_tokens, loss_spans``.

    Turns are ordered by turn, then role, then text, nulls first; a null role or text counts as empty, and
    turns that repeat are all kept.  Rows with a null conversation id form one conversation with that id.
    ``loss_tokens`` holds a range of token numbers and ``loss_spans`` a character span of ``formatted`` for
    every assistant turn in order; an empty text has an empty range and span.  Columns not named are not
    read.  An empty table gives an empty result.
    """
    ship_package(rows.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    item = F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    chats = rows.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    kind = dict(chats.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode_batch
        for batch in batches:
            done = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in batch.column("turns").to_pylist()]
            for a, b in _batches([f for f, _ in done]):
                ids, ranges, cut = [], [], []
                for (_, spans), e in zip(done[a:b], encode([f for f, _ in done[a:b]], add_special_tokens=False)):
                    offsets = np.asarray(e.offsets, dtype=np.int64).reshape(-1, 2)
                    ids.append(np.asarray(e.ids, dtype=np.int32))
                    hits = token_ranges(offsets, spans)
                    ranges.append([{"first": x, "last": y} for x, y in hits])
                    cut.append([{"begin": max(int(offsets[x, 0]), s), "end": min(int(offsets[y - 1, 1]), t)} if y > x else
                                {"begin": s, "end": s} for (x, y), (s, t) in zip(hits, spans)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").slice(a, b - a), pa.array([f for f, _ in done[a:b]], pa.string()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(ranges, pa.list_(PAIR)), pa.array(cut, pa.list_(SPAN))],
                    names=["conv_id", "formatted", "token_ids", "loss_tokens", "loss_spans"])

    return chats.mapInArrow(run, f"conv_id {kind}, formatted string, token_ids array<int>, "
                                 "loss_tokens array<struct<first:int,last:int>>, loss_spans array<struct<begin:int,end:int>>")


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what :func:`format_chats` wrote: its turns, and all text under the loss mask, unescaped."""
    kind = dict(chats.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(formatted)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(formatted[s["begin"]:s["end"]]) for s in spans)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)],
                 batch.column("n_tokens"), batch.column("n_loss_tokens")], names=names)

    masked = F.aggregate("loss_tokens", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"])
    return chats.select("conv_id", "formatted", "loss_spans", F.size("token_ids").cast("bigint").alias("n_tokens"),
                        masked.alias("n_loss_tokens")).mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
             "formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint")
