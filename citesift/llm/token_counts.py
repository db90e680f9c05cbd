"""Token counts: batch encoding inside Arrow functions that return lengths only.

A tokenizer whose pre-tokenisation drops white space gives a text exactly the tokens of its white-space
separated parts, one after the other: ASCII white space is therefore a safe boundary.  Texts are cut there
(so a long text is never encoded in one piece), the distinct parts of a block are encoded in batches of
bounded bytes, and only their lengths are kept.  A worker remembers lengths of short parts up to a fixed
number of entries.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm import words as W
from citesift.llm.shared import fresh
from citesift.session import ship_package

BATCH_BYTES = 256 << 10
REMEMBER = 400_000
SHORT = 48

_WORKER: dict[str, "_Lengths"] = {}


class _Lengths:
    """Lengths in tokens of white-space separated parts, with a bounded memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def _encode(self, parts: list[bytes], into: dict[bytes, int]) -> None:
        start = size = 0
        for i, part in enumerate(parts):
            if size + len(part) > BATCH_BYTES and i > start:
                self._batch(parts[start:i], into)
                start, size = i, 0
            size += len(part)
        self._batch(parts[start:], into)

    def _batch(self, parts: list[bytes], into: dict[bytes, int]) -> None:
        texts = [p.decode("utf-8") for p in parts]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        into.update(zip(parts, map(len, encoded)))

    def count(self, texts: list[bytes]) -> list[int]:
        parts = [t.split() for t in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self.known = {}
            new = set(chain.from_iterable(parts))
        long = [p for p in new if len(p) > SHORT]
        if new:
            self._encode(sorted(new), self.known)
        out = [sum(map(self.known.__getitem__, p)) for p in parts]
        for p in long:
            del self.known[p]
        return out


def _lengths(path: str) -> _Lengths:
    if path not in _WORKER:
        _WORKER[path] = _Lengths(path)
    return _WORKER[path]


def token_counts(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",),
                 tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """``keys``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``) for every row.

    A null or empty text has 0 bytes and 0 tokens.  Rows with equal or null keys are counted each for
    themselves; columns other than ``keys`` and ``text`` are not read, so their names cannot clash.  An
    empty table gives an empty result.  ``tokenizer`` is the path of a tokenizer file whose
    pre-tokenisation drops white space (default: ``word_bpe_49k.json``).
    """
    ship_package(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    body = fresh(docs, "body")[0]
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias(body))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path)
        for batch in batches:
            for part, raw, offs in W.blocks(batch, body):
                data = raw.tobytes()
                cuts = offs.tolist()
                n = lengths.count([data[a:b] for a, b in zip(cuts, cuts[1:])])
                tokens = np.asarray(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.diff(offs)), pa.array(tokens), pa.array(tokens > limit)],
                    names=[*keys, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"{fields}, n_bytes bigint, n_tokens bigint, over_limit boolean")
