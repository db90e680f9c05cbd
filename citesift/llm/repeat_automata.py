"""Repeated passages: confirmed by their windows, compiled into sharded automata, located in all documents.

A window is ``length`` consecutive words.  Work runs in four steps, each over all documents:

1. Every window is stood for by the smallest hash among its shorter word runs, so a text yields few such
   anchors and equal windows always yield the same one.  Anchors seen in one document only cannot belong to a
   repeated window and are dropped.
2. Windows over the anchors that are left are hashed and counted; those of several documents are confirmed,
   and the first document that holds one owns it.  Neighbouring windows of an owner join into passages.
3. Passages are cut into blocks so that every window holds a whole one.  The blocks of a bounded number of
   passages become one Aho-Corasick automaton, which reads words as single characters of its own alphabet.
4. Documents stream through the automata of the passages they share.  Around each block found, windows are
   compared with the passage word by word; nothing is removed on a hash alone.

Copies of one text are settled first: all but the copy with the smallest key are repeated as a whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.llm import words as W
from citesift.llm.shared import Tables, fresh

LENGTH = 50
RUN = 20
BLOCK = 25
# words of passages in one automaton; start positions of one piece of a long passage; text bytes of one slice
SHARD_WORDS = 50_000
PIECE = 10_000
SLICE_BYTES = 4 << 20


def _least(raw: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: word hashes, each text's first word, the start and text of each window, its smallest run hash."""
    begin, end, first = W.word_bounds(raw, offs)
    hashes = W.word_hashes(raw, begin, end)
    least = W.window_min(W.run_hashes(hashes, RUN, 1), length - RUN + 1) if len(hashes) >= length else np.zeros(0, np.uint64)
    start = np.flatnonzero(W.inside(first, len(hashes), length))
    text = np.searchsorted(first, start, side="right") - 1
    return hashes, first, start, text, least[start]


def _facts(length: int):
    """Word count, digest of the words and anchors of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in W.blocks(batch, "text"):
                _, first, start, text, least = _least(raw, offs, length)
                data, cuts = raw.tobytes(), offs.tolist()
                digests = [hashlib.sha256(b" ".join(data[a:b].split())).digest() for a, b in zip(cuts, cuts[1:])]
                # equal neighbours are dropped before the exact set is taken per text
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                text, least = text[new], least[new]
                order = np.lexsort((least, text))
                text, least = text[order], least[order]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                text, least = text[new], least[new]
                stops = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(np.diff(first).astype(np.int64)),
                     pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(stops), pa.array(least.view(np.int64)))],
                    names=["doc_id", "h1", "h2", "n_words", "digest", "anchors"])

    return run


def _windows(length: int):
    """Hash, key and start of every window whose smallest run hash is among the anchors of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in W.blocks(batch, "text"):
                hashes, first, start, text, least = _least(raw, offs, length)
                marks = np.asarray(part.column("anchors").flatten()).view(np.uint64)
                hit = np.isin(least, marks)
                start, text = start[hit], text[hit]
                whole = W.run_hashes(hashes, length, 2)[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole.view(np.int64)), part.column("doc_id").take(pa.array(text)),
                     pa.array((start - first[text]).astype(np.int32))], names=["w", "doc_id", "pos"])

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts, so that no more than a block of them is held as Python objects."""
    for part, raw, offs in W.blocks(batch, "text"):
        data, cuts = raw.tobytes(), offs.tolist()
        yield part, [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each passage of an owner, joined by one space."""
    for batch in batches:
        for part, texts in _texts(batch):
            out: list[tuple[int, int, int, bytes]] = []
            for owner, text, runs in zip(part.column("doc_id").to_pylist(), texts, part.column("runs").to_pylist()):
                words = text.split()
                out += [(r["shard"], owner, len(words[r["first"]:r["last"]]), b" ".join(words[r["first"]:r["last"]])) for r in runs]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["shard", "owner", "n_words", "words"])


class Automaton:
    """The blocks of some passages over an alphabet with one character per word, and the passages' windows."""

    def __init__(self, passages: list[tuple[int, list[bytes]]], length: int):
        self.length, self.block = length, (length + 1) // 2
        self.letter: dict[bytes, str] = {}
        self.owner: dict[str, int] = {}
        self.found = ahocorasick.Automaton()
        for owner, words in passages:
            for w in words:
                if w not in self.letter:
                    n = len(self.letter) + 1
                    self.letter[w] = chr(n if n < 0xD800 else n + 0x800)
            line = "".join([self.letter[w] for w in words])
            for s in range(len(line) - length + 1):
                window = line[s:s + length]
                if owner < self.owner.get(window, owner + 1):
                    self.owner[window] = owner
            for s in range(0, len(line) - self.block + 1, self.block):
                self.found.add_word(line[s:s + self.block], 0)
        self.found.make_automaton()

    def locate(self, key: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans of words covered by windows that an owner before ``key`` holds too."""
        if not self.owner or len(words) < self.length:
            return []
        other = "\0"
        line = "".join([self.letter.get(w, other) for w in words])
        last = len(line) - self.length
        spans: list[tuple[int, int]] = []
        tried = 0
        for end, _ in self.found.iter(line):
            first = end - self.block + 1
            for s in range(max(tried, first - (self.length - self.block)), min(first, last) + 1):
                if self.owner.get(line[s:s + self.length], key) < key:
                    if spans and s <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], s + self.length)
                    else:
                        spans.append((s, s + self.length))
            tried = max(tried, min(first, last) + 1)
        return spans


def _locate(length: int):
    def run(passages: pa.Table, docs: pa.Table) -> pa.Table:
        automaton = Automaton([(o, w.split()) for o, w in zip(passages.column("owner").to_pylist(), passages.column("words").to_pylist())], length)
        out = []
        for key, h1, text in zip(docs.column("doc_id").to_pylist(), docs.column("h1").to_pylist(),
                                 docs.column("text").cast(pa.binary()).to_pylist()):
            spans = automaton.locate(key, (text or b"").split())
            if spans:
                out.append((key, h1, [{"first": a, "last": b} for a, b in spans]))
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "h1", "spans"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words outside all spans, joined by one space."""
    for batch in batches:
        for part, texts in _texts(batch):
            removed, kept = [], []
            for text, groups in zip(texts, part.column("spans").to_pylist()):
                words = text.split()
                gone = bytearray(len(words))
                for g in groups:
                    for x in g:
                        gone[x["first"]:x["last"]] = b"\1" * (x["last"] - x["first"])
                removed.append(sum(gone))
                kept.append(b" ".join([w for w, g in zip(words, gone) if not g]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h1"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "h1", "n_removed", "kept"])


def find_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What is repeated: a row of facts per document, and the kept words of documents that lose some.

    Facts: ``doc_id, h1, n_words, digest, copy`` (``h1`` is a hash of the text, ``digest`` the SHA-256 of all
    words joined by one space, ``copy`` whether the whole text is a later copy).  Changed documents that are
    not copies: ``doc_id, h1, n_removed, kept``.
    """
    tables = Tables(docs.sparkSession, "repeat_automata")
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    noted = tables.write(hashed.mapInArrow(
        _facts(length), "doc_id bigint, h1 bigint, h2 bigint, n_words bigint, digest binary, anchors array<bigint>"), "noted")
    # written by itself: a join of two plain scans is split where one text has very many copies
    firsts = tables.write(noted.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").drop("n"), "firsts")
    later = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= length)
    facts = tables.write(noted.join(firsts, ["h1", "h2"], "left").select(
        "doc_id", "h1", "n_words", "digest", F.coalesce(later, F.lit(False)).alias("copy"), "anchors"), "facts")
    tables.drop("noted", "firsts")

    anchors = facts.where(~F.col("copy") & F.col("doc_id").isNotNull()).select("doc_id", F.explode("anchors").alias("a"))
    shared = anchors.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("a")
    marks = anchors.join(shared, "a").groupBy("doc_id").agg(F.collect_set("a").alias("anchors"))
    marked = tables.write(hashed.select("doc_id", "h1", "text").join(marks, "doc_id"), "marked")

    windows = tables.write(marked.mapInArrow(_windows(length), "w bigint, doc_id bigint, pos int"), "windows")
    confirmed = tables.write(windows.groupBy("w").agg(
        F.min(F.struct("doc_id", "pos")).alias("own"), F.max("doc_id").alias("last")).where(F.col("own.doc_id") < F.col("last")).select(
        "w", F.col("own.doc_id").alias("owner"), F.col("own.pos").alias("pos")), "confirmed")
    shards = max(1, math.ceil(confirmed.count() / SHARD_WORDS))
    piece = (F.col("pos") / PIECE).cast("int")
    shard = F.pmod(F.xxhash64("owner", piece), F.lit(shards))
    owned = confirmed.select("owner", "pos", piece.alias("piece"), shard.alias("shard"))
    in_owner = Window.partitionBy("owner", "piece").orderBy("pos")
    runs = owned.withColumn("run", F.col("pos") - F.row_number().over(in_owner)).groupBy("owner", "shard", "run").agg(
        F.min("pos").alias("first"), (F.max("pos") + length).alias("last")).groupBy("owner").agg(
        F.collect_list(F.struct("shard", "first", "last")).alias("runs"))
    passages = marked.select("doc_id", "text").join(runs, F.col("doc_id") == F.col("owner")).select("doc_id", "text", "runs").mapInArrow(
        _passages, "shard bigint, owner bigint, n_words bigint, words binary")

    routes = windows.join(confirmed.select("w", "owner", shard.alias("shard")), "w").where(
        F.col("doc_id") > F.col("owner")).select("doc_id", "shard").distinct()
    routed = tables.write(marked.select("doc_id", "h1", "text").join(routes, "doc_id"), "routed")
    tables.drop("windows")
    # a shard whose passages are in very many documents meets them in as many slices as their bytes ask for
    slices = tables.write(routed.groupBy("shard").agg(
        F.ceil(F.sum(F.octet_length("text")) / SLICE_BYTES).cast("int").alias("slices")), "slices")
    sliced = routed.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("doc_id", "h1"), F.col("slices")).cast("int"))
    dealt = passages.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = dealt.select("shard", "slice", "owner", "words").groupBy("shard", "slice").cogroup(
        sliced.select("shard", "slice", "doc_id", "h1", "text").groupBy("shard", "slice")).applyInArrow(
        _locate(length), "doc_id bigint, h1 bigint, spans array<struct<first:int,last:int>>")
    spans = met.groupBy("doc_id", "h1").agg(F.collect_list("spans").alias("spans"))
    changed = marked.select("doc_id", "h1", "text").join(spans, ["doc_id", "h1"]).mapInArrow(
        _cut, "doc_id bigint, h1 bigint, n_removed bigint, kept string").dropDuplicates(["doc_id", "h1"])
    changed = tables.write(changed, "changed")
    tables.drop("marked", "confirmed", "routed", "slices")
    return facts.drop("anchors"), changed


def repeat_digests(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every document.

    A word is removed when it lies in a window that also starts in a document with a smaller key; windows are
    judged on the input.  Null and empty texts have no words.  A document with a null key neither loses words
    nor makes others lose some.  Rows with equal keys are one document for this rule and never shorten each
    other, while each row is reported.  Columns not named are not read.  An empty table gives an empty result.
    """
    facts, changed = find_repeats(docs, **settings)
    nothing = hashlib.sha256(b"").hexdigest()
    lost = changed.select("doc_id", "h1", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return facts.join(lost, ["doc_id", "h1"], "left").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with every text that has repeated windows cut to its kept words; other rows stay as they are.

    Nulls, repeated rows and empty tables are handled as :func:`repeat_digests` says; a text that is cut has its kept words
    one space apart, a null text stays null.
    """
    facts, changed = find_repeats(docs, text=text, key=key, **settings)
    copies = facts.where("copy").select("doc_id", "h1", F.lit("").alias("kept")).distinct()
    k, h, kept = fresh(docs, "k", "h", "kept")
    new = changed.select("doc_id", "h1", "kept").union(copies).toDF(k, h, kept)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    same = (F.col(f"`{key}`") == F.col(k)) & (F.xxhash64(body) == F.col(h))
    return docs.join(new, same, "left").select(*[
        F.coalesce(F.col(kept), F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
