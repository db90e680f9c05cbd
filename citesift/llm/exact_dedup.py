"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

Documents arrive in batches.  A batch's texts are first grouped among themselves, by the SHA-256 of the text
without white space.  Each distinct digest is then screened by the filters of all earlier snapshots (one filter a
shard of a snapshot, about nine bits a digest, built once and never changed).  Only positives join the snapshots'
exact buckets, where the bytes of both texts decide; whatever no snapshot holds becomes the next snapshot.

The filters lose nothing (they have no false negatives) and the byte check lets nothing wrong through, so the groups
do not depend on how documents fall into batches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm import words as W
from citesift.llm.binary_fuse import Fuse, build
from citesift.llm.shared import Tables

BATCHES = 2
SPACE = b" \t\n\x0b\x0c\r"
# digests of a snapshot that share one filter, and digests that are screened at once
SHARD_KEYS = 1 << 15


def _normal(bits: int, bodies: bool):
    """Per row the digest of the text without white space, its first ``bits`` bits as a word and its code points, or the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in W.blocks(batch, "text"):
                data, cuts = raw.tobytes(), offs.tolist()
                bare = [data[a:b].translate(None, SPACE) for a, b in zip(cuts, cuts[1:])]
                digests = [hashlib.sha256(t).digest() for t in bare]
                word = np.frombuffer(b"".join(d[:8] for d in digests), dtype=">u8").astype(np.uint64) >> np.uint64(64 - bits)
                out = [pa.array(word.view(np.int64)), pa.array(digests, pa.binary())]
                if bodies:
                    yield pa.RecordBatch.from_arrays([*out, pa.array(bare, pa.binary())], names=["word", "digest", "body"])
                    continue
                starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out, pa.array(np.diff(starts[offs]))],
                                                 names=["doc_id", "batch", "word", "digest", "points"])

    return run


def _build(rows: pa.Table) -> pa.Table:
    fuse = build(np.asarray(rows.column("word")).view(np.uint64))
    return pa.table([rows.column("shard")[:1], pa.array([fuse.seed], pa.int64()), pa.array([fuse.bits], pa.int32()),
                     pa.array([fuse.starts], pa.int64()), pa.array([fuse.cells.tobytes()], pa.binary())],
                    names=["shard", "seed", "bits", "starts", "cells"])


def _screen(digests: pa.Table, filters: pa.Table) -> pa.Table:
    """The digests that a shard's filter may hold."""
    if not filters.num_rows or not digests.num_rows:
        return digests.select(["word", "digest"]).slice(0, 0)
    f = filters.to_pylist()[0]
    fuse = Fuse(f["seed"], f["bits"], f["starts"], np.frombuffer(f["cells"], np.uint8))
    hit = fuse.contains(np.asarray(digests.column("word")).view(np.uint64))
    return digests.select(["word", "digest"]).filter(pa.array(hit))


class Snapshot:
    """One immutable batch of distinct texts: exact buckets ``word, digest, body`` and a filter per shard of their words."""

    def __init__(self, number: int, buckets: DataFrame, filters: DataFrame, shards: int):
        self.number, self.buckets, self.filters, self.shards = number, buckets, filters, shards

    @staticmethod
    def write(tables: Tables, number: int, bodies: DataFrame, fresh: DataFrame, rows: int) -> Snapshot:
        """``fresh (word, digest)`` are the ``rows`` digests of ``bodies (word, digest, body)`` that the snapshot takes."""
        shards = max(1, math.ceil(rows / SHARD_KEYS))
        buckets = tables.write(bodies.join(fresh.select("digest"), "digest", "left_semi"), f"buckets{number}")
        filters = fresh.select("word").distinct().withColumn("shard", F.pmod("word", F.lit(shards))).groupBy("shard").applyInArrow(
            _build, "shard bigint, seed bigint, bits int, starts bigint, cells binary")
        return Snapshot(number, buckets, tables.write(filters, f"filters{number}"), shards)

    def screen(self, digests: DataFrame, rows: int) -> DataFrame:
        """The digests among ``digests (word, digest)``, ``rows`` of them, that this snapshot may hold."""
        slices = max(1, math.ceil(rows / (self.shards * SHARD_KEYS)))
        sliced = digests.withColumn("shard", F.pmod("word", F.lit(self.shards))).withColumn(
            "slice", F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int"))
        spread = self.filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return sliced.groupBy("shard", "slice").cogroup(spread.groupBy("shard", "slice")).applyInArrow(
            _screen, "word bigint, digest binary")


def _known(tables: Tables, number: int, snapshots: list[Snapshot], bodies: DataFrame, digests: DataFrame, rows: int) -> DataFrame:
    """``digest, home`` for the batch's digests whose text an earlier snapshot holds, byte by byte."""
    positive = tables.write(reduce(DataFrame.union, [
        s.screen(digests, rows).select("word", "digest", F.lit(s.number).alias("home")) for s in snapshots]), f"positive{number}")
    held = reduce(DataFrame.union, [s.buckets.select(F.lit(s.number).alias("home"), "word", F.col("body").alias("held")) for s in snapshots])
    # only the buckets of positives are read on: their words come with the join
    asked = bodies.join(positive.select("digest", "home"), "digest")
    same = asked.join(held, ["home", "word"]).where(F.col("body") == F.col("held"))
    return tables.write(same.select("digest", "home"), f"known{number}")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", batches: int = BATCHES, bits: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty, and all
    empty texts are one group.  Of equal texts the row with the most code points in its text stays, then
    the smallest key (a null key after all others); of rows that agree in both exactly one is ``kept``.
    ``keep_id`` is the key of that row (null if its key is null).  Columns not named are not read.  An empty
    table gives an empty result.  ``batches`` is how many batches the rows arrive in, by a hash of their key;
    ``bits`` how much of a digest filters and buckets go by.  Neither changes the result.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "exact_dedup")
    given = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(batches)).cast("int").alias("batch"),
                        F.col(f"`{text}`").alias("text"))
    rows = tables.write(given.mapInArrow(_normal(bits, False), "doc_id bigint, batch int, word bigint, digest binary, points bigint").withColumn(
        "row", F.monotonically_increasing_id()), "rows")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    groups = tables.write(rows.groupBy("batch", "word", "digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best")), "groups")
    counts = {r.batch: r.n for r in groups.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}

    snapshots: list[Snapshot] = []
    known = []
    for number in sorted(counts):
        last = number == max(counts)
        digests = groups.where(F.col("batch") == number).select("word", "digest")
        bodies = given.where(F.col("batch") == number).select("text").mapInArrow(
            _normal(bits, True), "word bigint, digest binary, body binary").groupBy("digest").agg(
            F.first("word").alias("word"), F.first("body").alias("body"))
        fresh, n = digests, counts[number]
        if snapshots:
            # read once more for the snapshot, unless this is the last batch
            bodies = bodies if last else tables.write(bodies, f"bodies{number}")
            found = _known(tables, number, snapshots, bodies, digests, n)
            known.append(found.withColumn("batch", F.lit(number)))
            if not last:
                fresh = tables.write(digests.join(found, "digest", "left_anti"), f"fresh{number}")
                n = fresh.count()
        if not last:
            snapshots.append(Snapshot.write(tables, number, bodies, fresh, n))
    homed = groups.withColumn("home", F.col("batch"))
    if known:
        found = reduce(DataFrame.union, known)
        homed = groups.join(found, ["batch", "digest"], "left").withColumn("home", F.coalesce("home", "batch"))
    homed = tables.write(homed.select("batch", "digest", "home", "n", "best"), "homed")
    for s in snapshots:
        tables.drop(*[f"{t}{s.number}" for t in ("buckets", "filters", "bodies", "fresh")])
    whole = homed.groupBy("home", "digest").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    named = tables.write(homed.select("batch", "digest", "home").join(whole, ["home", "digest"]).select(
        F.col("batch").alias("of"), F.col("digest").alias("d"), "group_size", "best"), "named")
    same = (F.col("batch") == F.col("of")) & (F.col("digest") == F.col("d"))
    return rows.join(named, same).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
