"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

Every group of equal texts is one point: its weight is the bytes of all its copies, its coordinates are
length, source and language.  A node that must hold several shards is split along its widest coordinate
where the weight on the left reaches the left shards' bytes; leaves are the shards.  The weighted median is
found by two histograms of fixed size (bins of the coordinate, then bins of the text hash inside the bin that
holds the median), so every pass is one partially aggregated sum and the driver sees a constant number of bins.

A group above 1/64 of a shard would tip a median, so these few (at most 64 per shard by construction) are
placed whole on the least loaded shards first and the tree fills what is left.  A group larger than one shard
is cut by the hash of its rows; every smaller group stays in one shard.

Rows that agree in key and text are counted, not carried: they are an item, cut into parts of a bounded number of rows,
and parts are what is hashed.  So a null key, or one row that repeats very often, is cut like any other.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.llm.shared import Tables

BINS = 1024
HASH_BINS = 4096
LARGE = 64
SLOT_ROWS = 4000
# most rows of a part of an item, and most parts of an item
PART_ROWS, PARTS = 256, 1 << 16
AXES = ("x_length", "x_source", "x_lang")


def _unit(col: Column) -> Column:
    """A string's place in [0, 1) by its CRC-32; null is an own place."""
    return F.coalesce(F.crc32(col.cast("binary")) / F.lit(2.0 ** 32), F.lit(1.0))


def _bin(axis: str, lo: float, hi: float) -> Column:
    width = hi - lo
    if width <= 0:
        return F.lit(0)
    return F.least(F.greatest(F.floor((F.col(axis) - F.lit(lo)) * F.lit(BINS / width)), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _hash_bin() -> Column:
    return F.pmod(F.col("t"), F.lit(HASH_BINS)).cast("int")


def _cut(sums: dict[int, float], goal: float) -> tuple[int, float]:
    """The first bin at which the running sum passes ``goal``, and the sum before it."""
    before = 0.0
    for b in sorted(sums):
        if before + sums[b] > goal:
            return b, before
        before += sums[b]
    return (max(sums) + 1 if sums else 0), before


def _split_level(points: DataFrame, nodes: dict[int, int], room: list[float]) -> tuple[Column, Column, dict[int, int]]:
    """Split every node that holds several shards once.

    ``nodes`` maps a node, named by its first shard, to the shard after its last.  Returns a point's bin, its new node
    (given the bin) and the new nodes.
    """
    open_nodes = {k: end for k, end in nodes.items() if end - k > 1}
    inner = points.where(F.col("node").isin(list(open_nodes)))
    seen = inner.groupBy("node").agg(
        F.sum("w").alias("w"), *[f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("lo", F.min), ("hi", F.max))])
    plan, pick = {}, F.when(F.lit(False), F.lit(0))
    for r in seen.collect():
        k, end = r.node, open_nodes[r.node]
        mid = (k + end) // 2
        axis = max(AXES, key=lambda a: r[f"hi_{a}"] - r[f"lo_{a}"])
        total = sum(room[k:end])
        goal = r.w * (sum(room[k:mid]) / total if total > 0 else (mid - k) / (end - k))
        plan[k] = (mid, goal)
        pick = pick.when(F.col("node") == k, _bin(axis, r[f"lo_{axis}"], r[f"hi_{axis}"]))
    binned = inner.withColumn("bin", pick)
    sums: dict[int, dict[int, float]] = {k: {} for k in plan}
    for r in binned.groupBy("node", "bin").agg(F.sum("w").alias("w")).collect():
        sums[r.node][r.bin] = r.w
    cut = {k: _cut(sums[k], goal) for k, (_, goal) in plan.items()}
    at = F.when(F.lit(False), F.lit(0))
    for k, (b, _) in cut.items():
        at = at.when(F.col("node") == k, F.lit(b))
    fine: dict[int, dict[int, float]] = {k: {} for k in plan}
    for r in binned.where(F.col("bin") == at).groupBy("node", _hash_bin().alias("h")).agg(F.sum("w").alias("w")).collect():
        fine[r.node][r.h] = r.w
    after = {k: end for k, end in nodes.items() if k not in open_nodes}
    moved = F.when(F.lit(False), F.lit(0))
    for k, (mid, goal) in plan.items():
        b, before = cut[k]
        h, reached = _cut(fine[k], goal - before)
        # the hash bin that holds the median goes to the side it fits better
        if fine[k].get(h, 0.0) / 2 <= goal - before - reached:
            h += 1
        right = (F.col("node") == k) & ((F.col("bin") > b) | ((F.col("bin") == b) & (_hash_bin() >= h)))
        moved = moved.when(right, F.lit(mid))
        after[k], after[mid] = mid, open_nodes[k]
    # a node without points needs no further splits
    return pick, moved.otherwise(F.col("node")), after


def _place_large(large: list, shards: int, fair: float) -> tuple[dict, list[float]]:
    """Least loaded shard first, largest piece first; returns the shard of each piece and the room left."""
    heap = [(0.0, s) for s in range(shards)]
    where = {}
    for key, w in sorted(large, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        where[key] = s
        heapq.heappush(heap, (load + w, s))
    room = [0.0] * shards
    for load, s in heap:
        room[s] = max(0.0, fair - load)
    return where, room


def kd_shards(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", source: str = "source",
              lang: str = "lang") -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``law`` (``bytes``), ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 8; a null text has no bytes and counts as an equal of the empty
    text (checksum 0).  Null sources and languages are a place of their own; null or repeated keys are rows
    like others; where many rows agree in key and text, as many of them as need be go to other shards.  ``slot``
    numbers each shard's rows from 0 without gaps, by a hash of key and checksum, then key.  Only the four named columns are read, so further columns cannot clash.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "kd_shards")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = tables.write(docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("t"),
        F.col(f"`{source}`").alias("s"), F.col(f"`{lang}`").alias("l")).groupBy("doc_id", "size", "text_crc32", "t").agg(
        F.count(F.lit(1)).alias("rows"), F.min("s").alias("s"), F.min("l").alias("l")), "rows")
    same = ["text_crc32", "t", "size"]
    weight = F.col("size") * F.col("rows")
    totals = rows.agg(F.sum("rows").alias("n"), F.sum(weight).alias("bytes")).first()
    n_rows, fair = totals.n or 0, (totals.bytes or 0) / shards
    # no part is above a small share of a shard, however long its text
    bound = F.least(F.lit(PART_ROWS), F.greatest(F.lit(1), F.floor(F.lit(fair / PART_ROWS) / F.col("size"))))
    step = F.greatest(bound, F.ceil(F.col("rows") / PARTS)).cast("bigint")
    parts = rows.withColumn("step", step).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / F.col("step"))))).withColumn(
        "rows", F.least("step", F.col("rows") - F.col("part") * F.col("step"))).drop("step")
    groups = tables.write(rows.groupBy(*same).agg(
        F.sum(weight).alias("w"), F.min("s").alias("s"), F.min("l").alias("l")).select(
        *same, "w", (F.log2(F.col("size").cast("double")) / 40).alias("x_length"), _unit(F.col("s")).alias("x_source"),
        _unit(F.col("l")).alias("x_lang")), "groups")

    is_large = F.col("w") > F.lit(fair / LARGE)
    cuts = F.when(F.col("w") > F.lit(fair), F.ceil(F.col("w") / F.lit(max(fair, 1.0) / 4))).otherwise(F.lit(1)).cast("int")
    large = groups.where(is_large).select(*same, "w", cuts.alias("cuts"))
    pieces = [((r.text_crc32, r.t, r.size, 0), float(r.w)) for r in large.where("cuts = 1").collect()]
    # fewer groups than shards are above a shard's share, and each is cut into about four pieces a share
    piece = F.pmod(F.xxhash64("doc_id", "part"), F.col("cuts")).cast("int")
    parted = parts.join(F.broadcast(large.where("cuts > 1")), same).groupBy(*same, piece.alias("piece")).agg(F.sum(weight).alias("w"))
    pieces += [((r.text_crc32, r.t, r.size, r.piece), float(r.w)) for r in parted.collect()]
    n_cuts = {(r.text_crc32, r.t, r.size): r.cuts for r in large.collect()}
    where, room = _place_large(pieces, shards, fair)

    small = groups.where(~is_large).withColumn("node", F.lit(0))
    nodes, level = {0: shards}, 0
    while any(end - k > 1 for k, end in nodes.items()):
        pick, moved, nodes = _split_level(small, nodes, room)
        small = tables.write(small.withColumn("bin", pick).withColumn("node", moved).drop("bin"), f"level{level}")
        level += 1

    placed = small.select(*same, F.col("node").alias("shard"), F.lit(1).alias("cuts"), F.lit(0).alias("piece"))
    if where:
        placed = placed.unionByName(spark.createDataFrame(
            [(*k[:3], s, n_cuts[k[:3]], k[3]) for k, s in where.items()],
            "text_crc32 bigint, t bigint, size bigint, shard int, cuts int, piece int"))
    buckets = max(1, math.ceil(n_rows / (shards * SLOT_ROWS)))
    assigned = tables.write(parts.join(placed, same).where(piece == F.col("piece")).select(
        "doc_id", "size", "text_crc32", "shard", "part", "rows",
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "part"), F.lit(buckets)).alias("bucket")), "assigned")
    tables.drop("rows", "groups", *[f"level{n}" for n in range(level)])

    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = assigned.groupBy("shard", "bucket").agg(F.sum("rows").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.col("before") + F.coalesce(F.sum("rows").over(inside), F.lit(0))
    return assigned.join(before, ["shard", "bucket"]).withColumn("slot", slot).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.explode(F.sequence("slot", F.col("slot") + F.col("rows") - 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
