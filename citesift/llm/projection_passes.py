"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one item.  In each pass every item gets the concatenated signs of random
projections, the items of a label are ordered by them, and each is compared with a bounded number of
neighbours in that order.  Verified links of all passes are united into components.

Neighbour windows find most of what belongs together but not every pair of a crowded place.  What they leave
open is settled exactly: linked unit vectors differ by at most ``sqrt(2 - 2 cosine)`` along any unit direction, so
a label's items are cut into blocks along one, and every two blocks that are near enough meet once.  There, items
of different components are compared, and only links between components are written out.

Links are counted afterwards inside each component: its items are cut into chunks of bounded size and every two
chunks meet once, so no pair of a component stays uncounted and no pair is written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.llm.components import components
from citesift.llm.shared import Tables
from citesift.llm.vectors import unpack, usable

PASSES = 8
BITS = 48
NEIGHBOURS = 48
CHUNK = 2048
# items of a label that meet as many others in one task when links across components are looked for
BLOCK = 8192
# a block's items are compared so many at a time
SLICE = 1024
# bins along the direction that two linked items lie apart at most
BINS = 4
PART_ROWS = 16_384


def _items(kind: str):
    """Rows with their vector packed; null where it cannot be compared (zero vectors have no direction)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, begin, end = usable(batch.column("v"))
            rows = [None if a < 0 or not np.any(values[a:b]) else (values[a:b] + 0.0).astype(kind).tobytes()
                    for a, b in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(rows, pa.binary()), pa.array((end - begin).astype(np.int32))],
                names=["vec_id", "label", "v", "dim"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very long and very short vectors keep a finite length
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bin_width(cosine: float) -> float:
    """``BINS`` bins are a little wider than linked unit vectors can be apart; a bin is never too narrow to count."""
    return max(math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) / BINS * (1 + 1e-6) + 1e-9, 1 / 256)


def _codes(passes: int, bits: int, seed: int, kind: str, wide: float):
    """Sign patterns as sortable integers, one per pass, and the bin along a further direction.

    Planes and the direction follow from seed, pass and dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            codes = np.zeros((passes, batch.num_rows), dtype=np.int64)
            bins = np.zeros(batch.num_rows, dtype=np.int32)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = [np.random.default_rng((seed, p, d)).standard_normal((d, bits)) for p in range(passes)]
                    planes[d].append(_unit(np.random.default_rng((seed, passes, d)).standard_normal((1, d)))[0])
                at = np.flatnonzero(dims == d)
                x = _unit(unpack(batch.column("v").take(pa.array(at)), kind))
                for p in range(passes):
                    codes[p, at] = ((x @ planes[d][p]) > 0).astype(np.int64) @ weight
                bins[at] = np.floor((x @ planes[d][passes]) / wide)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c) for c in codes], pa.array(bins)],
                names=[*batch.schema.names, *[f"code{p}" for p in range(passes)], "bin"])

    return run


def _roots(x: np.ndarray, group: np.ndarray, width: int, cosine: float) -> np.ndarray:
    """For items in order: the first item of the chain of links that each belongs to.

    An item is compared with the ``width`` items before it that have its label.
    """
    root = np.arange(len(x))
    for a in range(0, len(x), width):
        b, lo = min(a + width, len(x)), max(0, a - width)
        close = (x[a:b] @ x[lo:b].T) >= cosine
        close &= group[a:b, None] == group[None, lo:b]
        for i in np.flatnonzero(close.sum(axis=1) > 1).tolist():
            at = a + i
            near = np.flatnonzero(close[i, max(0, at - width - lo):at - lo]) + max(lo, at - width)
            if len(near):
                heads = np.unique(root[near])
                root[at] = heads[0]
                if len(heads) > 1:
                    root[np.isin(root, heads)] = heads[0]
    return root


def _links(rows: pa.Table, width: int, cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids, dims, label = (np.asarray(rows.column(c)) for c in ("item", "dim", "label"))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        root = _roots(_unit(unpack(rows.column("v").take(pa.array(at)), kind)), label[at], width, cosine)
        own = np.flatnonzero(root != np.arange(len(at)))
        out_a.append(ids[at[own]])
        out_b.append(ids[at[root[own]]])
    return np.concatenate(out_a), np.concatenate(out_b)


WALKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int32()), ("side", pa.int32()), ("n", pa.int32()),
                    ("label", pa.int32()), ("v", pa.binary()), ("dim", pa.int32())])


def _walk(width: int, cosine: float, kind: str):
    """Links inside a sorted partition, streamed batch by batch, and its first and last items for the seams."""

    def seam(rows: pa.Table, number: int, side: int) -> pa.RecordBatch:
        n = rows.num_rows
        rows = rows.combine_chunks()
        at = [rows.column(c).chunk(0) for c in ("item", "label", "v", "dim")]
        return pa.RecordBatch.from_arrays(
            [at[0], pa.nulls(n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array([side] * n, pa.int32()),
             pa.array(range(n), pa.int32()), *at[1:]], schema=WALKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, part, heads = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            part = rows.column("part")[0].as_py()
            if heads < width:
                first = rows.slice(0, width - heads)
                yield seam(first, part, 1)
                heads += first.num_rows
            joined = rows if tail is None else pa.concat_tables([tail, rows])
            a, b = _links(joined, width, cosine, kind)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)] + [pa.nulls(len(a), f.type) for f in list(WALKED)[2:]],
                                             schema=WALKED)
            tail = joined.slice(max(0, joined.num_rows - width))
        if tail is not None:
            yield seam(tail, part + 1, 0)

    return run


def _across(width: int, cosine: float, kind: str):
    """Links between the last items of one sorted partition and the first of the next."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("n", "ascending")]).rename_columns(
            ["item" if c == "a" else c for c in rows.column_names])
        a, b = _links(rows, width, cosine, kind)
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _missed(cosine: float, kind: str):
    """Links between different components of the items at hand; components that a link joins are one from then on."""

    def run(rows: pa.Table) -> pa.Table:
        component, dims, label = (np.asarray(rows.column(c)) for c in ("component", "dim", "label"))
        piece, lo, hi = (np.asarray(rows.column(c)) for c in ("piece", "lo", "hi"))
        order = np.lexsort((dims, label))
        cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
        packed = rows.column("v")
        out: list[tuple[int, int]] = []
        for at in np.split(order, cuts):
            inner = lo[at[0]] == hi[at[0]]
            a = np.arange(len(at)) if inner else np.flatnonzero(piece[at] == lo[at[0]])
            b = a if inner else np.flatnonzero(piece[at] != lo[at[0]])
            own = component[at].copy()
            if not len(a) or not len(b) or own.min() == own.max():
                continue
            x = _unit(unpack(packed.take(pa.array(at)), kind))
            for s in range(0, len(a), SLICE):
                part, rest = a[s:s + SLICE], b[s:] if inner else b
                i, j = np.nonzero(((x[part] @ x[rest].T) >= cosine) & (own[part][:, None] != own[rest][None, :]))
                ends = np.unique(np.stack([own[part[i]], own[rest[j]]], axis=1), axis=0)
                for p, q in _joined(ends):
                    out.append((p, q))
                    own[own == p] = q
        return pa.table([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["a", "b"])

    return run


def _joined(ends: np.ndarray) -> list[tuple[int, int]]:
    """For each node of a few links: the node that stands for its component, where it is another one."""
    parent: dict[int, int] = {}

    def find(p: int) -> int:
        while parent.setdefault(p, p) != p:
            parent[p] = p = parent[parent[p]]
        return p

    for p, q in ends.tolist():
        p, q = find(p), find(q)
        parent[max(p, q)] = min(p, q)
    return [(p, find(p)) for p in list(parent) if find(p) != p]


def _rest(coded: DataFrame, found: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Links (between component ids) of items of different components, wherever they are in their label.

    A label's bins form blocks of about ``BLOCK`` items in their order; a crowded block is cut into pieces by a
    hash.  Every two pieces meet whose blocks hold bins at most ``BINS`` apart.
    """
    group = ["label", "dim"]
    line = Window.partitionBy(*group).orderBy("bin")
    # a label has a bounded number of bins, however many items
    bins = coded.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("block", F.floor(before / BLOCK))
    blocks = bins.groupBy(*group, "block").agg(
        F.min("bin").alias("first"), F.max("bin").alias("last"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("pieces"))
    ahead = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("pieces").over(ahead), F.lit(0)).cast("int"))
    other = blocks.select(*group, *[F.col(c).alias(f"other_{c}") for c in ("first", "last", "pieces", "start")])
    near = (F.col("other_first") - F.col("last") <= BINS) & (F.col("first") - F.col("other_last") <= BINS)
    reach = blocks.join(other, group).groupBy(*group, "block", "pieces", "start").agg(
        F.min(F.when(near, F.col("other_start"))).alias("from"),
        F.max(F.when(near, F.col("other_start") + F.col("other_pieces") - 1)).alias("to"),
        F.sum("other_pieces").alias("whole"))
    placed = bins.select(*group, "bin", "block").join(reach, [*group, "block"])
    bundles = max(1, math.ceil(coded.count() / BLOCK))
    spread = coded.select("item", *group, "bin", "v").join(found, F.col("item") == F.col("node"), "left").join(
        placed, [*group, "bin"]).withColumn("piece", (F.col("start") + F.pmod(F.xxhash64("item"), F.col("pieces"))).cast("int"))
    cells = spread.withColumn("other", F.explode(F.sequence("from", "to"))).select(
        *group, "v", F.coalesce("component", "item").alias("component"), "piece",
        F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"),
        # small labels share a task, a large one has a task for every two pieces
        F.when(F.col("whole") == 1, F.pmod(F.xxhash64(*group), F.lit(bundles))).otherwise(F.xxhash64(*group, F.lit(1))).alias("task"))
    return cells.groupBy("task", "lo", "hi").applyInArrow(lambda t: _missed(cosine, kind)(t), "a bigint, b bigint")


def _count(cosine: float, kind: str):
    """Links of every item with the items of its component that are at hand, weighed by their copies."""

    def run(rows: pa.Table) -> pa.Table:
        component, dims = np.asarray(rows.column("component")), np.asarray(rows.column("dim"))
        item, copies = np.asarray(rows.column("item")), np.asarray(rows.column("copies"))
        chunk, lo, hi = (np.asarray(rows.column(c)) for c in ("chunk", "lo", "hi"))
        order = np.lexsort((dims, component))
        cuts = np.flatnonzero((np.diff(component[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
        packed = rows.column("v")
        out_item, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in np.split(order, cuts):
            x = _unit(unpack(packed.take(pa.array(at)), kind))
            inner = lo[at[0]] == hi[at[0]]
            a = np.arange(len(at)) if inner else np.flatnonzero(chunk[at] == lo[at[0]])
            b = a if inner else np.flatnonzero(chunk[at] != lo[at[0]])
            for s in range(0, len(a), CHUNK):
                part = a[s:s + CHUNK]
                close = (x[part] @ x[b].T) >= cosine
                if inner:
                    close[np.arange(len(part)), part] = False
                else:
                    out_item.append(item[at[b]])
                    out_n.append(close.T @ copies[at[part]])
                out_item.append(item[at[part]])
                out_n.append(close @ copies[at[b]])
        return pa.table([pa.array(np.concatenate(out_item)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["item", "n"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, passes: int = PASSES, bits: int = BITS, neighbours: int = NEIGHBOURS,
                 vector: str = "embedding", key: str = "vec_id", label: str = "label", seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows are linked when their labels are equal and not null and their cosine (in double) is at least
    ``cosine``; null and zero vectors, and those that hold null or non-finite components, link with nothing,
    and neither do vectors of different lengths or rows with a null key.  Rows that repeat are linked with each
    other like any equal vectors.  ``component_id`` is the smallest key that links reach.  Columns not named
    are not read.  An empty table gives an empty result.
    """
    tables = Tables(vectors.sparkSession, "projection_passes")
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    given = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("int").alias("label"),
                           F.col(f"`{vector}`").alias("v"))
    # 128 bits of hash stand for the vector where only equality matters
    rows = tables.write(given.mapInArrow(_items(kind), "vec_id bigint, label int, v binary, dim int").select(
        "*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")), "rows")
    takes_part = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    same = ["label", "h1", "h2"]
    items = rows.where(takes_part).groupBy(*same).agg(
        F.min("vec_id").alias("item"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    schema = "label int, h1 bigint, h2 bigint, item bigint, copies bigint, v binary, dim int"
    coded = tables.write(items.mapInArrow(
        _codes(passes, bits, seed, kind, _bin_width(cosine)),
        schema + "".join(f", code{p} bigint" for p in range(passes)) + ", bin int"), "items")
    parts = max(1, math.ceil(coded.count() / PART_ROWS))

    walked = []
    for p in range(passes):
        order = ["label", "dim", f"code{p}", "item"]
        walked.append(coded.select("item", "label", "v", "dim", f"code{p}").repartitionByRange(parts, *order).sortWithinPartitions(
            *order).withColumn("part", F.spark_partition_id()).mapInArrow(
            _walk(neighbours, cosine, kind), "a bigint, b bigint, seam int, side int, n int, label int, v binary, dim int"
        ).withColumn("pass", F.lit(p)))
    passed = tables.write(reduce(DataFrame.union, walked), "passes")
    seams = passed.where(F.col("seam").isNotNull()).groupBy("pass", "seam").applyInArrow(
        lambda t: _across(neighbours, cosine, kind)(t), "a bigint, b bigint")
    found = tables.write(components(tables, passed.where(F.col("b").isNotNull()).select("a", "b").union(seams)), "found")
    tables.drop("passes")
    missed = tables.write(_rest(coded, found, cosine, kind), "missed")
    if missed.limit(1).count():
        found = tables.write(components(tables, missed.union(found.where("node <> component")), "rest"), "whole")

    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = coded.select("item", "copies", "v", "dim").join(found.join(sizes, "component"), F.col("item") == F.col("node"))
    bundles = max(1, math.ceil(found.count() / CHUNK))
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("item"), chunks).cast("int")
    spread = members.withColumn("chunk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
        "item", "copies", "v", "dim", "component", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
        # small components share a task, a large one has a task for every two chunks
        F.when(chunks == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(F.col("component")).alias("task"))
    counted = spread.groupBy("task", "lo", "hi").applyInArrow(lambda t: _count(cosine, kind)(t), "item bigint, n bigint")
    per_item = counted.groupBy("item").agg(F.sum("n").alias("n"))
    known = coded.select(*same, "item", "copies").join(per_item, "item", "left").join(
        found.withColumnRenamed("node", "item"), "item", "left").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "item").alias("component_id"))
    linked = rows.where(takes_part).select("vec_id", *same).join(known, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
