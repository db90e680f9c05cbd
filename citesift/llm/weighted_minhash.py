"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its runs of ``shingle`` words, each weighed by ``1 + ln(times)`` times a smoothed inverse
document frequency between 1 and 2, so that neither a line repeated within a text nor the copies of a text
decide alone.  Document frequencies are counted over all documents in a table of fixed size
(shingles share its cells by hash, equally for every text), so the model that tasks need has a proven bound.
Consistent weighted samples agree between two texts as often as their weighted Jaccard similarity says; a few
samples together are a band, and texts that share a band are candidates.  Every candidate pair that decides
something is verified by its exact weighted Jaccard similarity.

Equal texts are one node.  In a band's group, the node that meets most others is compared with all of them, which
settles most groups in a number of comparisons that follows their size.  Groups that still hold nodes of
different components then meet in blocks: inside a task, every pair of different components is compared unless
earlier links connect it.  Only links are written out, and no link between components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm import words as W
from citesift.llm.components import components
from citesift.llm.shared import Tables, fresh

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 3
CELL_BITS = 18
SLICE_PAIRS = 128
# nodes of a group that meet in one task
BLOCK = 384

_U = np.uint64
_LEVELS = 1 << 16


def _random_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) values, their logarithms (in another order) and uniform values, indexed by 16 hash bits."""
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, _LEVELS)
    c = rng.gamma(2.0, 1.0, _LEVELS)
    return r, np.log(c), (rng.permutation(_LEVELS) + 0.5) / _LEVELS


def shingles(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, times; sorted by text, then hash.

    A text with fewer words than ``width`` is one shingle; a text without words has none.
    """
    begin, end, first = W.word_bounds(raw, offs)
    hashes = W.word_hashes(raw, begin, end)
    start = np.flatnonzero(W.inside(first, len(hashes), width))
    text = np.searchsorted(first, start, side="right") - 1
    value = W.run_hashes(hashes, width, 1)[start]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = [W.run_hashes(hashes[first[i]:first[i + 1]], int(n[i]), 1)[0] + _U(n[i]) for i in short]
        text, value = np.concatenate([text, short]), np.concatenate([value, np.asarray(whole, dtype=_U)])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def _cells(value: np.ndarray) -> np.ndarray:
    return (W.mix(value) >> _U(64 - CELL_BITS)).astype(np.int64)


def _weights(value: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(times)) * idf[_cells(value)]


def _idf(held: np.ndarray, total: int) -> np.ndarray:
    """Between 1 and 2: a shingle of every document, and one that no other document shares."""
    return 1.0 + np.log1p(total / np.maximum(held, 1)) / math.log1p(max(1, total))


def _frequencies(width: int):
    """Documents per cell, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELL_BITS, np.int64)
        docs = 0
        for batch in batches:
            for part, raw, offs in W.blocks(batch, "text"):
                _, value, _ = shingles(raw, offs, width)
                n += np.bincount(_cells(value), minlength=len(n))
                docs += part.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], docs))], names=["cell", "n"])

    return run


def _signatures(width: int, bands: int, rows: int, shared):
    """Band values of every text; a text without words has none."""
    seeds = [(0x9E3779B97F4A7C15 * (k + 1)) & ((1 << 64) - 1) for k in range(bands * rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        gamma, log_c, uniform = _random_tables()
        for batch in batches:
            for part, raw, offs in W.blocks(batch, "text"):
                text, value, times = shingles(raw, offs, width)
                heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(heads, len(text)))
                log_w = np.log(_weights(value, times, idf))
                out = np.zeros((bands, len(heads)), dtype=_U)
                for k, seed in enumerate(seeds if len(heads) else ()):
                    x = W.mix(value ^ _U(seed))
                    r = gamma[(x & _U(0xFFFF)).astype(np.int64)]
                    beta = uniform[((x >> _U(16)) & _U(0xFFFF)).astype(np.int64)]
                    step = np.floor(log_w / r + beta)
                    log_a = log_c[((x >> _U(32)) & _U(0xFFFF)).astype(np.int64)] - r * (step + 1 - beta)
                    low = np.minimum.reduceat(log_a, heads)
                    at = np.flatnonzero(log_a == np.repeat(low, sizes))
                    # of equal values the first, that is the smallest shingle
                    at = at[np.searchsorted(at, heads)]
                    sample = W.mix(x[at] + step[at].astype(np.int64).view(_U) * _U(0xC2B2AE3D27D4EB4F))
                    out[k // rows] = W.mix(out[k // rows] * _U(31) + sample + _U(k))
                kept = text[heads]
                stops = np.searchsorted(kept, np.arange(part.num_rows + 1)) * bands
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h1"), part.column("h2"), pa.ListArray.from_arrays(
                        pa.array(stops.astype(np.int32)), pa.array(np.ascontiguousarray(out.T).reshape(-1).view(np.int64)))],
                    names=["doc_id", "h1", "h2", "bands"])

    return run


class _Sets:
    """Weighted sets of texts, and whether two of them are similar enough."""

    def __init__(self, width: int, similar: float, idf: np.ndarray):
        self.width, self.similar, self.idf = width, similar, idf

    def of(self, body: bytes) -> tuple[np.ndarray, np.ndarray, float]:
        _, value, times = shingles(np.frombuffer(body, dtype=np.uint8), np.array([0, len(body)]), self.width)
        weight = _weights(value, times, self.idf)
        return value, weight, float(weight.sum())

    def alike(self, a: tuple, b: tuple) -> bool:
        (x, wx, sum_x), (y, wy, sum_y) = a, b
        if min(sum_x, sum_y) < self.similar * max(sum_x, sum_y) * (1 - 1e-9):
            return False
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        both = x[at] == y
        inner = float(np.minimum(wx[at[both]], wy[both]).sum())
        return inner >= self.similar * (sum_x + sum_y - inner) * (1 - 1e-12)


def _verify(width: int, similar: float, shared):
    """The pairs (leader, node) whose weighted Jaccard similarity is high enough."""

    def run(rows: pa.Table) -> pa.Table:
        sets = _Sets(width, similar, shared.value)
        leader, node = rows.column("a").to_pylist(), rows.column("b").to_pylist()
        text = rows.column("text").cast(pa.binary()).to_pylist()
        known = {a: sets.of(body) for a, b, body in zip(leader, node, text) if b is None}
        good = [(a, b) for a, b, body in zip(leader, node, text) if b is not None and sets.alike(known[a], sets.of(body))]
        return pa.table([pa.array([a for a, _ in good], pa.int64()), pa.array([b for _, b in good], pa.int64())], names=["a", "b"])

    return run


def _settle(width: int, similar: float, shared):
    """Links between nodes of different components that meet in a cell of a group.

    A pair is compared in the first band that both share.  Nodes that a link has joined are not compared
    again, neither with each other nor with others of their components.
    """

    def run(rows: pa.Table) -> pa.Table:
        sets = _Sets(width, similar, shared.value)
        v, node, comp, band, block, lo, hi = (np.asarray(rows.column(c)) for c in ("v", "node", "c", "band", "block", "lo", "hi"))
        bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(len(v), -1)
        text = rows.column("text")
        known: dict[int, tuple] = {}

        def of(i: int) -> tuple:
            if int(node[i]) not in known:
                known[int(node[i])] = sets.of(text[i].as_py().encode("utf-8"))
            return known[int(node[i])]

        out: list[tuple[int, int]] = []
        order = np.lexsort((node, v))
        for at in np.split(order, np.flatnonzero(np.diff(v[order])) + 1):
            label = comp[at].copy()
            inner = lo[at[0]] == hi[at[0]]
            left = np.arange(len(at)) if inner else np.flatnonzero(block[at] == lo[at[0]])
            for i in left.tolist():
                first = np.argmax(bands[at] == bands[at[i]], axis=1) == band[at[i]]
                other = np.arange(len(at)) > i if inner else block[at] != lo[at[0]]
                open_ones = np.flatnonzero(first & other & (label != label[i]))
                while len(open_ones):
                    j, open_ones = int(open_ones[0]), open_ones[1:]
                    if sets.alike(of(at[i]), of(at[j])):
                        out.append((int(node[at[i]]), int(node[at[j]])))
                        label[label == label[j]] = label[i]
                        open_ones = open_ones[label[open_ones] != label[i]]
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def near_texts(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id",
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, h1, class_id, kept, component`` for every row; ``h1`` is a hash of the text.

    ``component`` is one value per class (the smallest ``h1`` of its texts), also where keys are null or shared by
    several classes and ``class_id`` cannot tell them apart.  Texts belong to one class when links of weighted Jaccard similarity ``similar`` or more connect them; equal
    texts always do.  ``class_id`` is the smallest key of the class and ``kept`` marks its rows.  A text without
    words (null, empty, white space) is in a class of its own and kept.  Null keys count for nothing; a class
    that has only null keys has a null ``class_id`` and its rows are kept.  Rows that repeat a kept key and
    text are all marked.  Columns not named are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "weighted_minhash")
    given = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashed = given.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")

    counts = given.select("text").mapInArrow(_frequencies(shingle), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    # at most 2**CELL_BITS rows
    table = counts.toArrow()
    cell, n = np.asarray(table.column("cell")), np.asarray(table.column("n"))
    total = int(n[cell < 0].sum())
    held = np.zeros(1 << CELL_BITS, dtype=np.float64)
    held[cell[cell >= 0]] = n[cell >= 0]
    shared = spark.sparkContext.broadcast(_idf(held, max(1, total)))

    signed = tables.write(hashed.mapInArrow(
        _signatures(shingle, bands, rows, shared), "doc_id bigint, h1 bigint, h2 bigint, bands array<bigint>"), "signed")
    nodes = tables.write(signed.where(F.size("bands") > 0).groupBy("h1", "h2").agg(F.first("bands").alias("bands")).select(
        F.col("h1").alias("node"), "bands"), "nodes")
    # written by themselves: a join of two plain scans is split where a value is in very many texts
    banded = tables.write(nodes.select("node", F.posexplode("bands").alias("band", "value")).select(
        "node", "band", F.xxhash64("band", "value").alias("v")), "banded")
    crowded = tables.write(banded.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "crowded")
    group = tables.write(banded.join(crowded, "v"), "group")
    tables.drop("banded", "crowded")
    wanted = group.select(F.col("node").alias("h1")).distinct()
    # a partition sends each of its texts once, however many copies it holds; then texts always move by a merge join: the
    # plan, and what it shuffles, is the same at every size
    once = hashed.select("h1", "text").groupBy("h1").agg(F.first("text").alias("text"))
    texts = tables.write(once.join(wanted.hint("merge"), "h1"), "texts")

    # the node with most company leads its groups: of copies of one text most likely the text itself
    company = group.groupBy("node").agg(F.sum("size").alias("company"))
    leaders = tables.write(group.join(company, "node").groupBy("v").agg(F.max(F.struct("company", "node")).alias("x")).select(
        "v", F.col("x.node").alias("a")), "leaders")
    pairs = tables.write(group.select("v", F.col("node").alias("b")).join(leaders, "v").where("a <> b").select("a", "b").distinct(), "pairs")
    links = tables.write(_checked(pairs, texts, shingle, similar, shared), "led")
    found = tables.write(components(tables, links, "stars0_"), "found0")
    settled = _settled(tables, group, leaders, found, nodes, texts, shingle, similar, shared)
    links = tables.write(settled.union(found.where("node <> component")), "links")
    found = tables.write(components(tables, links, "stars1_"), "found1")
    tables.drop("texts", "group", "leaders", "pairs", "led", "found0", "links", "nodes")

    known = found.withColumnRenamed("node", "h1")
    rows_of = signed.select("doc_id", "h1", "h2", (F.size("bands") > 0).alias("full"))
    # the smallest key of each text first, then of each component: no step gathers a class
    per_text = rows_of.where("full").groupBy("h1").agg(F.min("doc_id").alias("least"))
    per_text = per_text.join(known, "h1", "left").select("h1", F.coalesce("component", "h1").alias("component"), "least")
    classes = per_text.groupBy("component").agg(F.min("least").alias("class_id"))
    named = per_text.join(classes, "component").select("h1", "class_id", "component")
    full = rows_of.where("full").join(named, "h1").select(
        "doc_id", "h1", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "component")
    # a text without words meets no other: its rows have no component
    bare = rows_of.where("not full").select(
        "doc_id", "h1", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), F.lit(None).cast("bigint").alias("component"))
    return full.union(bare)


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, similar: float, shared) -> DataFrame:
    """Verified pairs.  A leader's pairs are cut into slices, so a leader of very many meets them in many tasks."""
    per_leader = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE_PAIRS).cast("int").alias("slices"))
    bundles = max(1, math.ceil(pairs.count() / SLICE_PAIRS))
    slot = F.pmod(F.xxhash64("a", "slice"), F.lit(bundles)).alias("slot")
    sides = pairs.join(per_leader, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
    members = sides.hint("merge").join(texts.withColumnRenamed("h1", "b"), "b").select(slot, "a", "b", "text")
    heads = per_leader.hint("merge").join(texts.withColumnRenamed("h1", "a"), "a").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(slot, "a", F.lit(None).cast("bigint").alias("b"), "text")
    return members.union(heads).groupBy("slot").applyInArrow(
        lambda t: _verify(shingle, similar, shared)(t.select(["a", "b", "text"])), "a bigint, b bigint")


def _settled(tables: Tables, group: DataFrame, leaders: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame,
             shingle: int, similar: float, shared) -> DataFrame:
    """Links in groups whose nodes besides the leader are in different components.

    Nodes of the leader's component need no comparison with each other: they form blocks of their own that
    meet only the blocks of other nodes.
    """
    ends = found.select("node", F.col("component").alias("c"))
    lead = leaders.join(ends, F.col("a") == F.col("node"), "left").select("v", "a", F.coalesce("c", "a").alias("main"))
    rest = tables.write(group.select("v", "band", "node").join(lead, "v").where("node <> a").join(ends, "node", "left").select(
        "v", "band", "node", F.coalesce("c", "node").alias("c"), "main"), "rest")
    outside = F.col("c") != F.col("main")
    open_groups = tables.write(rest.groupBy("v").agg(
        F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("n"), F.sum(outside.cast("int")).alias("apart")).where(
        "x < y").select("v", "n", F.ceil(F.col("apart") / BLOCK).cast("int").alias("free"),
                        F.ceil((F.col("n") - F.col("apart")) / BLOCK).cast("int").alias("joined")), "open")
    whole = F.col("n") <= BLOCK
    mine = F.when(whole, 0).when(outside, F.pmod(F.xxhash64("node"), F.col("free"))).otherwise(
        F.col("free") + F.pmod(F.xxhash64("node"), F.col("joined"))).cast("int")
    last = F.when(whole, 0).when(outside, F.col("free") + F.col("joined") - 1).otherwise(F.col("free") - 1).cast("int")
    cells = rest.join(open_groups, "v").withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    bundles = max(1, math.ceil(open_groups.agg(F.sum(F.least("n", F.lit(BLOCK)))).first()[0] or 0) // BLOCK + 1)
    cells = cells.select("v", "band", "node", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                         F.when(whole, F.pmod(F.xxhash64("v"), F.lit(bundles))).otherwise(F.xxhash64("v", F.lit(1))).alias("task"))
    full = cells.hint("merge").join(nodes, "node").join(texts.withColumnRenamed("h1", "node").hint("merge"), "node")
    return full.groupBy("task", "lo", "hi").applyInArrow(lambda t: _settle(shingle, similar, shared)(t), "a bigint, b bigint")


def drop_near_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates and all its columns.

    The row with the smallest key stays, null keys last, and of those the one with the smallest text hash.  All
    rows without words stay.
    """
    classes = near_texts(docs, text=text, key=key, **settings)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = body.rlike(r"[^\x20\x09-\x0D]")
    # by component: neither a null key nor one that unrelated texts share names a class
    least, own = fresh(docs, "least", "own")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1")).alias("first")
    stay = classes.where(F.col("component").isNotNull()).groupBy("component").agg(first).select(
        F.col("first.doc_id").alias(least), F.col("first.h1").alias(own))
    same = F.col(f"`{key}`").eqNullSafe(F.col(least)) & (F.xxhash64(body) == F.col(own))
    # a text is in one component, so rows that share its hash are copies of the row that stays
    kept = docs.where(words).join(stay, same).dropDuplicates([own]).drop(least, own)
    return kept.unionByName(docs.where(~words))
