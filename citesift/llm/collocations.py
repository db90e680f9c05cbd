"""Phrase collocations from sorted count streams.

Words, word pairs and word triples are counted over all documents; only those that reach ``least`` occurrences go on, and a
longer phrase is counted only where its shorter parts do.  All counts of a language then form one stream, which is
kept twice: in prefix order (by first word, then second, then third) and in suffix order (by last word, then the one
before).  In either order a phrase directly follows its parts, so one pass over the stream, in lockstep, hands
every phrase the counts of its parts and every pair the largest count among the triples that extend it: no hash
table, no join.  Ranges cut the stream anywhere, also inside a very common word; what crosses a cut is carried
over by one row a range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.llm import words as W
from citesift.llm.ranges import range_of
from citesift.llm.shared import Tables

LEAST = 10
MOST = 2000
BREAKS = b".,;:!?\n\x0b\x0c\r"
# a block's arrays take about forty times its bytes
BLOCK = 512 << 10
# bits of the table that says which phrases may be common enough: 16 MB at most
TABLE_BITS = (16, 27)
EMIT_ROWS = 1 << 15

_U = np.uint64
_BREAK = 0x0A
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[0x09] = 0x20
_MAP[list(BREAKS)] = _BREAK


def _language(name: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(name.encode("utf-8"), digest_size=8).digest(), "little"))


def _cut(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block as it is, or a very long text in slices that end at breaks, over which no phrase reaches."""
    if len(raw) <= 2 * BLOCK or len(offs) > 2:
        yield raw, offs
        return
    at = np.flatnonzero(_MAP[raw] == _BREAK)
    start = 0
    while start < len(raw):
        k = np.searchsorted(at, start + BLOCK)
        stop = int(at[k]) + 1 if k < len(at) else len(raw)
        yield raw[start:stop], np.array([0, stop - start])
        start = stop


class _Words:
    """The words of a block, one space apart, and which of them follow each other within a piece."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, languages: np.ndarray):
        low = _MAP[raw]
        begin, end, first = W.word_bounds(low, offs)
        n = len(begin)
        sizes = end - begin
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        self.stop = self.start + sizes
        self.text = np.full(int(sizes.sum()) + n, 0x20, np.uint8)
        at = np.arange(int(sizes.sum()))
        self.text[at + np.repeat(np.arange(n), sizes)] = low[at + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)]
        passed = np.cumsum(low == _BREAK)
        self.follows = np.zeros(n, bool)
        if n:
            self.follows[:-1] = passed[begin[1:]] == passed[end[:-1] - 1]
            cuts = first[1:-1]
            self.follows[cuts[(cuts > 0) & (cuts < n)] - 1] = False
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        self.language = languages[self.doc]

    def keys(self, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """A 64-bit hash of language and phrase for the phrases of ``k`` words that start at the words ``at``."""
        return phrase_keys(self.text, self.start[at], self.stop[at + k - 1], self.language[at], which)


def phrase_keys(text: np.ndarray, start: np.ndarray, stop: np.ndarray, language: np.ndarray, which: int = 0) -> np.ndarray:
    return W.mix(W.word_hashes(text, start, stop, which) + language)


def _maybe(table: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if table is None:
        return np.ones(len(keys), bool)
    bits = (len(table) * 8).bit_length() - 1
    cell = (keys >> _U(64 - bits)).astype(np.int64)
    return (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _count(k: int, shared):
    """Distinct phrases of ``k`` words of each block, with their counts; those whose parts cannot be common are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value if shared is not None else None
        for batch in batches:
            for part, raw, offs in W.blocks(batch, "text", BLOCK):
                names = part.column("lang").dictionary_encode()
                values = names.dictionary
                codes = names.indices.to_numpy()
                hashed = np.array([_language(v) for v in values.to_pylist()], dtype=_U)
                for piece, bounds in _cut(raw, offs):
                    # a slice of a long text is of the only row there is
                    yield from _distinct(_Words(piece, bounds, hashed[codes]), k, table, values, codes)

    return run


def _distinct(words: _Words, k: int, table: np.ndarray | None, values: pa.Array, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    good = np.ones(max(0, len(words.start) - k + 1), bool)
    for back in range(k - 1):
        good &= words.follows[back:back + len(good)]
    if k > 1:
        # every part one word shorter, wherever one starts
        ok = np.ones(max(0, len(words.start) - k + 2), bool)
        for back in range(k - 2):
            ok &= words.follows[back:back + len(ok)]
        at = np.flatnonzero(ok)
        ok[at] = _maybe(table, words.keys(at, k - 1))
        good &= ok[:-1] & ok[1:]
    at = np.flatnonzero(good)
    if not len(at):
        return
    key, other = words.keys(at, k), words.keys(at, k, 2)
    order = np.argsort(key, kind="stable")
    if (other[order][1:] != other[order][:-1])[key[order][1:] == key[order][:-1]].any():
        order = np.lexsort((other, key))
    new = np.ones(len(at), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(at)))
    rep = at[order[heads]]
    start, stop = words.start[rep], words.stop[rep + k - 1]
    for a in range(0, len(rep), EMIT_ROWS):
        s, e = start[a:a + EMIT_ROWS], stop[a:a + EMIT_ROWS]
        sizes = e - s
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        data = words.text[np.arange(cuts[-1]) + np.repeat(s - cuts[:-1], sizes)]
        phrases = pa.StringArray.from_buffers(len(s), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
        langs = values.take(pa.array(codes[words.doc[rep[a:a + EMIT_ROWS]]]))
        yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(times[a:a + EMIT_ROWS])], names=["lang", "phrase", "n"])


def _cells(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            hashed = np.array([_language(v) for v in names.dictionary.to_pylist()], dtype=_U)
            raw, offs = W.text_buffer(batch.column("phrase"))
            key = phrase_keys(raw, offs[:-1], offs[1:], hashed[names.indices.to_numpy()])
            cell = np.unique((key >> _U(64 - bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cell >> 16), pa.array((cell & 0xFFFF).astype(np.int32))], names=["part", "cell"])

    return run


def _bits(rows: pa.Table) -> pa.Table:
    flags = np.zeros(1 << 16, np.uint8)
    flags[np.asarray(rows.column("cell"))] = 1
    return pa.table([rows.column("part")[:1], pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])


def _common(phrases: DataFrame):
    """A broadcast table of bits that has one for every phrase of ``phrases (lang, phrase)``.

    Its size follows their number and stops at 16 MB; where phrases are so many that nearly all bits are
    set, it only spares less.
    """
    n = phrases.count()
    bits = min(max(TABLE_BITS[0], int(n * 16).bit_length()), TABLE_BITS[1])
    parts = phrases.mapInArrow(_cells(bits), "part bigint, cell int").distinct().groupBy("part").applyInArrow(
        _bits, "part bigint, bits binary")
    table = np.zeros((1 << bits - 16, 1 << 13), np.uint8)
    # at most 2048 rows of 8 kB
    for r in parts.collect():
        table[r.part] = np.frombuffer(r.bits, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(table.reshape(-1))


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: every row with the counts of the last one-word and two-word row before it (itself included) and, for
    pairs, the largest count of the triples right after it.  Last comes a row with ``k`` 0 for the range's edges."""
    f1 = f2 = None
    lead, pending, ext, tag = 0, None, 0, None

    def out(batch: pa.RecordBatch, one, two, most, tail: bool) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(most, pa.int64()), pa.array([tail] * n)],
            names=[*batch.schema.names, "one", "two", "most", "tail"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k, f = np.asarray(batch.column("k")), np.asarray(batch.column("f"))
        tag = batch.column("tag")[0].as_py() if tag is None else tag
        at = np.arange(n)

        def before(mask: np.ndarray, held) -> tuple[np.ndarray, np.ndarray]:
            last = np.maximum.accumulate(np.where(mask, at, -1))
            value = np.where(last >= 0, f[last], -1 if held is None else held)
            return value, value < 0

        one, no_one = before(k == 1, f1)
        two, no_two = before(k == 2, f2)
        f1, f2 = (None if no_one[-1] else int(one[-1])), (None if no_two[-1] else int(two[-1]))
        heads = np.flatnonzero(k < 3)
        most = np.zeros(n, np.int64)
        early = int(f[:heads[0]].max(initial=0)) if len(heads) else int(f.max(initial=0))
        if pending is None:
            lead = max(lead, early)
        else:
            ext = max(ext, early)
        if len(heads):
            triples = np.where(k == 3, f, 0)
            most[heads] = np.maximum.reduceat(triples, heads)
            if pending is not None:
                yield out(pending[0], pending[1], pending[2], [ext], False)
            last = int(heads[-1])
            # the last head waits: its triples may go on in the next batch
            pending = (batch.slice(last, 1), pa.array([int(one[last])], mask=no_one[last:last + 1]),
                       pa.array([int(two[last])], mask=no_two[last:last + 1]))
            ext = int(most[last])
            rest = at != last
        else:
            rest = np.ones(n, bool)
        kept = batch.filter(pa.array(rest))
        yield out(kept, pa.array(one[rest], mask=no_one[rest]), pa.array(two[rest], mask=no_two[rest]), most[rest], False)
    if pending is not None:
        yield out(pending[0], pending[1], pending[2], [ext], True)
    if tag is not None:
        edge = {"k": 0, "f": lead, "tag": tag}
        row = pa.RecordBatch.from_arrays([pa.array([edge.get(c.name)], c.type) for c in batch.schema], names=batch.schema.names)
        yield out(row, [f1], [f2], [int(pending is not None)], False)


def _merged(tables: Tables, rows: DataFrame, order: list[Column], one: str, two: str, most: str, name: str) -> DataFrame:
    """``rows`` (with ``k`` and ``f``) in the order ``order``, merged in lockstep: the counts of the first word and the first two
    words in that order, and the largest count of a triple that starts with a pair."""
    keys = [f"_{i}" for i in range(len(order))]
    sorted_rows = rows.select("*", *[c.alias(k) for c, k in zip(order, keys)]).repartitionByRange(*keys).sortWithinPartitions(
        *keys).drop(*keys).withColumn("tag", F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    met = tables.write(sorted_rows.mapInArrow(
        _lockstep, f"{fields}, one bigint, two bigint, most bigint, tail boolean"), name)
    # what crosses a cut: four numbers a range, and no more ranges than shuffle partitions
    part = range_of("tag")
    edges = sorted(map(tuple, met.where("k = 0").select(part, "f", "one", "two", "most").collect()))
    carried, first, second = [], None, None
    for at, _, f1, f2, _ in edges:
        carried.append([at, first, second, 0])
        first, second = f1 if f1 is not None else first, f2 if f2 is not None else second
    late = 0
    for row, (_, lead, _, _, heads) in zip(reversed(carried), reversed(edges)):
        # triples that lead a range belong to the last head before it
        row[3] = late
        late = lead if heads else max(late, lead)
    carried = rows.sparkSession.createDataFrame(carried, "at bigint, c1 bigint, c2 bigint, late bigint")
    return met.where("k > 0").join(F.broadcast(carried), part == F.col("at")).select(
        *rows.columns, F.coalesce("one", "c1").alias(one), F.coalesce("two", "c2").alias(two),
        F.when(F.col("tail"), F.greatest("most", "late")).otherwise(F.col("most")).alias(most))


def _leading(tables: Tables, rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each language; many rows compete in groups of bounded size first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for step in range(64):
        largest = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= 10 * most:
            break
        heat = F.pmod(F.xxhash64("phrase"), F.lit(math.ceil(largest / (10 * most))))
        rows = rows.withColumn("heat", heat).withColumn(
            "rank", F.row_number().over(Window.partitionBy("lang", "heat").orderBy(*order))).where(F.col("rank") <= most)
        rows = tables.write(rows.drop("heat", "rank"), f"leading{step}")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``most`` phrases of two or three words.

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words at spaces and tabs;
    ``n`` counts a language's words and ``a`` a phrase's occurrences within pieces, ``least`` at least.  Cut after its
    first words, a phrase has the parts' counts ``l`` and ``r`` and scores ``floor(1000000 a a / (l r))``; the cut with the
    lowest score counts, of ties the first.  A pair with half of its occurrences or more in one triple is left out.

    Null texts are empty; a null language is ``und``.  Equal rows count each for themselves, keys are not read, nor
    are columns not named.  An empty table, and one without phrases, gives an empty result.
    """
    tables = Tables(docs.sparkSession, "collocations")
    given = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))

    def counted(k: int, shared) -> DataFrame:
        return given.mapInArrow(_count(k, shared), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))

    every = tables.write(counted(1, None), "words")
    totals = tables.write(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    counts = [tables.write(every.where(F.col("f") >= least), "counts1")]
    tables.drop("words")
    for k in (2, 3):
        shared = _common(counts[-1])
        counts.append(tables.write(counted(k, shared).where(F.col("f") >= least), f"counts{k}"))
        shared.destroy()
    stream = None
    for k, c in enumerate(counts, 1):
        one = c.select("lang", "phrase", F.lit(k).alias("k"), "f")
        stream = one if stream is None else stream.union(one)
    words = F.split("phrase", " ")
    forward = [F.col("lang"), *[F.get(words, i) for i in range(3)]]
    backward = [F.col("lang"), *[F.get(F.reverse(words), i) for i in range(3)]]
    left = _merged(tables, stream, forward, "l1", "l2", "longer", "prefix")
    both = _merged(tables, left, backward, "r1", "r2", "longer_before", "suffix").where("k > 1")
    for c in ("a", "l1", "l2", "r1", "r2"):
        both = both.withColumn(f"d_{c}", F.col("f" if c == "a" else c).cast("decimal(18,0)"))
    # whole numbers of up to 38 digits; Spark fails rather than round or overflow
    first = F.expr("(d_a * d_a * 1000000BD) div (d_l1 * if(k = 2, d_r1, d_r2))")
    second = F.expr("if(k = 3, (d_a * d_a * 1000000BD) div (d_l2 * d_r1), null)")
    scored = both.withColumn("first", first).withColumn("second", second)
    later = F.coalesce(F.col("second") < F.col("first"), F.lit(False))
    longest = F.greatest("longer", "longer_before")
    kept = scored.where((F.col("k") == 3) | (longest * 100 < F.col("f") * 50)).select(
        "lang", "phrase", F.col("f").alias("a"), F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(later | (F.col("k") == 2), F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.when(later, F.col("second")).otherwise(F.col("first")).cast("bigint").alias("score"))
    ranked = _leading(tables, tables.write(kept, "kept"), most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
