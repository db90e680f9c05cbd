"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target words, the rates closest to 1 in relative entropy
are ``exp(lambda * words)`` with one multiplier per source; a rate stops at the most copies allowed.  The
multipliers solve a convex dual problem, one dimension per source, by Newton steps (kept inside a shrinking
bracket).  Rates depend on a document's source and words only, so a step reads counts per (source, words)
instead of documents, and all sources take their step in the same distributed aggregation.

Rates become whole copies in blocks of a few hundred documents of one source: from the longest to the
shortest, a document is rounded so that what is owed can still be settled by the shorter ones, and what a
block takes ends within a few words of its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.llm.shared import Tables, fresh
from citesift.operators.ordinal import ordinal_within

WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 500
STEPS = 60
CLOSE = 1e-7
REACH = 700.0
FULL = 1e300
# rows of one repeated document that are written out together
REPEATS = 1 << 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``unnamed, source, source_size, n_docs, target`` for each source of ``sizes`` (``unnamed, source, size, rows``).

    Sources in code point order, the null source last, take ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's words and the rest is shared anew.  With the sources
    ordered by the level at which they stop, running sums give the common level directly.
    """
    stats = sizes.groupBy("unnamed", "source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy("unnamed", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    stats = stats.withColumn("weight", weight).withColumn("stop", F.col("source_size") * most / F.col("weight"))
    by_stop = Window.orderBy("stop", "unnamed", "source")
    whole = Window.partitionBy()
    stopped = F.coalesce(F.sum(F.col("source_size") * most).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * share - stopped) / rest
    stats = stats.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "unnamed", "source", "level"))).over(whole)
    target = F.least(F.col("source_size") * float(most), F.col("weight") * F.coalesce(common["level"], F.lit(0.0)))
    return stats.select("unnamed", "source", "source_size", "n_docs", target.alias("target"))


def _rate(most: int):
    return F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(REACH))), F.lit(float(most)))


def _solve(tables: Tables, counts: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Newton steps on the dual: ``unnamed, source, lam, scale`` with each source's words at its target.

    A source that does not reach its target within ``STEPS`` steps is an error.
    """
    keys = ["unnamed", "source"]
    scale = counts.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"),
        F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(1)).alias("least"))
    # multipliers are in units of 1 / scale, the size-weighted mean length
    # however long others are, the bracket takes the shortest documents from a rate of next to 0 to the most
    reach = F.greatest("scale", F.lit(1.0)) / F.col("least")
    state = targets.join(scale, keys).select(
        *keys, "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"),
        # a source that gives all it may has no finite multiplier: every document with words is at the most
        F.when(F.col("target") >= F.col("source_size") * float(most), FULL).otherwise(0.0).alias("lam"),
        (reach * -REACH).alias("lo"), (reach * (math.log(most) + 1)).alias("hi"), F.lit(1.0).alias("gap"))
    state = tables.write(state, "dual0")
    rate = _rate(most)
    words = F.col("n") * F.col("size")
    for step in range(1, STEPS + 1):
        moved = counts.join(state, keys).groupBy(*keys, "source_size", "target", "scale", "lam", "lo", "hi").agg(
            F.sum(words * rate).alias("taken"),
            F.sum(F.when(rate < most, words * F.col("size") / F.col("scale") * rate).otherwise(0.0)).alias("slope"))
        gap = F.abs(F.col("taken") - F.col("target")) / F.greatest(F.col("source_size"), F.lit(1))
        lo = F.when(F.col("taken") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("taken") < F.col("target"), F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") + F.try_divide(F.col("target") - F.col("taken"), F.col("slope"))
        # flat or outside the bracket: halve the bracket instead
        inside = newton.isNotNull() & (newton > lo) & (newton < hi)
        after = moved.select(*keys, "source_size", "target", "scale", gap.alias("gap"), "lam", lo.alias("lo"), hi.alias("hi"),
                             F.when(inside, newton).otherwise((lo + hi) / 2).alias("next"))
        state = tables.write(after.select(
            *keys, "source_size", "target", "scale", "lo", "hi", "gap",
            F.when(F.col("gap") <= CLOSE, F.col("lam")).otherwise(F.col("next")).alias("lam")), f"dual{step}")
        tables.drop(f"dual{step - 1}")
        if not state.where(F.col("gap") > CLOSE).limit(1).count():
            break
    else:
        worst = state.agg(F.max(F.struct("gap", "source"))).first()[0]
        raise RuntimeError(f"source {worst.source!r} is {worst.gap:.2g} of its words off its target after {STEPS} steps")
    return state.select(*keys, "lam", "scale")


def mix_decisions(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, size, t, unnamed, source, source_size, target, copies, extra, rows`` for each distinct document.

    A document is a key, a source and a text (``t`` is its hash); ``rows`` counts its repeats.  All of them are
    taken ``copies`` times, and ``extra`` of them once more, so one row that repeats very often is one item here
    and still meets its share to the row.
    """
    tables = Tables(docs.sparkSession, "entropy_mix")
    keys = ["unnamed", "source"]
    sizes = tables.write(docs.select(
        F.col(f"`{key}`").alias("doc_id"), word_count(text).alias("size"), text_hash(text).alias("t"), F.col(f"`{source}`").isNull().alias("unnamed"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source")).groupBy("doc_id", "size", "t", *keys).agg(
        F.count(F.lit(1)).alias("rows")), "sizes")
    targets = tables.write(source_targets(sizes, weights, share, most), "targets")
    counts = tables.write(sizes.groupBy(*keys, "size").agg(F.sum("rows").alias("n")), "counts")
    duals = _solve(tables, counts, targets, most)

    # a written table has a known size: Spark sends it to all tasks while it is small, and splits the join
    # where one source has very many documents otherwise
    rates = tables.write(targets.join(duals, keys), "rates")
    # a null key, or one that many documents share, is spread by the texts
    rated = sizes.join(rates, keys).select(
        "doc_id", "size", "t", "rows", *keys, "source_size", "target", _rate(most).alias("rate"),
        F.pmod(F.xxhash64("doc_id", "size", "t"), F.ceil(F.col("n_docs") / BLOCK)).alias("block"))
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id").alias("h"), "doc_id", "t", "size", "rows", "rate")
    blocks = rated.groupBy(*keys, "source_size", "target", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def walk(acc, x):
        least = F.floor(x["rate"])
        words = x["size"] * x["rows"]
        due = acc["owed"] + (x["rate"] - least) * words
        # above a rate of 1 the short documents at the end can only take more, below it only less
        whole = F.floor(due / F.greatest(x["size"], F.lit(1))) + F.when(x["rate"] > 1, 0).otherwise(1)
        extra = F.when((x["rate"] > least) & (x["size"] > 0), F.least(F.greatest(whole, F.lit(0)), x["rows"])).otherwise(0).cast("bigint")
        return F.struct((due - extra * x["size"]).alias("owed"),
                        F.concat(acc["out"], F.array(F.struct(least.cast("int").alias("copies"), extra.alias("extra")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<copies:int,extra:bigint>>").alias("out"))
    walked = blocks.withColumn("out", F.aggregate("items", start, walk)["out"])
    each = walked.select(*keys, "source_size", "target", F.explode(F.arrays_zip("items", "out")).alias("x"))
    return each.select(*[F.col(f"x.items.{c}").alias(c) for c in ("doc_id", "size", "t")], *keys, "source_size", "target",
                       "x.out.copies", "x.out.extra", F.col("x.items.rows").alias("rows"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`"))


def _each_row(found: DataFrame) -> DataFrame:
    """``found`` once for each of its rows, with ``copies`` for that row; a very frequent document is written out by many tasks."""
    def out(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        return rows.select("*", F.explode(F.sequence(first, last)).alias("nth")).withColumn(
            "copies", F.col("copies") + (F.col("nth") <= F.col("extra")).cast("int")).drop("nth")

    few = out(found.where(F.col("rows") <= REPEATS), F.lit(1).cast("bigint"), F.col("rows"))
    # so many parts that neither their list nor a part is long
    part = F.greatest(F.lit(REPEATS), F.ceil(F.sqrt("rows")))
    many = found.where(F.col("rows") > REPEATS).withColumn("size_of", part.cast("bigint"))
    many = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / F.col("size_of")))))
    many = many.repartition(F.xxhash64("doc_id", "t", "part"))
    first = F.col("part") * F.col("size_of")
    many = out(many, first + 1, F.least(first + F.col("size_of"), F.col("rows"))).drop("part", "size_of")
    return few.unionByName(many)


def entropy_mix(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source`` for every document.

    ``size`` is the words of the text (null: 0), ``taken`` the words that the mix takes of it, ``copies``
    how often (0 to ``most``).  A null source is a source of its own, the last one.  Documents without words
    are taken once and take no words.  Null keys are keys like others; of rows equal in key, source and text
    some may be taken once more than the others, so that their source meets its target.  Columns not named are
    not read.  All choices follow from the rows' values, so reruns agree.  An empty table gives an empty result.
    ``settings`` are those of :func:`mix_decisions`.
    """
    tables = Tables(docs.sparkSession, "entropy_mix_rows")
    each = _each_row(tables.write(mix_decisions(docs, **settings), "decided"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"),
                       "copies", F.when(~F.col("unnamed"), F.col("source")).alias("source"))


def apply_mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its copies, with the columns it came with.

    Nulls, repeats and documents without words are taken as :func:`entropy_mix` says; of rows equal in key, source
    and text those that are taken once more are the first in the order of the table as it is read.  An empty table stays empty.
    """
    tables = Tables(docs.sparkSession, "entropy_mix_rows")
    taken = ("doc_id", "t", "unnamed", "source", "copies", "extra", "rows")
    names = fresh(docs, "k", "h", "unnamed", "named", "copies", "extra", "rows", "copy", "tag")
    found = tables.write(mix_decisions(docs, text=text, key=key, source=source, **settings).where("copies + extra > 0").select(
        *taken).toDF(*names[:7]), "decided")
    k, h, unnamed, named, copies, extra, rows = (F.col(c) for c in names[:7])
    same = (F.col(f"`{key}`").eqNullSafe(k) & text_hash(text).eqNullSafe(h) & (F.col(f"`{source}`").isNull() == unnamed)
            & (F.coalesce(F.col(f"`{source}`"), F.lit("")) == named))
    met = docs.join(found, same)
    given = [F.col(f"`{c}`") for c in docs.columns]

    def taken_rows(rows_of: DataFrame, times: Column) -> DataFrame:
        return rows_of.where(times > 0).select(*given, F.explode(F.sequence(F.lit(1), times)).alias(names[7])).drop(names[7])

    alike = (extra == 0) | (extra == rows)
    out = taken_rows(met.where(alike), copies + F.when(extra > 0, 1).otherwise(0))
    if found.where(~alike).limit(1).count():
        # only repeated documents that are not all taken alike need numbers
        nth = ordinal_within(met.where(~alike).withColumn(names[8], F.monotonically_increasing_id()), [*names[:4]], [names[8]], name=names[7])
        first = F.col(names[7]) <= extra
        numbered = tables.write(nth.withColumn(names[4], copies + first.cast("int")).select(*given, copies), "numbered")
        out = out.union(taken_rows(numbered, copies))
    return out
