"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf.  The leaves of a source, in key order, are grouped into runs of ``width``; a run's digests
together make their parent, until one node is left; the sources' nodes, in source order, do the same once more.

A level is one self-join: each node sends its digest to the indices of its siblings (slot offsets 1 to
``width - 1`` within its run) and an equijoin on (tree, index) hands every node the digests of the others.  The row in
slot zero then holds the whole run and emits the parent.  Going down again, each level prepends its own siblings
to the path of its parent, so a leaf ends with every sibling up to the root.

Places come from ranges, not from one window per source: rows are spread by ranges of the whole order, and the
place within a source is the place in the table less the first place of the source.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.ranges import numbered
from citesift.llm.shared import Tables

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:binary,right:binary>>"


def _field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _leaf(values: list[Column]) -> Column:
    return F.unhex(_hash(F.concat(*map(_field, values))))


def lower_ascii(text: str) -> Column:
    return F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)


def every_fifth(key: str) -> Column:
    """Rows whose key, as decimal text, has a CRC-32 that 5 divides; a null key is none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _with_siblings(nodes: DataFrame, width: int) -> DataFrame:
    """``nodes (t, i, n, h, p)`` with ``left`` and ``right``: the digests of the run's other nodes before and after."""
    slot = F.pmod("i", F.lit(width))
    sent = nodes.select("t", "i", "n", "h", F.explode(F.sequence(F.lit(1), F.lit(width - 1))).alias("shift")).select(
        "t", (F.col("i") - slot + F.pmod(slot + F.col("shift"), F.lit(width))).alias("to"), slot.alias("slot"), "n", "h").where(
        F.col("to") < F.col("n")).select(F.col("t").alias("st"), "to", F.struct("slot", "h").alias("one"))
    met = nodes.join(sent, (F.col("t") == F.col("st")) & (F.col("i") == F.col("to")), "left").groupBy("t", "i").agg(
        F.first("n").alias("n"), F.first("h").alias("h"), F.first("p").alias("p"), F.sort_array(F.collect_list("one")).alias("others"))

    def joined(keep) -> Column:
        return F.aggregate(F.filter("others", keep), F.lit(b""), lambda acc, x: F.concat(acc, x["h"]))

    return met.select("t", "i", "n", "h", "p", joined(lambda x: x["slot"] < slot).alias("left"),
                      joined(lambda x: x["slot"] > slot).alias("right"))


def _climb(tables: Tables, nodes: DataFrame, most: int, width: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels with siblings, and per level the trees that end there as ``t, h``.

    ``nodes`` has ``t, i, n, h, p``: tree, index, nodes of the tree on this level, digest, what the caller carries.
    """
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("t", "h"))
        if most <= 1:
            return levels, tops
        level = tables.write(_with_siblings(nodes.where("n > 1"), width), f"{name}{len(levels)}")
        levels.append(level)
        parent = F.unhex(_hash(F.concat(_hex(F.col("h")), _hex(F.col("right")))))
        nodes = level.where(F.pmod("i", F.lit(width)) == 0).select(
            "t", (F.col("i") / width).cast("bigint").alias("i"), F.ceil(F.col("n") / width).alias("n"), parent.alias("h"),
            F.lit(None).cast(level.schema["p"].dataType).alias("p"))
        most = -(-most // width)


def _descend(level: DataFrame, above: DataFrame, width: int) -> DataFrame:
    """Paths of a level's nodes: their own siblings, then the path of their parent in ``above (t, i, path, top)``."""
    up = above.select(F.col("t").alias("ut"), F.col("i").alias("ui"), F.col("path").alias("rest"), "top")
    own = F.array(F.struct("left", "right")).cast(_PATH)
    return level.join(up, (F.col("t") == F.col("ut")) & ((F.col("i") / width).cast("bigint") == F.col("ui"))).select(
        "t", "i", "h", "p", F.concat(own, "rest").alias("path"), "top")


def merkle_manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", lang: str = "lang", size: str = "n_chars",
                    text: str = "text", width: int = WIDTH, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    ``proof_sha256`` is the hash of all siblings on the way to the root.  Rows of ``tampered`` (default: every fifth by
    the key's checksum) are checked as they would be if someone had lower-cased the A-Z of their text;
    ``folded_root`` is what their leaf and the original siblings give, and ``verified`` whether it is the root.

    A null value of any of the five columns is the field ``-``; null sources are a source of their own, the first; null
    keys come before all others of their source and are never tampered with.  Rows that share a key are
    ordered by their leaf, so rows that are equal in all five columns may take each other's place without any digest
    changing.  A table of one row has its leaf as root and an empty proof.  Columns not named are not read.  An
    empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "merkle_manifest")
    names = dict(zip(FIELDS, (key, source, lang, size, text)))
    given = docs.select(*[F.col(f"`{c}`").alias(f) for f, c in names.items()])
    honest = _leaf([F.col(f) for f in FIELDS])
    forged = _leaf([lower_ascii(f) if f == "text" else F.col(f) for f in FIELDS])
    touched = every_fifth("doc_id") if tampered is None else tampered
    # the last column only spreads rows that are equal in all others over several ranges
    leaves = tables.write(given.select("doc_id", "source", honest.alias("leaf"), F.when(touched, forged).alias("forged"),
                                       F.monotonically_increasing_id().alias("row")), "leaves")
    placed = numbered(tables, leaves, ["source", "doc_id", "leaf", "row"], "placed")
    sources = tables.write(placed.groupBy("source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "sources")
    trees = numbered(tables, sources, ["first"], "trees").select(F.col("source").alias("of"), "first", "n", F.col("place").alias("t"))
    carried = F.struct("doc_id", "forged").alias("p")
    nodes = tables.write(placed.join(trees, F.col("source").eqNullSafe(F.col("of"))).select(
        "t", (F.col("place") - F.col("first")).alias("i"), "n", F.col("leaf").alias("h"), carried), "nodes")
    # two numbers: the largest source and how many there are
    most = sources.agg(F.max("n").alias("rows"), F.count(F.lit(1)).alias("trees")).first()
    tables.drop("leaves", "placed", "sources", "trees")

    levels, tops = _climb(tables, nodes, most.rows or 0, width, "leaves_level")
    below = tops[0]
    for t in tops[1:]:
        below = below.union(t)
    none = F.lit(None).cast("string").alias("p")
    crown = tables.write(below.select(F.lit(0).cast("bigint").alias("t"), F.col("t").alias("i"),
                                      F.lit(most.trees).cast("bigint").alias("n"), "h", none), "subroots")
    upper, last = _climb(tables, crown, most.trees, width, "sources_level")
    root = last[-1].first()
    root_hex = F.lit(root.h.hex() if root is not None else None).cast("string")

    no_path = F.array().cast(_PATH).alias("path")
    blank = F.lit(None).cast("binary").alias("top")
    paths = last[-1].select("t", F.lit(0).cast("bigint").alias("i"), no_path, blank)
    for level in reversed(upper):
        paths = _descend(level, paths, width)
    # a source's way to the root, and its own digest
    by_tree = crown.select("i", "h").join(paths.select(F.col("i").alias("at"), "path"), F.col("i") == F.col("at")).select(
        F.col("i").alias("t"), F.lit(0).cast("bigint").alias("i"), "path", F.col("h").alias("top")) if upper else crown.select(
        F.col("i").alias("t"), F.lit(0).cast("bigint").alias("i"), no_path, F.col("h").alias("top"))
    by_tree = tables.write(by_tree, "by_tree")

    paths = None
    for n in range(len(levels), -1, -1):
        # trees that end on this level start from the way of their source
        ends = tops[n].select(F.col("t").alias("et")).join(by_tree, F.col("et") == F.col("t")).select("t", "i", "path", "top")
        if n < len(levels):
            inner = _descend(levels[n], paths, width)
            if not n:
                break
            ends = ends.union(inner.select("t", "i", "path", "top"))
        paths = ends
    columns = ["h", "p.doc_id", "p.forged", "path", "top"]
    alone = nodes.where("n = 1").select("t", "h", "p").join(by_tree.select("t", "path", "top"), "t").select(*columns)
    found = inner.select(*columns).union(alone) if levels else alone

    siblings = F.aggregate("path", F.lit(""), lambda acc, x: F.concat(acc, _hex(x["left"]), _hex(x["right"])))
    folded = F.aggregate("path", _hex(F.coalesce("forged", "h")),
                         lambda acc, x: _hash(F.concat(_hex(x["left"]), acc, _hex(x["right"]))))
    return found.select("doc_id", _hex(F.col("h")).alias("leaf"), _hex(F.col("top")).alias("subroot"), root_hex.alias("root"),
                        _hash(siblings).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
