"""Containment join: which documents hold a passage word for word (AGG-13, JOB-5).

Every passage and every document is reduced to winnowed fingerprints.  A document that holds a passage has all of the
passage's fingerprints, so a passage needs only one of them as its anchor: the one that fewest documents have.
Documents that share an anchor are candidates, and the texts themselves decide.

Run length and window grow with the passage in powers of two (``SCALES``), so short passages find their documents
too, and only scales that occur are computed.  A scale gives a document about ``2 / run length`` fingerprints a byte.
Neither side is ever gathered: fingerprints join on their value, candidates on their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.functions.fingerprints import fingerprints, text_blocks
from citesift.session import cut_lineage, ship_package

# run lengths in bytes; a scale serves passages of twice its run length or more, the smallest every passage
SCALES = (1, 2, 4, 8, 16, 32, 64, 128)


def _width(k: int) -> int:
    # a window and its runs span 2 k bytes; single bytes are taken as they are
    return 1 if k == 1 else k + 1


def scale_of(text: str):
    """The largest run length of ``SCALES`` that fits a passage twice (1 for passages of up to three bytes)."""
    size = F.octet_length(F.col(text))
    out = F.lit(SCALES[0])
    for k in SCALES[1:]:
        out = F.when(size >= 2 * k, F.lit(k)).otherwise(out)
    return out


def _marks(rows: DataFrame, scales: list[int] | None) -> DataFrame:
    """``id, scale, mark`` of ``rows (id, text)``: at all of ``scales``, or at each row's own ``scale``."""
    ship_package(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("scale").to_numpy() if scales is None else None
            for first, raw, offs in text_blocks(batch.column("text")):
                for k in scales or sorted(set(own[first:first + len(offs) - 1].tolist())):
                    text, mark = fingerprints(raw, offs, k, _width(k))
                    if own is not None:
                        mine = own[first + text] == k
                        text, mark = text[mine], mark[mine]
                    if len(text):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(pa.array(text + first)), pa.array([k] * len(text), pa.int32()), pa.array(mark.view("int64"))],
                            names=["id", "scale", "mark"])

    return rows.mapInArrow(run, f"id {kind}, scale int, mark bigint")


def contained_in(passages: DataFrame, docs: DataFrame, *, passage_key: str, doc_key: str, text: str = "text") -> DataFrame:
    """``passage_key, doc_key`` for every document whose text holds the whole text of the passage, each pair once.

    Texts are compared byte by byte, case and white space included.  An empty or null passage is in no document; rows
    without a key take no part; rows that share a key are one passage (or document) with several texts.
    """
    p = passages.where(F.col(passage_key).isNotNull() & (F.octet_length(text) > 0)).select(
        F.col(passage_key).alias("id"), F.col(text).alias("text"), scale_of(text).alias("scale"))
    p = cut_lineage(p.withColumn("part", F.monotonically_increasing_id()))
    d = docs.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_key).alias("id"), F.col(text).alias("text"))
    # at most as many values as there are scales
    scales = sorted(r["scale"] for r in p.select("scale").distinct().collect())
    if not scales:
        return p.select(F.col("id").alias(passage_key)).join(d.select(F.col("id").alias(doc_key)), F.lit(False))
    asked = cut_lineage(_marks(p.select(F.col("part").alias("id"), "text", "scale"), None).withColumnRenamed("id", "part"))
    wanted = asked.select("scale", "mark").distinct()
    seen = cut_lineage(_marks(d, scales).join(wanted, ["scale", "mark"], "left_semi").distinct())
    spread = seen.groupBy("scale", "mark").agg(F.count(F.lit(1)).alias("n"))
    # a fingerprint that no document has rules its passage out
    anchors = asked.join(spread, ["scale", "mark"], "left").groupBy("part").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "scale", "mark")).alias("a")).where("a.n > 0").select(
        "part", "a.scale", "a.mark")
    pairs = cut_lineage(anchors.join(seen, ["scale", "mark"]).select("part", F.col("id").alias("doc")))
    asked_text = pairs.join(p.select("part", F.col("id").alias("passage"), F.col("text").alias("held")), "part")
    met = asked_text.join(d, F.col("doc") == F.col("id"))
    return met.where(F.contains(F.col("text"), F.col("held"))).select(
        F.col("passage").alias(passage_key), F.col("doc").alias(doc_key)).distinct()
