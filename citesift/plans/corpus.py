"""Corpus, chunking, content digests and the manifest diff (SRC-1, PRJ-1..4, JON-4, AGG-8, SNK-3/4, JOB-1/2).

Two policy corpora are derived from the driver tables:

* ``documents`` as policies: policy ``POL-nnn`` = ``doc_id div 20`` (at most 20 clauses), clause id
  ``POL-nnn-<doc_id>``, topic = ``lang``, title = first line of the text, text = the whole text;
* ``orders`` + ``lineitem`` as policies at scale: one order is one policy, its line items the clauses
  (any number; line numbers repeat in the driver data).  A second version of that corpus changes quantity + 1 where ``l_orderkey % 7 = 0`` and
  drops orders with ``o_orderkey % 11 = 0``; the manifest of the previous run lacks orders with
  ``o_orderkey % 13 = 0``, so they come back as new.

A ``documents`` policy is bounded by construction (20 clauses), so it is nested into one row.  An order
policy has no such bound, so it is never nested: its digest is a partially aggregated multiset hash and
its clause positions come from the skew-safe ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.functions.text import canonical_json_digest, first_line, policy_key
from citesift.operators.ordinal import largest_group, ordinal_within
from citesift.sinks.snapshot import upsert

CLAUSES_PER_POLICY = 20

CLAUSE_T = T.StructType([T.StructField("clause_id", T.StringType()), T.StructField("text", T.StringType()),
                         T.StructField("title", T.StringType()), T.StructField("topic", T.StringType())])
POLICY_T = T.StructType([T.StructField("clauses", T.ArrayType(CLAUSE_T)),
                         T.StructField("policy_id", T.StringType())])


# ---- documents as policies --------------------------------------------------------------------------
def document_clauses(docs: DataFrame) -> DataFrame:
    """Flat clauses: policy_id, clause_id, doc_id, topic, title, text."""
    pid = policy_key(F.floor(F.col("doc_id") / CLAUSES_PER_POLICY))
    return docs.select(pid.alias("policy_id"),
                       F.concat_ws("-", pid, F.col("doc_id").cast("string")).alias("clause_id"),
                       "doc_id", F.col("lang").alias("topic"), first_line("text").alias("title"), "text")


def nest_policies(clauses: DataFrame) -> DataFrame:
    """One row per policy with its clauses ordered by ``doc_id``; fields in sorted order (H1)."""
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "clause_id", "text", "title", "topic")))
    return (clauses.groupBy("policy_id").agg(ordered.alias("_c"))
            .select(F.transform("_c", lambda c: F.struct(c["clause_id"].alias("clause_id"), c["text"].alias("text"),
                                                         c["title"].alias("title"), c["topic"].alias("topic")))
                    .alias("clauses"), "policy_id"))


def chunk_by_clause(policies: DataFrame) -> DataFrame:
    """PRJ-1: one chunk per clause: id, text = title + newline + text, metadata struct."""
    c = policies.select("policy_id", F.explode("clauses").alias("c"))
    return c.select(F.col("c.clause_id").alias("id"),
                    F.concat_ws("\n", F.col("c.title"), F.col("c.text")).alias("text"),
                    F.struct(F.col("policy_id"), F.col("c.clause_id").alias("clause_id"),
                             F.col("c.title").alias("title")).alias("metadata"))


def render_policy(policies: DataFrame) -> DataFrame:
    """PRJ-2: header line, blank line, then per clause ``Clause <n>: <title>``, the text and a blank line."""
    part = F.transform("clauses", lambda c: F.concat_ws(
        "\n", F.concat(F.lit("Clause "), F.substring_index(c["clause_id"], "-", -1), F.lit(": "), c["title"]),
        c["text"], F.lit("")))
    body = F.concat(F.lit("POLICY "), F.col("policy_id"), F.lit("\n\n"), F.array_join(part, "\n"))
    return policies.select("policy_id", body.alias("rendered"))


def policy_digest(policies: DataFrame) -> DataFrame:
    """PRJ-4: content digest of each nested policy (canonical JSON, SHA-256)."""
    return policies.select("policy_id", canonical_json_digest(F.struct("clauses", "policy_id")).alias("digest"))


# ---- orders + lineitem as policies ------------------------------------------------------------------
def _cents(c):
    """Money and rates in whole hundredths: exact, cheap to format, identical in any engine."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * 100).cast("bigint").cast("string")


def order_lines(lineitem: DataFrame, version: int) -> DataFrame:
    """Clause text per line item (canonical pipe-separated form); version 2 bumps some quantities."""
    qty = F.col("l_quantity")
    if version == 2:
        qty = F.when(F.col("l_orderkey") % 7 == 0, qty + 1).otherwise(qty)
    line = F.concat_ws("|", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                       F.col("l_suppkey").cast("string"), _cents(qty),
                       _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax"), "l_returnflag", "l_linestatus")
    return lineitem.select("l_orderkey", "l_linenumber", line.alias("line"))


# fixed values: a line's SHA-256 enters its policy digest as 8 slices of 7 hex digits (28 bits each), summed
LINE_HASH_SLICES = 8
SLICE_HEX = 7


def _kept_orders(orders: DataFrame, version: int) -> DataFrame:
    if version == 1:
        return orders.where(F.col("o_orderkey") % 13 != 0)
    return orders.where(F.col("o_orderkey") % 11 != 0)


def order_policies(orders: DataFrame, lineitem: DataFrame, version: int) -> DataFrame:
    """policy_id (order key), n_lines, digest.

    The digest is a multiset hash, so no order's lines are ever gathered in one place: every line's SHA-256
    is cut into slices that are summed per order (a partial aggregate before the shuffle, so an order holding
    a third of all lines still sends one small row per partition), and the policy digest is the SHA-256 of
    the header, the line count and the slice sums.  Equal multisets of lines give equal digests; since the
    clause order is the sort order of the lines, that is exactly "same content".
    """
    h = F.sha2(F.col("line"), 256)
    sums = [F.sum(F.conv(F.substring("_h", 1 + SLICE_HEX * i, SLICE_HEX), 16, 10).cast("bigint")).alias(f"_s{i}")
            for i in range(LINE_HASH_SLICES)]
    per_order = (order_lines(lineitem, version).select(F.col("l_orderkey").alias("policy_id"), h.alias("_h"))
                 .groupBy("policy_id").agg(F.count(F.lit(1)).alias("n_lines"), *sums))
    header = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", _cents("o_totalprice"),
                         "o_orderpriority")
    pol = (_kept_orders(orders, version).select(F.col("o_orderkey").alias("policy_id"), header.alias("header"))
           .join(per_order, "policy_id", "left"))
    body = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(0)).cast("string")
                              for c in ["n_lines", *[f"_s{i}" for i in range(LINE_HASH_SLICES)]]])
    return pol.select("policy_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
                      F.sha2(F.concat_ws("\n", "header", body), 256).alias("digest"))


def manifest_of(policies: DataFrame) -> DataFrame:
    return policies.select("policy_id", "digest")


def manifest_diff(current: DataFrame, manifest: DataFrame | None, *, full: bool = False) -> DataFrame:
    """JON-4: status per policy: new / changed / unchanged (and removed when ``full``).

    An empty or missing manifest (first run) makes everything new.  Null-safe digest comparison.
    """
    cur = current.select("policy_id", F.col("digest").alias("new_digest"))
    if manifest is None:
        return cur.select("policy_id", F.lit("new").alias("status"), "new_digest",
                          F.lit(None).cast("string").alias("old_digest"))
    old = manifest.select("policy_id", F.col("digest").alias("old_digest"))
    j = cur.join(old, "policy_id", "full_outer" if full else "left")
    status = (F.when(F.col("new_digest").isNull(), F.lit("removed"))
              .when(F.col("old_digest").isNull(), F.lit("new"))
              .when(F.col("new_digest").eqNullSafe(F.col("old_digest")), F.lit("unchanged"))
              .otherwise(F.lit("changed")))
    return j.select("policy_id", status.alias("status"), "new_digest", "old_digest")


def reindex_stats(diff: DataFrame) -> DataFrame:
    """AGG-8: policies checked and policies re-embedded."""
    live = diff.where(F.col("status") != "removed")
    return live.agg(F.count(F.lit(1)).alias("policies_checked"),
                    F.count_if(F.col("status").isin("new", "changed")).alias("policies_reembedded"))


def numbered_order_lines(orders: DataFrame, lineitem: DataFrame, todo: DataFrame | None = None) -> DataFrame:
    """Vector-table rows of both corpus versions, numbered in one pass: id ``<order>-<n>`` where n is the
    line's position in (line number, line text) order inside its order, policy, version, text.

    Version 1 covers every order it keeps; version 2 only the orders in ``todo`` (all it keeps when None).
    Positions come from :func:`ordinal_within`, which never puts an order with more than a bounded number
    of lines in one task (its size check picks the skew-safe path for bigger ones).  Rows that tie on (line
    number, text) are identical in every output column, so which of them gets which position does not
    change the result.
    """
    keep2 = _kept_orders(orders, 2).select(F.col("o_orderkey").alias("policy_id")) if todo is None else todo
    # a version only drops orders, so the most lines any raw order has bounds every group here
    bound = largest_group(lineitem, ["l_orderkey"])
    parts = []
    for version, keep in ((1, _kept_orders(orders, 1).select(F.col("o_orderkey").alias("policy_id"))),
                          (2, keep2)):
        lines = order_lines(lineitem, version).join(keep.select(F.col("policy_id").alias("l_orderkey")), "l_orderkey", "left_semi")
        # numbered before the union: the join has dealt the lines by order, and the numbering needs no other shuffle
        parts.append(ordinal_within(lines, ["l_orderkey"], ["l_linenumber", "line"], name="pos", group_bound=bound)
                     .withColumn("version", F.lit(version)))
    pos = parts[0].unionByName(parts[1])
    return pos.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("pos").cast("string")).alias("id"),
                      F.col("l_orderkey").alias("policy_id"), "version", F.col("line").alias("text"))


def incremental_vectors(orders: DataFrame, lineitem: DataFrame, *, current: DataFrame | None = None,
                        manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """JOB-2 core: (upserted vector table, diff).  Only new/changed policies are re-chunked (and would be
    re-embedded); rows of removed policies and dropped clauses stay, as in the reference (Q8).

    ``current`` (version 2's policies) and ``manifest`` (version 1's) spare their making if the caller has stored them.
    """
    v1 = manifest if manifest is not None else manifest_of(order_policies(orders, lineitem, 1))
    v2 = current if current is not None else order_policies(orders, lineitem, 2)
    diff = manifest_diff(v2, v1)
    todo = diff.where(F.col("status").isin("new", "changed")).select("policy_id")
    chunks = numbered_order_lines(orders, lineitem, todo)
    existing = chunks.where(F.col("version") == 1)
    updates = chunks.where(F.col("version") == 2)
    return upsert(existing, updates, ["id"]), diff
