"""Corpus, digest, manifest and vector-table queries (SRC-1, SRC-5, PRJ-1..4, JON-4, AGG-8, AGG-12, SET-3,
SNK-3, SNK-4, WIN-7, UDF-1, JOB-1, JOB-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.functions.text import dense_vector, last_key_part, normalised_buckets, token_buckets
from citesift.plans import corpus as cp
from citesift.session import cut_lineage, work_dir
from citesift.sinks.snapshot import read_snapshot, upsert, write_snapshot
from citesift.sources.nested import read_policies_json, write_policies_json
from citesift.sources.tables import read_table

# ---- oracle fragments ---------------------------------------------------------------------------------
SQL_DC = """dc AS (
  SELECT printf('POL-%03d', doc_id // 20) AS policy_id,
         printf('POL-%03d', doc_id // 20) || '-' || CAST(doc_id AS VARCHAR) AS clause_id,
         doc_id, lang AS topic, split_part(text, chr(10), 1) AS title, text
  FROM documents)"""


def sql_order_policies(v: int) -> str:
    bump = "CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END" if v == 2 else "0"
    keep = "o_orderkey % 13 <> 0" if v == 1 else "o_orderkey % 11 <> 0"
    slices = ",\n         ".join(
        f"sum(('0x' || substr(sha256(line), {1 + 7 * i}, 7))::BIGINT) AS s{i}" for i in range(8))
    sums = " || '|' || ".join(f"CAST(coalesce(l.s{i}, 0) AS VARCHAR)" for i in range(8))
    return f"""ln{v} AS (
  SELECT l_orderkey, l_linenumber,
         concat_ws('|', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
           CAST(l_suppkey AS VARCHAR), CAST(CAST(round((l_quantity + {bump}) * 100) AS BIGINT) AS VARCHAR),
           CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
           CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR),
           CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), l_returnflag, l_linestatus) AS line
  FROM lineitem),
li{v} AS (
  SELECT l_orderkey, list(line ORDER BY l_linenumber, line) AS lines, count(*) AS n,
         {slices}
  FROM ln{v} GROUP BY l_orderkey),
p{v} AS (
  SELECT o.o_orderkey AS policy_id, coalesce(l.lines, []::VARCHAR[]) AS lines,
         sha256(concat_ws('|', CAST(o.o_custkey AS VARCHAR), o.o_orderstatus,
                          CAST(CAST(round(o.o_totalprice * 100) AS BIGINT) AS VARCHAR), o.o_orderpriority)
                || chr(10) || CAST(coalesce(l.n, 0) AS VARCHAR) || '|' || {sums}) AS digest
  FROM orders o LEFT JOIN li{v} l ON l.l_orderkey = o.o_orderkey WHERE {keep})"""


SQL_DIFF = f"""WITH {sql_order_policies(1)},
{sql_order_policies(2)},
diff AS (
  SELECT coalesce(p2.policy_id, p1.policy_id) AS policy_id,
         CASE WHEN p2.policy_id IS NULL THEN 'removed' WHEN p1.policy_id IS NULL THEN 'new'
              WHEN p2.digest = p1.digest THEN 'unchanged' ELSE 'changed' END AS status
  FROM p2 FULL OUTER JOIN p1 ON p1.policy_id = p2.policy_id)"""

SQL_VECTORS = f"""{SQL_DIFF},
c1 AS (SELECT CAST(p1.policy_id AS VARCHAR) || '-' || CAST(u.pos AS VARCHAR) AS id, p1.policy_id, 1 AS version, u.text
       FROM p1, LATERAL (SELECT unnest(p1.lines) AS text, unnest(range(1, len(p1.lines) + 1)) AS pos) u),
c2 AS (SELECT CAST(p2.policy_id AS VARCHAR) || '-' || CAST(u.pos AS VARCHAR) AS id, p2.policy_id, 2 AS version, u.text
       FROM p2 JOIN diff ON diff.policy_id = p2.policy_id AND diff.status IN ('new', 'changed'),
            LATERAL (SELECT unnest(p2.lines) AS text, unnest(range(1, len(p2.lines) + 1)) AS pos) u),
vt AS (SELECT * FROM c1 WHERE id NOT IN (SELECT id FROM c2) UNION ALL SELECT * FROM c2)"""


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")


def _doc_policies(spark, sf_dir):
    return cp.nest_policies(cp.document_clauses(read_table(spark, sf_dir, "documents")))


# ---- documents as nested policies --------------------------------------------------------------------
@query("src_nested_docs", sql=f"""WITH {SQL_DC}
SELECT policy_id, CAST(count(*) AS INTEGER) AS n_clauses, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       min(clause_id) AS first_clause_id
FROM dc GROUP BY policy_id""")
def src_nested_docs(spark, sf_dir):
    """SRC-1: policies written as JSON Lines, scanned back with an explicit schema."""
    path = work_dir(spark, "policies-json")
    write_policies_json(_doc_policies(spark, sf_dir), path)
    pol = read_policies_json(spark, path)
    return pol.select("policy_id", F.size("clauses").cast("int").alias("n_clauses"),
                      F.aggregate("clauses", F.lit(0).cast("bigint"),
                                  lambda acc, c: acc + F.length(c["text"])).alias("n_chars"),
                      F.array_min(F.transform("clauses", lambda c: c["clause_id"])).alias("first_clause_id"))


@query("chunk_by_clause", sql=f"""WITH {SQL_DC}
SELECT clause_id AS id, policy_id, title, CAST(length(title || chr(10) || text) AS INTEGER) AS text_len,
       sha256(title || chr(10) || text) AS text_sha
FROM dc""")
def chunk_by_clause(spark, sf_dir):
    """PRJ-1: one chunk per clause with title + newline + text and a metadata struct."""
    ch = cp.chunk_by_clause(_doc_policies(spark, sf_dir))
    return ch.select("id", F.col("metadata.policy_id").alias("policy_id"), F.col("metadata.title").alias("title"),
                     F.length("text").alias("text_len"), F.sha2("text", 256).alias("text_sha"))


@query("render_policy", sql=f"""WITH {SQL_DC}
SELECT policy_id, CAST(length(r) AS INTEGER) AS rendered_len, sha256(r) AS rendered_sha FROM (
  SELECT policy_id, 'POLICY ' || policy_id || chr(10) || chr(10)
         || string_agg('Clause ' || CAST(doc_id AS VARCHAR) || ': ' || title || chr(10) || text || chr(10), chr(10)
                       ORDER BY doc_id) AS r
  FROM dc GROUP BY policy_id)""")
def render_policy(spark, sf_dir):
    """PRJ-2: a policy rendered to plain text."""
    r = cp.render_policy(_doc_policies(spark, sf_dir))
    return r.select("policy_id", F.length("rendered").alias("rendered_len"),
                    F.sha2("rendered", 256).alias("rendered_sha"))


@query("composite_keys", sql=f"""WITH {SQL_DC}
SELECT doc_id, policy_id, clause_id, split_part(clause_id, '-', -1) AS clause_no,
       split_part(policy_id, '-', 1) AS key_prefix FROM dc""")
def composite_keys(spark, sf_dir):
    """PRJ-3: build ``POL-nnn`` and ``POL-nnn-<n>`` keys and split them again."""
    dc = cp.document_clauses(read_table(spark, sf_dir, "documents"))
    return dc.select("doc_id", "policy_id", "clause_id", last_key_part("clause_id").alias("clause_no"),
                     F.substring_index("policy_id", "-", 1).alias("key_prefix"))


@query("content_digest", sql=f"""WITH {SQL_DC}
SELECT policy_id, sha256(CAST(to_json({{'clauses': clauses, 'policy_id': policy_id}}) AS VARCHAR)) AS digest FROM (
  SELECT policy_id, list({{'clause_id': clause_id, 'text': text, 'title': title, 'topic': topic}} ORDER BY doc_id)
           AS clauses
  FROM dc GROUP BY policy_id)""")
def content_digest(spark, sf_dir):
    """PRJ-4: SHA-256 of each policy's canonical JSON (sorted keys)."""
    return cp.policy_digest(_doc_policies(spark, sf_dir))


@query("corpus_counts", sql=f"""WITH {SQL_DC}
SELECT count(DISTINCT policy_id) AS n_policies, count(*) AS n_clauses FROM dc""")
def corpus_counts(spark, sf_dir):
    """AGG-12: documents (policies) and clauses in the corpus."""
    dc = cp.document_clauses(read_table(spark, sf_dir, "documents"))
    return dc.agg(F.count_distinct("policy_id").alias("n_policies"), F.count(F.lit(1)).alias("n_clauses"))


@query("distractors", sql=f"""WITH {SQL_DC},
target AS (SELECT policy_id, min(doc_id) AS doc_id FROM dc GROUP BY policy_id)
SELECT dc.policy_id, dc.clause_id FROM dc
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.policy_id = dc.policy_id AND t.doc_id = dc.doc_id)""")
def distractors(spark, sf_dir):
    """SET-3: clauses of a policy other than its target clause (the first clause stands in for the target)."""
    dc = cp.document_clauses(read_table(spark, sf_dir, "documents"))
    target = dc.groupBy("policy_id").agg(F.min("doc_id").alias("doc_id"))
    return dc.join(target, ["policy_id", "doc_id"], "left_anti").select("policy_id", "clause_id")


# ---- hashed embedding (UDF-1) -----------------------------------------------------------------------
SQL_BUCKETS = """tok AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS t FROM documents),
bk AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, count(*) AS tf
  FROM tok WHERE t <> '' GROUP BY doc_id, bucket)"""


@query("embed_hashed", sql=f"""WITH {SQL_BUCKETS}
SELECT doc_id, bucket, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 9) AS weight FROM bk""")
def embed_hashed_q(spark, sf_dir):
    """UDF-1: hashed bag-of-tokens embedding of every document (whole text), L2-normalised, sparse form."""
    docs = read_table(spark, sf_dir, "documents")
    w = normalised_buckets(token_buckets(docs, "doc_id", "text"), "doc_id")
    return w.select("doc_id", "bucket", "tf", F.round("weight", 9).alias("weight"))


@query("index_corpus", sql=f"""WITH {SQL_DC},
{SQL_BUCKETS.replace('FROM documents', 'FROM (SELECT doc_id, title || chr(10) || text AS text FROM dc)')}
SELECT dc.clause_id AS id, dc.policy_id, CAST(count(bk.bucket) AS INTEGER) AS nnz,
       round(sqrt(sum(bk.tf * bk.tf)), 6) AS tf_norm
FROM dc LEFT JOIN bk ON bk.doc_id = dc.doc_id GROUP BY dc.clause_id, dc.policy_id""")
def index_corpus(spark, sf_dir):
    """JOB-1: policies -> chunks -> hashed embeddings -> vector table snapshot (read back)."""
    docs = read_table(spark, sf_dir, "documents")
    dc = cp.document_clauses(docs)
    chunks = cp.chunk_by_clause(cp.nest_policies(dc))
    keyed = chunks.select("id", F.col("metadata.policy_id").alias("policy_id"), "text")
    buckets = cut_lineage(token_buckets(keyed, "id", "text"))
    stats = buckets.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("nnz"),
                                      F.round(F.sqrt(F.sum(F.col("tf") * F.col("tf"))), 6).alias("tf_norm"))
    # the vectors come from the same counts: texts are split into tokens once
    vectors = dense_vector(normalised_buckets(buckets, "id"), "id")
    table = keyed.select("id", "policy_id").join(vectors, "id", "left").join(stats, "id", "left")
    root = work_dir(spark, "vectors")
    write_snapshot(upsert(None, table, ["id"]), root)
    back = read_snapshot(spark, root)
    return back.select("id", "policy_id", F.coalesce("nnz", F.lit(0)).alias("nnz"),
                       F.coalesce("tf_norm", F.lit(0.0)).alias("tf_norm"))


# ---- manifest and incremental reindex (orders + lineitem) --------------------------------------------
@query("manifest_diff", sql=f"""{SQL_DIFF}
SELECT policy_id, status FROM diff""")
def manifest_diff(spark, sf_dir):
    """JON-4: new / changed / unchanged / removed per policy between the last manifest and today."""
    o, li = _orders(spark, sf_dir)
    d = cp.manifest_diff(cp.order_policies(o, li, 2), cp.manifest_of(cp.order_policies(o, li, 1)), full=True)
    return d.select("policy_id", "status")


@query("reindex_stats", sql=f"""{SQL_DIFF}
SELECT CAST(count_if(status <> 'removed') AS BIGINT) AS policies_checked,
       CAST(count_if(status IN ('new', 'changed')) AS BIGINT) AS policies_reembedded FROM diff""")
def reindex_stats(spark, sf_dir):
    """AGG-8 / JOB-2: policies checked and re-embedded."""
    o, li = _orders(spark, sf_dir)
    d = cp.manifest_diff(cp.order_policies(o, li, 2), cp.manifest_of(cp.order_policies(o, li, 1)))
    return cp.reindex_stats(d)


@query("manifest_first_run", sql=f"""WITH {sql_order_policies(2)}
SELECT count(*) AS policies_checked, count(*) AS policies_reembedded FROM p2""")
def manifest_first_run(spark, sf_dir):
    """SRC-5: a manifest that was never written reads as empty, so every policy is re-embedded."""
    o, li = _orders(spark, sf_dir)
    manifest = read_snapshot(spark, work_dir(spark, "manifest-missing"))
    return cp.reindex_stats(cp.manifest_diff(cp.order_policies(o, li, 2), manifest))


@query("manifest_replace", sql=f"""WITH {sql_order_policies(2)}
SELECT policy_id, digest FROM p2""")
def manifest_replace(spark, sf_dir):
    """SNK-4: the new manifest is built from today's policies only and replaces the old one wholesale,
    written after the vector upsert (Q8, Q9)."""
    o, li = _orders(spark, sf_dir)
    root = work_dir(spark, "manifest")
    write_snapshot(cp.manifest_of(cp.order_policies(o, li, 1)), root)
    # today's policies are made once; the diff is against the manifest as it is stored
    today = cut_lineage(cp.order_policies(o, li, 2))
    vectors, _ = cp.incremental_vectors(o, li, current=today, manifest=read_snapshot(spark, root))
    write_snapshot(vectors, work_dir(spark, "order-vectors"))
    write_snapshot(cp.manifest_of(today), root)
    return read_snapshot(spark, root).select("policy_id", "digest")


@query("vector_upsert", sql=f"""{SQL_VECTORS}
SELECT id, policy_id, CAST(version AS INTEGER) AS version, sha256(text) AS text_sha FROM vt""")
def vector_upsert(spark, sf_dir):
    """SNK-3: changed and new policies' chunks replace rows by id; nothing is deleted (Q8)."""
    o, li = _orders(spark, sf_dir)
    vectors, _ = cp.incremental_vectors(o, li)
    return vectors.select("id", "policy_id", F.col("version").cast("int").alias("version"),
                          F.sha2("text", 256).alias("text_sha"))


@query("latest_by_key", sql=f"""{SQL_VECTORS},
log AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2)
SELECT id, CAST(max(version) AS INTEGER) AS version, sha256(arg_max(text, version)) AS text_sha FROM log GROUP BY id""")
def latest_by_key(spark, sf_dir):
    """WIN-7: latest record per key from an append log (``max_by``, partially aggregated)."""
    o, li = _orders(spark, sf_dir)
    d = cp.manifest_diff(cp.order_policies(o, li, 2), cp.manifest_of(cp.order_policies(o, li, 1)))
    log = cp.numbered_order_lines(o, li, d.where(F.col("status").isin("new", "changed")).select("policy_id"))
    return log.groupBy("id").agg(F.max("version").cast("int").alias("version"),
                                 F.sha2(F.max_by("text", "version"), 256).alias("text_sha"))
