"""Retrieval and fusion queries over the ``embeddings`` claim fixture (JON-1/2, FLT-1, AGG-1..3, ORD-1/2, JON-9,
PRJ-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesift.catalog import query
from citesift.operators import fusion
from citesift.operators.knn import knn_join
from citesift.plans import claims as cl
from citesift.sources.tables import read_table

K_LOOP = 5
K_SINGLE = 3

# ---- shared oracle fragments (DuckDB) ------------------------------------------------------------
SQL_Q = """q AS (SELECT vec_id - vec_id % 25 AS claim_id, CAST(vec_id % 25 + 1 AS INTEGER) AS iteration,
                   vec_id AS query_vec_id, embedding::DOUBLE[] AS v, label
            FROM embeddings WHERE vec_id % 25 < 3)"""
SQL_C = """c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 25 >= 3)"""
SQL_KNN5 = """knn AS (
  SELECT claim_id, iteration, id, round(d, 9) AS distance,
         CAST(row_number() OVER (PARTITION BY claim_id, iteration ORDER BY d, id) AS INTEGER) AS rank
  FROM (SELECT q.claim_id, q.iteration, c.id, list_distance(q.v, c.v) ^ 2 AS d
        FROM q CROSS JOIN c)
  QUALIFY rank <= 5)"""
SQL_RRF = """fused AS (
  SELECT claim_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score,
         arg_min(iteration, iteration * 1000 + rank) AS first_list,
         arg_min(rank, iteration * 1000 + rank) AS first_rank
  FROM knn GROUP BY claim_id, id)"""
SQL_FUSED_RANK = """CAST(row_number() OVER (PARTITION BY claim_id
                    ORDER BY round(score, 9) DESC, first_list, first_rank, id) AS INTEGER)"""

WITH_KNN5 = f"WITH {SQL_Q},\n{SQL_C},\n{SQL_KNN5}"


def loop_hits(spark, sf_dir, k=K_LOOP, scope=False):
    emb = read_table(spark, sf_dir, "embeddings")
    q = cl.query_vectors(emb)
    c = cl.corpus_vectors(emb)
    return knn_join(q, c, k, query_keys=["claim_id", "iteration"], corpus_key="id", round_digits=9,
                    scope_col="label" if scope else None)


def fused_all(spark, sf_dir):
    hits = loop_hits(spark, sf_dir)
    return fusion.rrf(hits, ["claim_id"], list_col="iteration", rank_col="rank")


def _rounded_score(df):
    return df.withColumn("score", F.round("score", 9))


@query("knn_topk", sql=f"""{WITH_KNN5}
SELECT claim_id, iteration, id, distance, rank FROM knn""")
def knn_topk(spark, sf_dir):
    """JON-1 + WIN-1: top-5 corpus vectors for every claim query vector."""
    return loop_hits(spark, sf_dir).select("claim_id", "iteration", "id", "distance", "rank")


@query("knn_topk_blocked", sql=f"""{WITH_KNN5}
SELECT claim_id, iteration, id, distance, rank FROM knn""")
def knn_topk_blocked(spark, sf_dir):
    """JON-1 with small blocks, forcing many cells per query: must equal the single-block answer."""
    emb = read_table(spark, sf_dir, "embeddings")
    hits = knn_join(cl.query_vectors(emb), cl.corpus_vectors(emb), K_LOOP,
                    query_keys=["claim_id", "iteration"], corpus_key="id",
                    corpus_block_rows=64, query_block_rows=16, round_digits=9)
    return hits.select("claim_id", "iteration", "id", "distance", "rank")


@query("rrf_fusion", sql=f"""{WITH_KNN5},
{SQL_RRF}
SELECT claim_id, id, score, first_list, first_rank FROM fused""")
def rrf_fusion(spark, sf_dir):
    """AGG-1: reciprocal rank fusion of the three lists of every claim."""
    return _rounded_score(fused_all(spark, sf_dir)).select(
        "claim_id", "id", "score", F.col("first_list").cast("int").alias("first_list"), "first_rank")


@query("rrf_top3", sql=f"""{WITH_KNN5},
{SQL_RRF}
SELECT claim_id, id, score, {SQL_FUSED_RANK} AS fused_rank FROM fused QUALIFY fused_rank <= 3""")
def rrf_top3(spark, sf_dir):
    """ORD-1: the flagship — k-NN per iteration, RRF, top 3 per claim."""
    top = fusion.fused_order(fused_all(spark, sf_dir), ["claim_id"], n=3)
    return _rounded_score(top).select("claim_id", "id", "score", "fused_rank")


@query("min_distance_fusion", sql=f"""{WITH_KNN5}
SELECT claim_id, id, min_distance,
       CAST(row_number() OVER (PARTITION BY claim_id ORDER BY min_distance, id) AS INTEGER) AS fused_rank
FROM (SELECT claim_id, id, min(distance) AS min_distance FROM knn GROUP BY claim_id, id)
QUALIFY fused_rank <= 3""")
def min_distance_fusion(spark, sf_dir):
    """AGG-2: the rejected min-distance merge, top 3 per claim."""
    hits = loop_hits(spark, sf_dir)
    merged = fusion.min_distance_fusion(hits, ["claim_id"])
    return fusion.min_distance_order(merged, ["claim_id"], n=3).select("claim_id", "id", "min_distance", "fused_rank")


@query("union_dedup_fusion", sql=f"""{WITH_KNN5}
SELECT DISTINCT claim_id, id FROM knn""")
def union_dedup_fusion(spark, sf_dir):
    """AGG-3: union of all lists with duplicates removed, no score."""
    return fusion.union_dedup_fusion(loop_hits(spark, sf_dir), ["claim_id"])


@query("single_shot_top3", sql=f"""WITH {SQL_Q},
{SQL_C}
SELECT claim_id, id, round(d, 9) AS distance,
       CAST(row_number() OVER (PARTITION BY claim_id ORDER BY d, id) AS INTEGER) AS rank
FROM (SELECT q.claim_id, c.id, list_distance(q.v, c.v) ^ 2 AS d
      FROM q CROSS JOIN c WHERE q.iteration = 1)
QUALIFY rank <= 3""")
def single_shot_top3(spark, sf_dir):
    """ORD-2: single-shot retrieval uses the claim as written (iteration 1) and k = 3."""
    emb = read_table(spark, sf_dir, "embeddings")
    q = cl.query_vectors(emb).where(F.col("iteration") == 1)
    return knn_join(q, cl.corpus_vectors(emb), K_SINGLE, query_keys=["claim_id"], corpus_key="id", round_digits=9).select(
        "claim_id", "id", "distance", "rank")


SQL_SCOPED = f"""WITH {SQL_Q},
{SQL_C}
SELECT claim_id, iteration, label, id, round(d, 9) AS distance,
       CAST(row_number() OVER (PARTITION BY claim_id, iteration ORDER BY d, id) AS INTEGER) AS rank
FROM (SELECT q.claim_id, q.iteration, q.label, c.id, list_distance(q.v, c.v) ^ 2 AS d
      FROM q JOIN c ON q.label = c.label)
QUALIFY rank <= 5"""


@query("knn_scoped", sql=SQL_SCOPED)
def knn_scoped(spark, sf_dir):
    """JON-2: k-NN restricted to corpus rows of the query's own label."""
    return loop_hits(spark, sf_dir, scope=True).select("claim_id", "iteration", "label", "id", "distance", "rank")


@query("scoped_prefilter", sql=SQL_SCOPED)
def scoped_prefilter(spark, sf_dir):
    """FLT-1: scope filter applied before ranking (same rows as the scoped join, via the public API)."""
    return knn_scoped(spark, sf_dir)


@query("postfilter_loss", sql=f"""{WITH_KNN5},
post AS (SELECT knn.claim_id, knn.iteration, count(*) AS kept
         FROM knn JOIN q ON q.claim_id = knn.claim_id AND q.iteration = knn.iteration
                  JOIN c ON c.id = knn.id AND c.label = q.label
         GROUP BY ALL)
SELECT q.claim_id, q.iteration, CAST(coalesce(post.kept, 0) AS BIGINT) AS kept_after_postfilter,
       CAST(5 - coalesce(post.kept, 0) AS BIGINT) AS lost_to_postfilter
FROM q LEFT JOIN post ON post.claim_id = q.claim_id AND post.iteration = q.iteration""")
def postfilter_loss(spark, sf_dir):
    """FLT-1 contrast: filtering the global top-5 by scope afterwards keeps fewer than 5 hits."""
    emb = read_table(spark, sf_dir, "embeddings")
    q = cl.query_vectors(emb).select("claim_id", "iteration", F.col("label").alias("q_label"))
    c = cl.corpus_vectors(emb).select("id", F.col("label").alias("c_label"))
    hits = loop_hits(spark, sf_dir)
    kept = (hits.join(q, ["claim_id", "iteration"]).join(c, "id")
            .where(F.col("q_label") == F.col("c_label"))
            .groupBy("claim_id", "iteration").agg(F.count(F.lit(1)).alias("kept")))
    return (q.join(kept, ["claim_id", "iteration"], "left")
            .select("claim_id", "iteration",
                    F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept_after_postfilter"),
                    (F.lit(K_LOOP) - F.coalesce("kept", F.lit(0))).cast("bigint").alias("lost_to_postfilter")))


@query("cosine_distance", sql=f"""WITH {SQL_Q},
{SQL_C}
SELECT claim_id, iteration, id, round(d, 9) AS distance,
       CAST(row_number() OVER (PARTITION BY claim_id, iteration ORDER BY d, id) AS INTEGER) AS rank
FROM (SELECT q.claim_id, q.iteration, c.id, 1 - list_cosine_similarity(q.v, c.v) AS d
      FROM q CROSS JOIN c)
QUALIFY rank <= 5""")
def cosine_distance(spark, sf_dir):
    """PRJ-11: the hosted store's ``1 - similarity`` metric, top 5."""
    emb = read_table(spark, sf_dir, "embeddings")
    return knn_join(cl.query_vectors(emb), cl.corpus_vectors(emb), K_LOOP, query_keys=["claim_id", "iteration"],
                    corpus_key="id", metric="cosine", round_digits=9).select("claim_id", "iteration", "id", "distance", "rank")


@query("fused_with_metadata", sql=f"""{WITH_KNN5},
{SQL_RRF},
top AS (SELECT claim_id, id, {SQL_FUSED_RANK} AS fused_rank FROM fused QUALIFY fused_rank <= 3)
SELECT top.claim_id, top.fused_rank, top.id, c.label AS clause_label,
       'clause-' || CAST(top.id AS VARCHAR) AS clause_id
FROM top JOIN c ON c.id = top.id""")
def fused_with_metadata(spark, sf_dir):
    """JON-9: attach corpus metadata to the fused top 3."""
    emb = read_table(spark, sf_dir, "embeddings")
    meta = cl.corpus_vectors(emb).select("id", F.col("label").alias("clause_label"),
                                         F.concat(F.lit("clause-"), F.col("id").cast("string")).alias("clause_id"))
    top = fusion.fused_order(fused_all(spark, sf_dir), ["claim_id"], n=3)
    return fusion.attach_payload(top.select("claim_id", "fused_rank", "id"), meta).select(
        "claim_id", "fused_rank", "id", "clause_label", "clause_id")


@query("knn_lsh_recall")
def knn_lsh_recall(spark, sf_dir):
    """JON-3: approximate top-5 by random-hyperplane buckets (exact ranking inside buckets), with its
    recall@5 against the exact join per query.  Rows only: the buckets depend on the random planes."""
    from citesift.operators.lsh import knn_lsh, recall_at_k
    emb = read_table(spark, sf_dir, "embeddings")
    q, c = cl.query_vectors(emb), cl.corpus_vectors(emb)
    approx = knn_lsh(q, c, K_LOOP, query_keys=["claim_id", "iteration"], corpus_key="id", dim=64)
    exact = loop_hits(spark, sf_dir)
    return recall_at_k(approx, exact, ["claim_id", "iteration"])


@query("vector_store", sql=SQL_SCOPED)
def vector_store(spark, sf_dir):
    """UDF-4: the store object: two upserts that overlap, then a scoped query over what is stored."""
    from citesift.session import work_dir
    from citesift.sinks.store import get_store
    emb = read_table(spark, sf_dir, "embeddings")
    store = get_store("table", spark, work_dir(spark, "store"))
    corpus = cl.corpus_vectors(emb)
    store.upsert(corpus.where(F.col("id") % 3 < 2))
    store.upsert(corpus.where(F.col("id") % 3 > 0))
    hits = store.query(cl.query_vectors(emb), K_LOOP, query_keys=["claim_id", "iteration"], scope="label", round_digits=9)
    return hits.select("claim_id", "iteration", "label", "id", "distance", "rank")
