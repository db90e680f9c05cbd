"""The registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.llm.chat_masks import format_chats, read_back
from citesift.llm.collocations import collocations
from citesift.llm.entropy_mix import entropy_mix
from citesift.llm.exact_dedup import exact_groups
from citesift.llm.kd_shards import kd_shards
from citesift.llm.merkle_manifest import merkle_manifest
from citesift.llm.norm_buckets import top_products
from citesift.llm.projection_passes import near_vectors
from citesift.llm.repeat_automata import repeat_digests
from citesift.llm.shared import scan
from citesift.llm.statements import ORACLES
from citesift.llm.suffix_pieces import encode
from citesift.llm.token_counts import token_counts
from citesift.llm.toxicity import fit, held_out, toxicity_scores
from citesift.llm.weighted_minhash import near_texts

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(scan(spark, sf_dir, "documents"))


@register
def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(scan(spark, sf_dir, "documents"))


@register
def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(scan(spark, sf_dir, "documents"), shards=24)


@register
def op10_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = scan(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return read_back(format_chats(given.unionByName(probe)))


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, fit(docs, scan(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register
def op2_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(scan(spark, sf_dir, "embeddings"), cosine=0.98)


@register
def op9_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(scan(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


@register
def op1_repeat_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(scan(spark, sf_dir, "documents"), length=50)


@register
def op3_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(scan(spark, sf_dir, "documents"))


@register
def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(scan(spark, sf_dir, "documents"), similar=0.8, shingle=5).select("doc_id", "class_id", "kept")


@register
def op11_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(scan(spark, sf_dir, "documents"))


@register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(scan(spark, sf_dir, "documents"))


@register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(scan(spark, sf_dir, "documents"), least=10, most=2000)
