"""Model slots: completion providers chosen by name (UDF-2) with retry and failure classification (UDF-3),
and embedding models (UDF-1).

A provider that can be written as a column expression (the offline deterministic one) runs inside the JVM.
Any other provider — a network client a user registers — is built once per task inside ``mapInPandas`` and
called per prompt; each prompt is tried up to ``max_attempts`` times and the call returns
``(completion, attempts, failure_type)`` instead of raising, so one failing prompt never fails the job.
An embedding model registered by name is built once per task inside an iterator ``pandas_udf``; the default
``hashed`` model stays a pure column expression.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.functions import text as tx
from citesift.operators.attempts import FAILURE_PERMANENT, FAILURE_TRANSIENT, LLM_BACKOFF_BASE_S, LLM_MAX_ATTEMPTS
from citesift.session import ship_package

DEFAULT_MAX_TOKENS = 512


class ProviderError(Exception):
    """Base of the errors a provider raises for one prompt."""


class TransientProviderError(ProviderError):
    """Worth retrying (timeouts, rate limits)."""


class PermanentProviderError(ProviderError):
    """Retrying cannot help (bad request, refused content)."""


class Provider:
    """``complete`` answers one prompt; ``column`` may offer the same answer as a JVM expression."""

    def complete(self, prompt: str, max_tokens: int = DEFAULT_MAX_TOKENS) -> str:
        raise NotImplementedError

    def column(self, prompt: Column) -> Column | None:
        return None

    def column_failure(self, prompt: Column) -> Column:
        """The failure type of a prompt that the column form does not answer, else null."""
        return F.lit(None).cast("string")


class DeterministicProvider(Provider):
    """PRJ-5: a JSON answer carrying the first 8 hex digits of SHA-256(prompt), as a JVM expression."""

    def column(self, prompt: Column) -> Column:
        return tx.deterministic_completion(prompt)


PROVIDERS: dict[str, Callable[[], Provider]] = {"deterministic": DeterministicProvider}


def register_provider(name: str, factory: Callable[[], Provider]) -> None:
    PROVIDERS[name] = factory


def get_provider(name: str) -> Provider:
    """The provider registered under ``name``; an unknown name is an error."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]()


def call_with_retry(provider: Provider, prompt: str, *, max_tokens: int = DEFAULT_MAX_TOKENS,
                    max_attempts: int = LLM_MAX_ATTEMPTS, backoff_s: float = LLM_BACKOFF_BASE_S,
                    sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """UDF-3 for one prompt: (text, attempts used, failure type).  A permanent error fails at once; a
    transient one is retried after ``backoff_s * 2^(n-1)`` seconds until ``max_attempts``."""
    for n in range(1, max_attempts + 1):
        try:
            return provider.complete(prompt, max_tokens), n, None
        except TransientProviderError:
            if n == max_attempts:
                return None, n, FAILURE_TRANSIENT
            sleep(backoff_s * 2 ** (n - 1))
        except PermanentProviderError:
            return None, n, FAILURE_PERMANENT
        # any other exception is a fault of the provider itself and fails the job
    return None, max_attempts, FAILURE_TRANSIENT


def complete(df: DataFrame, prompt_col: str, *, provider: str = "deterministic", out_col: str = "completion",
             max_tokens: int = DEFAULT_MAX_TOKENS, max_attempts: int = LLM_MAX_ATTEMPTS,
             backoff_s: float = LLM_BACKOFF_BASE_S, prefer_column: bool = True) -> DataFrame:
    """UDF-2/3: add ``out_col``, ``attempts`` (int) and ``failure_type`` (null when answered) to every row.

    A null prompt is not sent and gets a null completion.
    """
    probe = get_provider(provider).column(F.col(prompt_col)) if prefer_column else None  # unknown name fails here
    factory = PROVIDERS[provider]  # resolved on the driver and shipped with the task (registries are per process)
    if probe is not None:
        sent = F.col(prompt_col).isNotNull()
        failure = F.when(sent, get_provider(provider).column_failure(F.col(prompt_col)))
        # the columns and their order are those of the other path
        return df.select("*", F.when(sent & failure.isNull(), probe).alias(out_col),
                         F.when(sent, F.lit(1)).otherwise(F.lit(0)).alias("attempts"), failure.alias("failure_type"))
    ship_package(df.sparkSession)  # the task below refers to the package's classes
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()),
                                              T.StructField("attempts", T.IntegerType()),
                                              T.StructField("failure_type", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prov = factory()  # built once per task
        for pdf in batches:
            out = [call_with_retry(prov, p, max_tokens=max_tokens, max_attempts=max_attempts, backoff_s=backoff_s)
                   if p is not None else (None, 0, None) for p in pdf[prompt_col]]
            yield pdf.assign(**{out_col: [o[0] for o in out],
                                "attempts": pd.array([o[1] for o in out], dtype="int32"),
                                "failure_type": [o[2] for o in out]})

    return df.mapInPandas(run, schema)


# ---- embedding models (UDF-1) ------------------------------------------------------------------------
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]] = {}


def register_embedder(name: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]]) -> None:
    """``factory()`` builds the model (once per task) and returns ``encode(texts) -> vectors``."""
    EMBEDDERS[name] = factory


def embed(df: DataFrame, key: str, text: str, *, model: str = "hashed", dim: int = tx.HASH_DIM) -> DataFrame:
    """(key, embedding array<float>) with the named model; ``hashed`` is the built-in column model."""
    if model == "hashed":
        return tx.embed_hashed(df, key, text, dim)
    return df.select(key, encoder(df.sparkSession, text, model).alias("embedding"))


def encoder(spark: SparkSession, text: str, model: str = "hashed") -> Column:
    """The vector of a row's own text with the named model; ``hashed`` gives null for a text without tokens."""
    if model != "hashed" and model not in EMBEDDERS:
        raise ValueError(f"unknown embedding model {model!r}; known: {sorted(['hashed', *EMBEDDERS])}")
    ship_package(spark)
    if model == "hashed":
        return tx.hashed_vector(text)
    factory = EMBEDDERS[model]

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = factory()  # model loaded once per task, reused for every Arrow batch
        for s in texts:
            yield pd.Series(list(enc(s.fillna("").tolist())))

    return encode(F.col(text))
