"""Embedders: a registry of providers, and two hashing embedders that need no model.

A provider embeds words, not texts, where it can: the hashing embedders map each distinct word of the corpus to a bucket
and a sign once, and everything else is a join and a sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import hashing_tokens

DIMENSION = 384


@dataclass
class Embedder:
    model_name: str
    dimension: int
    bucket_of: Callable[[Column, int], Column]
    normalization: str = "l2"
    options: dict = field(default_factory=dict)


_PROVIDERS: dict[str, Callable[..., Embedder]] = {}


def register_embedder(provider: str, factory: Callable[..., Embedder] | None = None, replace: bool = False):
    """Register a factory under a lower-cased name; usable as a decorator. A name can't be taken twice."""

    def add(f: Callable[..., Embedder]):
        name = provider.strip().lower()
        if not name:
            raise ValueError("a provider needs a name")
        if name in _PROVIDERS and not replace:
            raise ValueError(f"provider {name} is already registered")
        _PROVIDERS[name] = f
        return f

    return add(factory) if factory else add


def unregister_embedder(provider: str) -> None:
    _PROVIDERS.pop(provider.strip().lower(), None)


def embedding_providers() -> list[str]:
    return sorted(_PROVIDERS)


def parse_model_spec(model: str) -> tuple[str, str | None]:
    """`provider:model`, or a provider alone."""
    provider, _, name = model.partition(":")
    return provider.strip().lower(), name.strip() or None


def get_embedder(model: str, **options) -> Embedder:
    provider, name = parse_model_spec(model)
    if provider not in _PROVIDERS:
        raise ValueError(f"unknown provider {provider}; there are {', '.join(embedding_providers())}")
    return _PROVIDERS[provider](**({"dimension": int(name)} if name and name.isdigit() else {}), **options)


def _sha256_bucket(word: Column, dimension: int) -> Column:
    digest = F.sha2(word, 256)
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("long") % 2 == 1, -1).otherwise(1)
    return F.struct((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension).cast("int").alias("bucket"), sign.alias("sign"))


_BUCKET = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sign", T.IntegerType())])


def _blake2b_bucket(word: Column, dimension: int) -> Column:
    def of(words: pd.Series) -> pd.DataFrame:
        digests = [hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words]
        return pd.DataFrame({"bucket": [int.from_bytes(d[:4], "little") % dimension for d in digests], "sign": [-1 if d[4] & 1 else 1 for d in digests]}).astype("int32")

    return F.pandas_udf(of, _BUCKET)(word)


@register_embedder("hashing")
def _hashing(dimension: int = DIMENSION) -> Embedder:
    return Embedder(f"hashing-{dimension}", dimension, _blake2b_bucket)


@register_embedder("hashing-sha256")
def _hashing_sha256(dimension: int = DIMENSION) -> Embedder:
    return Embedder(f"hashing-sha256-{dimension}", dimension, _sha256_bucket)


def sparse_embed(texts: DataFrame, key: list[str], embedder: Embedder) -> DataFrame:
    """key columns, bucket, value: the non-zero buckets of each text, unnormalised. The vocabulary is hashed once."""
    words = texts.select(*key, F.explode(hashing_tokens(F.col("text"))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))
    vocabulary = words.select("word").distinct().withColumn("b", embedder.bucket_of(F.col("word"), embedder.dimension)).select("word", "b.bucket", "b.sign")
    summed = words.join(vocabulary, "word").groupBy(*key, "bucket").agg(F.sum(F.col("tf") * F.col("sign")).cast("double").alias("value"))
    return summed.where("value <> 0")
