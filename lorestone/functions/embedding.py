"""Vectors of texts by a model that the caller brings: a function of (kind, texts), called batch by batch where the rows are."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of texts, in their order; kind is document or query.
Embedder = Callable[[str, list[str]], list[list[float]]]
KINDS = ("document", "query")
#: What models of one family want before a text, by its kind, and what their names hold.
PREFIXES = {"document": "search_document: ", "query": "search_query: "}
PREFIXED = "nomic"
DIM = 768


def check_kind(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")


def prefixed(kind: str, model: str, text: str) -> str:
    """The text as a model wants it; no name means the family's default model."""
    return PREFIXES.get(kind, "") + text if not model or PREFIXED in model else text


def for_model(call: Callable[[list[str]], list[list[float]]], model: str) -> Embedder:
    """An embedder from a client's call: prefixes where the model wants them, and a vector for each text or an error."""

    def embed(kind: str, texts: list[str]) -> list[list[float]]:
        check_kind(kind)
        found = call([prefixed(kind, model, t) for t in texts])
        if len(found) != len(texts):
            raise ValueError("a text has no vector")
        return found

    return embed


def hashed_embedder(dim: int = DIM) -> Embedder:
    """For tests: unit vectors that depend on kind and text alone, and say nothing of what a text means."""

    def embed(kind: str, texts: list[str]) -> list[list[float]]:
        check_kind(kind)
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.blake2b(f"{kind}\0{t}".encode(), digest_size=8).digest(), "little")
            v = np.random.default_rng(seed).standard_normal(dim)
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out

    return embed


def with_vectors(df: DataFrame, embed: Embedder, kind: str, text: str = "content", out: str = "content_vec") -> DataFrame:
    """df with the vectors of a text column; rows of a batch on which the model fails get empty ones, as do null texts."""
    check_kind(kind)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            told = texts.notna()
            found = pd.Series([[] for _ in texts], index=texts.index, dtype=object)
            try:
                for i, v in zip(texts.index[told], embed(kind, texts[told].tolist())):
                    found[i] = v
            except Exception:  # noqa: BLE001  the model is the caller's: a row without a vector is still a row
                pass
            yield found

    return df.withColumn(out, vectors(F.col(text))).select(*schema.fieldNames())
