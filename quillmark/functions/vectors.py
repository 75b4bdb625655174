"""Vector functions over array columns, and the default embedder."""

from __future__ import annotations

import zlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import CHARS_PER_TOKEN, CHUNK_OVERLAP, embedding_key, tokens_of

Embedder = Callable[[list[str]], np.ndarray]
#: Families of models that read 512 tokens.
SHORT_MODELS, SHORT_TOKENS = re.compile("(?i)minilm|bge-small|mpnet"), 512


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector and for vectors of different lengths, so that they rank last."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Over the common length; 0 for a zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return F.coalesce(F.try_divide(dot(x, y), norm(x) * norm(y)), F.lit(0.0))


def mean_pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the mean of each key's vectors, scaled to length one.  Sums are combined where the rows lie."""
    parts = df.select(key, F.posexplode(doubles(F.col(vector))).alias("dim", "x"))
    mean = parts.groupBy(key, "dim").agg(F.avg("x").alias("x"))
    pooled = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))
    return pooled.select(key, F.transform("v", lambda x: F.try_divide(x, norm(F.col("v")))).alias(vector))


def hashed_words(dimension: int = 384) -> Embedder:
    """A deterministic embedder: words, and pairs of words at half weight, hashed to dimensions; length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = tokens_of(text)
            for weight, parts in ((1.0, words), (0.5, [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])):
                for part in parts:
                    row[zlib.crc32(part.encode()) % dimension] += weight
            length = np.linalg.norm(row)
            if length:
                row /= length
        return out

    return embed


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "vector") -> DataFrame:
    """text and its vector, once for each distinct text; the model is called on Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({text: batch[text], out: list(embedder(batch[text].tolist()))})

    return df.select(text).filter(F.col(text).isNotNull()).distinct().mapInPandas(run, f"`{text}` string, `{out}` array<float>")


def windows(text: str, chars: int, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """chunks() for a literal."""
    step = max(1, chars - overlap)
    return [text[k * step : k * step + chars] for k in range(1 + max(0, -(-(len(text) - chars) // step)))]


def pooled(embedder: Embedder, chars: int, overlap: int = CHUNK_OVERLAP) -> Embedder:
    """The embedder for texts of any length: a text that doesn't fit gets the mean of its windows' vectors, of length one."""

    def embed(texts: list[str]) -> np.ndarray:
        pieces = [windows(t, chars, overlap) for t in texts]
        vectors, out, at = np.asarray(embedder([p for ps in pieces for p in ps]), np.float32), [], 0
        for ps in pieces:
            mean = vectors[at : at + len(ps)].mean(axis=0)
            length = np.linalg.norm(mean)
            out.append(vectors[at] if len(ps) == 1 else mean / length if length else mean)
            at += len(ps)
        return np.asarray(out, np.float32)

    return embed


@dataclass(frozen=True)
class EmbeddingModel:
    """An embedder with its name, dimension and budget of tokens; keys of vectors carry the name."""

    name: str = "hashed-words"
    dimension: int = 384
    chunk_tokens: int = SHORT_TOKENS
    make: Callable[[int], Embedder] = hashed_words

    def configured(self, **changes) -> EmbeddingModel:
        """With changes; the budget of a model of a short family is clamped to what it reads."""
        out = replace(self, **{k: v for k, v in changes.items() if v})
        return replace(out, chunk_tokens=min(out.chunk_tokens, SHORT_TOKENS)) if SHORT_MODELS.search(out.name) else out

    def key(self, text: Column) -> Column:
        return embedding_key(F.lit(self.name), text)

    def embedder(self) -> Embedder:
        return pooled(self.make(self.dimension), self.chunk_tokens * CHARS_PER_TOKEN)


_model: list[EmbeddingModel] = [EmbeddingModel()]


def configure_embeddings(**changes) -> EmbeddingModel:
    """Changes the process's model; returns what holds now."""
    _model[0] = _model[0].configured(**changes)
    return _model[0]


def reset_embeddings() -> EmbeddingModel:
    _model[0] = EmbeddingModel()
    return _model[0]


def embedding_model() -> EmbeddingModel:
    return _model[0]
