"""Pluggable models, with offline stand-ins that give the same result everywhere."""

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class CrossEncoder(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class LLMBackend(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class HashEmbedder:
    """Bag of hashed words, of unit length: no model, but equal texts are near."""

    def __init__(self, dimension: int = 384) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class OverlapEncoder:
    """Common words over the geometric mean of both counts."""

    def predict(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in pairs]
        return np.array([len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0 for a, b in sets])


class EchoLLM:
    """Answers with its evidence's first sentence, cited; for tests and dry runs."""

    def complete(self, system: str, user: str) -> str:
        first = next((line for line in user.splitlines() if line and not line.startswith("[")), "")
        return f"{first.split('. ')[0].strip()} [1]" if first else "Insufficient evidence."


def embed_column(make: Callable[[], Embedder] = HashEmbedder) -> Callable[[Column | str], Column]:
    """A column of vectors; the model is made once a worker."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist())))

    return run
