"""What a user's own models are called through: an encoder of texts, and an extractor of entities.

Both are made once in each Python worker and get bounded batches; Spark decides which rows meet which
worker. Nothing of a model passes through the driver but the function that makes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that an encoder gets at once, and characters of a text that it sees.
BATCH, MAX_CHARS = 64, 8192

Encoder = Callable[[list[str]], "np.ndarray | tuple[np.ndarray, np.ndarray]"]


def pooled(out: np.ndarray | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Unit vectors of an encoder's output: vectors (n x d), or states of tokens (n x t x d) with their
    mask (n x t), of which the mean is taken. A vector without length stays 0."""
    if isinstance(out, tuple):
        states, mask = (np.asarray(x, dtype=np.float64) for x in out)
        vectors = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1e-9)[:, None]
    else:
        vectors = np.asarray(out, dtype=np.float64)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def embed(make: Callable[[], Encoder], batch: int = BATCH, max_chars: int = MAX_CHARS):
    """A column function from text to a unit vector (array of double). ``make`` is called once in a
    worker and gives the encoder, which gets at most ``batch`` texts at once, longer texts cut to
    ``max_chars``. Null texts have no vector (null) and don't reach the encoder."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in parts:
            out: list = [None] * len(part)
            real = [(i, t[:max_chars]) for i, t in enumerate(part) if t is not None]
            for at in range(0, len(real), batch):
                some = real[at : at + batch]
                for (i, _), v in zip(some, pooled(encode([t for _, t in some])), strict=True):
                    out[i] = v.tolist()
            yield pd.Series(out, index=part.index, dtype="object")

    return vectors


def embedded(df: DataFrame, make: Callable[[], Encoder], text: str = "content", out: str = "v", batch: int = BATCH, max_chars: int = MAX_CHARS) -> DataFrame:
    """``df`` with the vector of each text; equal to what ``vector_search`` takes as ``vec`` (id, v)."""
    return df.withColumn(out, embed(make, batch, max_chars)(F.col(text)))


def hashing_encoder(width: int = 64) -> Callable[[], Encoder]:
    """An encoder without a model: words are hashed to signed places. For tests, and where any vectors
    that grow alike with shared words will do."""

    def make() -> Encoder:
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for row, text in zip(out, texts, strict=True):
                for word in text.lower().split():
                    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                    row[(h >> 1) % width] += 1 if h & 1 else -1
            return out

        return encode

    return make


def extracted(df: DataFrame, make: Callable[[], Callable[[str], str | None]], id_col: str = "id", text: str = "content", blacklist: list[str] = (), cap: int = 10) -> DataFrame:
    """``id, kind, name, type, attr, src, dst, relation``: what an extractor finds in texts. ``make`` is
    called once in a worker and gives a function from a text to a model's answer (JSON with entities and
    relations, bare or in code fences); answers are cleaned as in ``extraction_payload_clean``. Null and
    blank texts and answers that aren't JSON give nothing; a text on which the extractor fails gives
    nothing either, as does one that it answers with None."""
    from ..operators.filters import extraction_payload_clean

    @F.pandas_udf(T.StringType())
    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = make()

        def one(t: str | None) -> str | None:
            if t is None or not t.strip():
                return None
            try:
                return extract(t)
            except Exception:  # a model's failure on one text costs that text only
                return None

        for part in parts:
            yield part.map(one)

    raw = df.select(F.col(id_col).alias("id"), answers(F.col(text)).alias("raw")).filter("raw is not null")
    return extraction_payload_clean(raw, list(blacklist), cap)


def rule_extractor(dictionary: dict[str, tuple[str, str]], cap: int = 10) -> Callable[[], Callable[[str], str | None]]:
    """The default extractor: terms of a dictionary (name: type, attr) and acronyms, as JSON."""

    def make() -> Callable[[str], str | None]:
        import json
        import re

        acronym = re.compile(r"\b[A-Z][A-Z0-9_\-]+\b")
        common = {*dictionary, "http", "https", "www", "api"}

        def extract(text: str) -> str:
            low = text.lower()
            found = [{"name": n, "type": t, "attr": a} for n, (t, a) in sorted(dictionary.items()) if n in low]
            found += [{"name": n, "type": "project", "attr": ""} for n in sorted(set(acronym.findall(text))) if n.lower() not in common]
            return json.dumps({"entities": found[:cap], "relations": []})

        return extract

    return make
