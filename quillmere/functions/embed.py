"""Vectors of texts by an injected function, called on batches in Arrow tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

Embed = Callable[[Sequence[str]], np.ndarray]


def hash_embedding(dim: int = 64) -> Embed:
    """A deterministic stand-in for a model: signed hashed counts of words, as unit vectors."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 32 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def embedded(df: DataFrame, text_col: str, embed: Embed, out_col: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with vectors of ``text_col``; a null text has a null vector.  A column ``out_col`` is replaced.

    The function travels to the tasks once and sees at most ``batch`` texts at a time.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = [None] * len(s)
            there = [i for i, t in enumerate(s) if t is not None]
            for a in range(0, len(there), batch):
                some = there[a : a + batch]
                for i, v in zip(some, np.asarray(embed([s.iloc[i] for i in some]), np.float32)):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return df.withColumn(out_col, run(F.col(text_col)))


def heading_vectors(df: DataFrame, crumb_col: str, embed: Embed, out_col: str = "heading") -> DataFrame:
    """``df`` with vectors of its breadcrumbs; a blank or null one has the zero vector."""
    blank = F.length(F.trim(F.coalesce(F.col(crumb_col), F.lit("")))) == 0
    made = embedded(df.withColumn("__crumb", F.coalesce(F.col(crumb_col), F.lit(""))), "__crumb", embed, out_col).drop("__crumb")
    return made.withColumn(out_col, F.when(blank, F.transform(out_col, lambda x: F.lit(0.0).cast("float"))).otherwise(F.col(out_col)))
