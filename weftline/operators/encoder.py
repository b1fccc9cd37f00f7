"""The boundary to neural models: ids in, vectors or ids out, a batch at a time.

A model is a factory that is called once in each worker and returns a function of
a batch. Models, their training and their checkpoints are not part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import mem_gather

Encode = Callable[[list[list[str]]], list[list[list[float]]]]


def encode(df: DataFrame, key: str, tokens: str, factory: Callable[[], Encode]) -> DataFrame:
    """(key, pos, token, vec) for every position of every row's tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or factory()
            rows = [list(t) for t in b["t"]]
            out = [(k, p, t, v) for k, r, vs in zip(b["k"], rows, model(rows)) for p, (t, v) in enumerate(zip(r, vs))]
            yield pd.DataFrame(out, columns=[key, "pos", "token", "vec"])

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"{key} AS k", f"{tokens} AS t").mapInPandas(run, f"{key} {kind}, pos int, token string, vec array<double>")


def compress(df: DataFrame, key: str, tokens: str, factory: Callable[[], Encode], connect: Callable[[Column], Column], mem: str = "<MEM>") -> DataFrame:
    """(key, mem_ordinal, pos, vec): rows encoded, hidden states gathered at placeholders and sent through the connector."""
    return connected(encode(df, key, tokens, factory), key, connect, mem)


def connected(hidden: DataFrame, key: str, connect: Callable[[Column], Column], mem: str = "<MEM>") -> DataFrame:
    """(key, mem_ordinal, pos, vec) from hidden states (key, pos, token, vec)."""
    return mem_gather(hidden, key, mem).withColumn("vec", connect(F.col("vec")))
