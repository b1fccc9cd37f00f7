"""Vectors at placeholders: gather, connector, scatter, lookup, argmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import positions


def mem_gather(hidden: DataFrame, key: str, mem: str = "<MEM>") -> DataFrame:
    """(key, mem_ordinal, pos, vec): hidden states at placeholders, in order, from (key, pos, token, vec)."""
    rows = hidden.where(F.col("token") == mem)
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return rows.select(key, ordinal.alias("mem_ordinal"), "pos", "vec")


def connector(vec: Column, w1: list[list[float]], b1: list[float], w2: list[list[float]], b2: list[float]) -> Column:
    """Linear, ReLU, Linear over a vector column, a batch of rows at a time; null vectors stay null."""
    m1, c1, m2, c2 = (np.asarray(x, float) for x in (w1, b1, w2, b2))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            good = s.notna().to_numpy()
            out: list = [None] * len(s)
            if good.any():
                x = np.stack(s[good].to_numpy()).astype(float)
                y = np.maximum(x @ m1.T + c1, 0) @ m2.T + c2
                for at, v in zip(np.flatnonzero(good), y):
                    out[at] = v
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(vec)


def scatter(places: DataFrame, compressed: DataFrame, key: str) -> DataFrame:
    """(key, pos, mem_ordinal, vec): the k-th placeholder of a record takes its k-th compressed vector.

    ``places`` has (key, pos), ``compressed`` (key, mem_ordinal, vec). A placeholder
    without a vector keeps a null ``vec``; vectors without a place do not appear, and
    :func:`weftline.operators.batching.mem_consistency` counts both.
    """
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return places.select(key, "pos", ordinal.alias("mem_ordinal")).join(compressed, [key, "mem_ordinal"], "left")


def scatter_in_row(tokens: Column, vecs: Column, mem: str = "<MEM>") -> Column:
    """(pos, mem_ordinal, vec) of a row's placeholders, from the row's own vectors in order; no join."""
    return F.transform(positions(tokens, mem), lambda pos, k: F.struct(pos.alias("pos"), k.alias("mem_ordinal"), F.get(vecs, k).alias("vec")))


#: Rows of a vocabulary that is broadcast, and the parts of one that is not.
MOST_BROADCAST, SALTS = 1_000_000, 16


def lookup(tokens: DataFrame, vocabulary: DataFrame, token: str = "token", most: int = MOST_BROADCAST) -> DataFrame:
    """Each token's row with its vector from (token, vec), one row a token; unknown tokens get null.

    A vocabulary of at most ``most`` rows is broadcast; beyond that its rows are repeated
    ``SALTS`` times, so that frequent tokens are spread over as many tasks.
    """
    if vocabulary.count() <= most:
        return tokens.join(F.broadcast(vocabulary), token, "left")
    spread = vocabulary.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = tokens.withColumn("__salt", F.pmod(F.xxhash64(*tokens.columns), F.lit(SALTS)).cast("int"))  # by hash, so that a task run again gives the same
    return salted.join(spread, [token, "__salt"], "left").drop("__salt")


def argmax(values: Column) -> Column:
    """Position, from 0, of the first largest value; null for none."""
    return F.when(F.size(values) > 0, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
