"""Task builders by name: DataFrame to DataFrame, with the placeholder check at hand for all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Pretraining, Rag, Trajectory
from ..operators import batching
from . import pretraining, rag, trajectory

Builder = Callable[[DataFrame], DataFrame]
_builders: dict[str, Builder] = {}


def register(name: str, builder: Builder) -> None:
    """Add a builder of rows with ``chunks`` and ``decoder``; a name is taken once."""
    if name in _builders:
        raise ValueError(f"a task named {name} exists")
    _builders[name] = builder


def build(name: str, df: DataFrame) -> DataFrame:
    if name not in _builders:
        raise KeyError(f"no task named {name}; there are {', '.join(sorted(_builders))}")
    return df.transform(_builders[name])


def check(rows: DataFrame, key: str, rate: int, mem: str = "<MEM>") -> DataFrame:
    """The placeholder check of built rows, record by record."""
    decoder = rows.select(key, F.size(F.filter("decoder", lambda x: x == mem)).alias("n"))
    compressor = batching.compressor_rows(rows, key, "chunks", rate).select(key, F.col("n_mem").alias("n"))
    return batching.mem_consistency(decoder, compressor, key)


register("pretraining", lambda df: pretraining.rows(pretraining.with_tokens(df), Pretraining()))
register("trajectory", lambda df: trajectory.rows(df, Trajectory()))
register("rag", lambda df: rag.rows(df, Rag()))
