"""Batches: which rows go together, and the padding that depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..sources.tables import by_id


def assign(df: DataFrame, key: str, size: int = 4) -> DataFrame:
    """``batch_id`` by the order of the key; chunk rows inherit it from their record by a join on the key."""
    return by_id(df, key).withColumn("batch_id", F.floor(F.col("row_no") / size)).drop("row_no")


def padded(df: DataFrame, tokens: str, pad: str) -> DataFrame:
    """``width``, ``padded`` and ``mask`` of each row: left-padded to the longest of its batch."""
    width = F.max(F.size(tokens)).over(Window.partitionBy("batch_id"))
    df = df.withColumn("width", width)
    return df.withColumns({"padded": A.left_pad(F.col(tokens), F.col("width"), pad), "mask": A.attention_mask(F.size(tokens), F.col("width"))})


def compressor_rows(df: DataFrame, key: str, chunks: str, rate: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each chunk: (key, chunk_no, chunk, n_mem)."""
    rows = df.select(key, *keep, F.posexplode(chunks).alias("chunk_no", "chunk"))
    return rows.withColumn("n_mem", A.n_mem(F.size("chunk"), rate))


def mem_consistency(decoder: DataFrame, compressor: DataFrame, key: str) -> DataFrame:
    """One row: in how many records decoder and compressor hold different numbers of placeholders.

    ``decoder`` and ``compressor`` have (key, n). A record on one side only counts
    with 0 on the other.
    """
    a = decoder.groupBy(key).agg(F.sum("n").alias("in_decoder"))
    b = compressor.groupBy(key).agg(F.sum("n").alias("in_compressor"))
    both = a.join(b, key, "full").fillna(0, ["in_decoder", "in_compressor"])
    return both.agg(F.count_if(F.col("in_decoder") != F.col("in_compressor")).alias("n_mismatch"), F.count("*").alias("n_records"))


def width_check(compressor: DataFrame, longest: int, rate: int) -> DataFrame:
    """One row: the widest compressor row with placeholders, its bound, and whether it holds."""
    bound = longest + longest // rate + 2
    widest = F.max(F.size("chunk") + F.col("n_mem"))
    return compressor.agg(widest.cast("bigint").alias("widest")).select("widest", F.lit(bound).cast("bigint").alias("bound"), (F.coalesce("widest", F.lit(0)) <= bound).alias("fits"))


def asserted(df: DataFrame, good: Column, message: str) -> DataFrame:
    """The same rows; a row for which ``good`` does not hold stops the job."""
    return df.where(F.when(good, True).otherwise(F.raise_error(message).cast("boolean")))
