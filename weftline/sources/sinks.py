"""Writing rows with their configuration, and looking at a few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Specials, dump
from ..functions.text import decode


def write_rows(df: DataFrame, path: str, config: object | None = None) -> None:
    """Parquet under ``path``, and the configuration as one JSON file beside it."""
    df.write.parquet(path)
    if config is not None:
        spark = df.sparkSession
        spark.createDataFrame([(dump(config),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}_config")


def preview(df: DataFrame, key: str, n: int = 2, specials: Specials | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows in an order drawn from the key: decoder and labels as readable text, and which tokens carry loss.

    ``mask`` is the attention mask as text, a 0 for each pad; ``loss`` has a 1 for each
    label that counts. Columns in ``keep`` that the rows have come along.
    """
    sp = specials or Specials()
    few = df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
    digits = lambda c, test: F.array_join(F.transform(c, lambda x: F.when(test(x), "1").otherwise("0")), "")
    return few.select(
        key, decode(F.col("decoder"), sp).alias("decoder_text"), decode(F.filter("labels", lambda x: x != "-100"), sp).alias("label_text"),
        digits("decoder", lambda x: x != sp.pad).alias("mask"), digits("labels", lambda x: x != "-100").alias("loss"), *(c for c in keep if c in df.columns),
    )


def preview_pairs(pairs: DataFrame, key: str, n: int = 1) -> DataFrame:
    """Labels beside predictions of ``n`` rows, in an order drawn from the key."""
    return pairs.orderBy(F.md5(F.col(key).cast("string")), key, "prediction", "reference").limit(n).select(key, "reference", "prediction")
