"""The row-wise stages on streams, and what needs a whole batch on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import arrays as A
from ..functions.text import clean_text, space_tokens


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream, oldest first."""
    folder = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def chunk_counts(texts: DataFrame, length: int, rate: int) -> DataFrame:
    """(doc_id, loaded_at, n_tokens, n_chunks, n_mem) of each text; works on streams and on tables alike."""
    tk = space_tokens(clean_text(F.col("text")))
    rows = texts.where("text is not null").select("doc_id", "loaded_at", F.size(tk).alias("n_tokens"), A.fixed_chunks(tk, length).alias("chunks"))
    return rows.select("doc_id", "loaded_at", "n_tokens", F.size("chunks").alias("n_chunks"), A.total(A.chunk_mems(F.col("chunks"), rate)).alias("n_mem"))


def once(df: DataFrame, key: str, late: str = "30 days") -> DataFrame:
    """A record delivered again within ``late`` of the watermark is dropped; state older than that is forgotten."""
    return df.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark([key])


def windows(df: DataFrame, size: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window_start, records, tokens) of tumbling windows of load time."""
    grouped = df.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", size))
    return grouped.agg(F.count("*").alias("records"), F.sum("n_tokens").alias("tokens")).select(F.col("window.start").alias("window_start"), "records", "tokens")


def each_batch(df: DataFrame, checkpoint: str, plan: Callable[[DataFrame], DataFrame], out: str) -> StreamingQuery:
    """Run a plan that needs whole batches (batch ids, padding) on every micro-batch and append its rows."""

    def write(batch: DataFrame, batch_no: int) -> None:
        plan(batch).withColumn("micro_batch", F.lit(batch_no)).write.mode("overwrite").parquet(f"{out}/micro_batch_{batch_no}")  # a retried batch replaces its rows

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
