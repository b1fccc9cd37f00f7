"""Pretraining rows: autoencoding and text continuation, chosen by a draw for each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Pretraining
from ..functions import arrays as A
from ..functions.rng import randint, uniform
from ..functions.text import Tokenizer, clean_text, space_tokens


def with_tokens(texts: DataFrame, tokenize: Tokenizer = space_tokens) -> DataFrame:
    """(doc_id, tk): cleaned and tokenized once, for all that follows."""
    return texts.select("doc_id", tokenize(clean_text(F.col("text"))).alias("tk"))


def is_autoencode(c: Pretraining) -> Column:
    return uniform(c.lengths.seed, F.col("doc_id"), "task") < c.ae_ratio


def autoencode_chunks(c: Pretraining) -> Column:
    """Up to ``short`` tokens are one chunk, more are chunked at random without a tiny tail."""
    ids = A.head(F.col("tk"), c.lengths.decoder_max)
    spans = A.random_tail_spans(F.col("doc_id"), F.size(ids), c.lengths.compressor_max, c.min_ratio, c.lengths.seed)
    return F.when(F.size(ids) <= c.short, F.array(ids)).otherwise(A.spans_to_chunks(ids, spans))


def split_points(c: Pretraining) -> tuple[Column, Column, Column]:
    """(ids, split, idx): clear text ends at split, compressed text at idx; the rest is the target."""
    ids = A.head(F.col("tk"), c.lengths.compressor_max + c.lengths.decoder_max)
    s = randint(c.lengths.seed, F.col("doc_id"), 0, 31, "split").cast("int")
    idx = F.least(s + c.lengths.compressor_max, F.floor(F.size(ids) / 2).cast("int"))
    return ids, F.least(s, F.floor(idx / 2).cast("int")), idx


def continuation_parts(tokens: DataFrame, c: Pretraining) -> DataFrame:
    """(doc_id, t1, t2, t3)."""
    ids, split, idx = split_points(c)
    rows = tokens.select("doc_id", ids.alias("ids"), split.alias("split"), idx.alias("idx"))
    part = lambda a, b: F.slice("ids", a + 1, b - a)
    return rows.select("doc_id", part(F.lit(0), F.col("split")).alias("t1"), part(F.col("split"), F.col("idx")).alias("t2"), part(F.col("idx"), F.size("ids")).alias("t3"))


def rows(tokens: DataFrame, c: Pretraining, only: str | None = None) -> DataFrame:
    """(doc_id, task, chunks, n_mem, decoder, labels) of one scan; ``only`` takes one task for every text.

    ``decoder`` is cut on the right, which may drop its end and placeholders;
    ``lost_mem`` counts the latter.
    """
    sp, dmax, rate = c.specials, c.lengths.decoder_max, c.lengths.rate
    auto = is_autoencode(c) if only is None else F.lit(only == "autoencode")
    ids, split, idx = split_points(c)
    work = tokens.select("doc_id", "tk", auto.alias("auto"), ids.alias("ids"), split.alias("split"), idx.alias("idx"))
    t2 = F.slice("ids", F.col("split") + 1, F.col("idx") - F.col("split"))
    work = work.withColumn("chunks", F.when(F.col("auto"), autoencode_chunks(c)).otherwise(F.array(t2)))
    work = work.withColumn("n_mem", A.total(A.chunk_mems(F.col("chunks"), rate)))
    mems = F.array_repeat(F.lit(sp.mem), F.col("n_mem"))
    one = lambda t: F.array(F.lit(t))
    auto_ids = F.concat(one(sp.ae), mems, one(sp.bos), F.slice("tk", 1, dmax), one(sp.eos))
    more_ids = F.concat(one(sp.bos), F.slice("ids", 1, F.col("split")), mems, F.slice("ids", F.col("idx") + 1, F.size("ids") - F.col("idx")), one(sp.eos))
    work = work.withColumn("decoder", F.slice(F.when(F.col("auto"), auto_ids).otherwise(more_ids), 1, dmax))
    labels = A.mask_special(F.col("decoder"), sp)
    if c.mask_prefix:
        labels = A.mask_special(A.mask_before_mem(F.col("decoder"), sp.mem), sp)
    work = work.withColumn("labels", labels)
    lost = F.col("n_mem") - F.size(F.filter("decoder", lambda x: x == sp.mem))
    task = F.when(F.col("auto"), "autoencode").otherwise("continuation")
    return work.select("doc_id", task.alias("task"), "chunks", "n_mem", "decoder", "labels", lost.alias("lost_mem"))
