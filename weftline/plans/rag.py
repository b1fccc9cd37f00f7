"""Question answering over compressed documents: chunks, prompt, labels. No shuffle: each record is one row throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rag
from ..functions import arrays as A
from ..functions import text as T


def kept_docs(c: Rag) -> Column:
    """The documents that are read: the query put in front if asked for, cleaned, the first ``topk_docs``."""
    docs = F.col("docs") if c.topk_docs is None else F.slice("docs", 1, c.topk_docs)
    if c.query_dependent:
        docs = F.transform(docs, lambda d: T.query_prefix(T.clean_text(F.col("query")), d))
    return F.transform(docs, lambda d: T.clean_text(d))


def doc_chunks(tokens: Column, c: Rag) -> Column:
    """The chunks of every document's tokens: one truncated chunk, or fixed chunks up to ``n_max_chunks``."""
    cmax = c.lengths.compressor_max
    if not c.chunk_docs:
        return F.transform(tokens, lambda d: F.array(A.head(d, cmax)))
    chunks = F.transform(tokens, lambda d: A.fixed_chunks(d, cmax, c.chunk_overlap))
    return chunks if c.n_max_chunks is None else F.transform(chunks, lambda d: F.slice(d, 1, c.n_max_chunks))


def with_docs(questions: DataFrame, c: Rag, tokenize: T.Tokenizer = T.space_tokens) -> DataFrame:
    """``by_doc`` and ``n_mems`` of each record; documents are tokenized once, in a column of their own."""
    work = questions.withColumn("doc_tokens", F.transform(kept_docs(c), lambda d: tokenize(d)))
    work = work.withColumn("by_doc", doc_chunks(F.col("doc_tokens"), c))
    return work.withColumn("n_mems", F.transform("by_doc", lambda d: A.total(A.chunk_mems(d, c.lengths.rate)))).drop("doc_tokens")


def prompts(questions: DataFrame, c: Rag, section: Column) -> DataFrame:
    """``system``, ``user`` and ``answer`` as texts; a null label stays null and asks for generation."""
    user = T.rag_prompt(c, section, T.clean_text(F.col("query")))
    return questions.withColumns({"system": F.lit(c.system_prompt), "user": user, "answer": T.clean_text(F.col("label"))})


def rows(questions: DataFrame, c: Rag, tokenize: T.Tokenizer = T.space_tokens) -> DataFrame:
    """(ex_id, chunks, n_mems, n_mem, prefix, decoder, labels, n_loss, lost_mem).

    ``prefix`` is the prompt's length with an empty answer, before truncation; a row
    whose prompt fills the decoder keeps no loss (``n_loss`` 0). ``n_mems`` has one
    number for each document.
    """
    sp = c.specials
    work = with_docs(questions, c, tokenize)
    work = prompts(work, c, T.spaced_section(F.col("n_mems"), sp.mem))
    work = work.withColumns({"whole": T.render_chat(F.col("system"), F.col("user"), F.col("answer")), "opened": T.render_chat(F.col("system"), F.col("user"), F.lit(""))})
    work = work.withColumns({"decoder": A.head(tokenize(F.col("whole")), c.lengths.decoder_max), "prefix": F.size(tokenize(F.col("opened")))})
    masked = A.mask_special(A.mask_prefix(F.col("decoder"), F.col("prefix"), sp.pad, c.margin), sp)
    work = work.withColumn("labels", F.when(F.col("answer").isNull(), F.transform("decoder", lambda x: F.lit(A.IGNORED))).otherwise(masked))
    return work.select(
        "ex_id", F.flatten("by_doc").alias("chunks"), "n_mems", A.total(F.col("n_mems")).alias("n_mem"), "prefix", "decoder", "labels",
        F.size(F.filter("labels", lambda x: x != A.IGNORED)).alias("n_loss"), (A.total(F.col("n_mems")) - F.size(F.filter("decoder", lambda x: x == sp.mem))).alias("lost_mem"),
    )
