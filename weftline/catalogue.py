"""Every query of the engine's own operators, with its SQL.

Each query reads whole tables. Counts are bigint and token arrays are shown as
text, so that both engines give the same types.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as S
from .config import Pretraining, Rag, Specials, Trajectory
from .functions import arrays as A
from .functions import text as T
from .functions.rng import uniform
from .operators import batching, encoder, metrics, vectors
from .plans import pretraining, rag, registry, trajectory
from .sources import tables
from .sources.sinks import preview, preview_pairs
from .streaming import rows as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SP, PRE, TRAJ, RAG = Specials(), Pretraining(), Trajectory(), Rag()
CMAX, DMAX, RATE, OVERLAP, TOPK, BATCH, SEED = S.CMAX, S.DMAX, S.RATE, S.OVERLAP, S.TOPK, S.BATCH, S.SEED


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def joined(tokens: Column | str) -> Column:
    return F.array_join(tokens, " ")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pretraining.with_tokens(tables.texts(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str, overlap: int = 0) -> DataFrame:
    rows = _tokens(spark, sf_dir).select("doc_id", A.fixed_chunks(F.col("tk"), CMAX, overlap).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


# -- sources, limits, splits ------------------------------------------------------------


@query("SELECT doc_id, lang, source, length(text) AS n_chars FROM documents")
def scan_documents(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.char_length("text").alias("n_chars"))


@query(S.with_(S.TEXTS) + "SELECT doc_id, text FROM p ORDER BY doc_id LIMIT 1000")
def limit_samples(spark, sf_dir):
    return tables.first_rows(tables.texts(spark, sf_dir), "doc_id", 1000)


@query(S.with_(S.TEXTS, "k AS (SELECT least(64, count(*) // 10) AS k FROM p)") + f"SELECT doc_id, row_number() OVER (ORDER BY {S.u32('doc_id', 'split')}, doc_id) <= (SELECT k FROM k) AS is_test FROM p")
def train_test_split(spark, sf_dir):
    return tables.train_test_split(tables.texts(spark, sf_dir).select("doc_id"), "doc_id", SEED)


@query(S.with_(S.TEXTS) + f"SELECT doc_id, row_number() OVER (ORDER BY {S.u32('doc_id', 'shuffle')}, doc_id) - 1 AS place FROM p")
def shuffle_train(spark, sf_dir):
    return tables.shuffled(tables.texts(spark, sf_dir).select("doc_id"), "doc_id", SEED)


# -- text and tokens --------------------------------------------------------------------


@query(S.with_(S.TEXTS) + f"SELECT doc_id, {S.clean('text')} AS text_clean FROM p")
def clean_text(spark, sf_dir):
    return tables.texts(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text_clean"))


@query(S.with_(S.TOKENS) + "SELECT doc_id, len(tk) AS n_tokens FROM t")
def token_counts(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.size("tk").alias("n_tokens"))


@query(S.with_(S.TOKENS) + f"SELECT doc_id, len(tk[1:{CMAX}]) AS n_tokens, {S.joined(f'tk[1:{CMAX}]')} AS kept FROM t")
def truncate_tokens(spark, sf_dir):
    kept = A.head(F.col("tk"), CMAX)
    return _tokens(spark, sf_dir).select("doc_id", F.size(kept).alias("n_tokens"), joined(kept).alias("kept"))


# -- chunks and placeholders ------------------------------------------------------------


@query(S.with_(S.TOKENS, S.chunks(0)) + f"SELECT doc_id, chunk_no, len(chunk) AS n_tokens, len(chunk) // {RATE} + 1 AS n_mem, {S.joined('chunk')} AS chunk FROM c")
def chunk_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", F.size("chunk").alias("n_tokens"), A.n_mem(F.size("chunk"), RATE).alias("n_mem"), joined("chunk").alias("chunk"))


@query(S.with_(S.TOKENS, S.chunks(OVERLAP)) + f"SELECT doc_id, chunk_no, len(chunk) AS n_tokens, {S.joined('chunk')} AS chunk FROM c")
def chunk_overlap(spark, sf_dir):
    return _chunks(spark, sf_dir, OVERLAP).select("doc_id", "chunk_no", F.size("chunk").alias("n_tokens"), joined("chunk").alias("chunk"))


@query(S.with_(S.TOKENS, S.chunks(0)) + "SELECT doc_id, chunk_no, len(chunk) AS n_tokens FROM c WHERE chunk_no < 3")
def cap_chunks(spark, sf_dir):
    chunks = F.slice(A.fixed_chunks(F.col("tk"), CMAX), 1, 3)
    return _tokens(spark, sf_dir).select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.size("chunk").alias("n_tokens"))


@query(S.recursive(S.TOKENS, S.tail("t", "len(tk)")) + "SELECT doc_id, k - 1 AS chunk_no, pos AS st, size AS len FROM r WHERE k > 0")
def chunk_random_tail(spark, sf_dir):
    spans = A.random_tail_spans(F.col("doc_id"), F.size("tk"), CMAX, PRE.min_ratio, SEED)
    return _tokens(spark, sf_dir).select("doc_id", F.posexplode(spans).alias("chunk_no", "s")).select("doc_id", "chunk_no", "s.st", "s.len")


@query(S.recursive(S.TOKENS, S.RANDOM_K) + "SELECT doc_id, i - 1 AS part_no, size AS n_tokens FROM rk WHERE i > 0")
def chunk_random_k(spark, sf_dir):
    """Exactly one part more than needed for each text's tokens."""
    n = F.size("tk")
    k = F.when(n > 1, F.ceil(n / CMAX).cast("int") + 1).otherwise(n)
    sizes = A.random_k_sizes(F.col("doc_id"), n, k, CMAX, SEED)
    return _tokens(spark, sf_dir).where("size(tk) > 0").select("doc_id", F.posexplode(sizes).alias("part_no", "n_tokens"))


@query(S.with_(S.TOKENS, S.chunks(0)) + f"SELECT doc_id, chunk_no, len(chunk) // {RATE} + 1 AS n_mem FROM c")
def mem_counts(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", A.n_mem(F.size("chunk"), RATE).alias("n_mem"))


@query(S.with_(S.TOKENS, S.chunks(0)) + f"SELECT doc_id, chunk_no, {S.joined(S.with_mem('chunk'))} AS ids FROM c")
def append_mem(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", joined(A.with_mem(F.col("chunk"), RATE, SP)).alias("ids"))


@query(S.with_(S.TOKENS, S.chunks(0)) + f"SELECT t.doc_id, CAST(coalesce(sum(len(chunk) // {RATE} + 1), 0) AS BIGINT) AS n_mem FROM t LEFT JOIN c ON t.doc_id = c.doc_id GROUP BY t.doc_id")
def mem_totals(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", A.total(A.chunk_mems(A.fixed_chunks(F.col("tk"), CMAX), RATE)).alias("n_mem"))


@query(S.with_(S.TOKENS, f"m AS (SELECT doc_id, {S.with_mem(f'tk[1:{CMAX}]')} AS ids FROM t)") + "SELECT doc_id, i - 1 AS pos FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM m) WHERE ids[i] = '<MEM>'")
def mem_positions(spark, sf_dir):
    ids = A.with_mem(A.head(F.col("tk"), CMAX), RATE, SP)
    return _tokens(spark, sf_dir).select("doc_id", F.explode(A.positions(ids, SP.mem)).alias("pos"))


@query(S.with_(S.TOKENS, S.chunks(0), S.BATCHES) + f"SELECT batch_id, c.doc_id, chunk_no, len(chunk) + len(chunk) // {RATE} + 1 AS n_ids FROM c JOIN b ON c.doc_id = b.doc_id")
def compressor_rows(spark, sf_dir):
    tk = _tokens(spark, sf_dir).select("doc_id", A.fixed_chunks(F.col("tk"), CMAX).alias("chunks"))
    rows = batching.compressor_rows(batching.assign(tk, "doc_id", BATCH), "doc_id", "chunks", RATE, ("batch_id",))
    return rows.select("batch_id", "doc_id", "chunk_no", (F.size("chunk") + F.col("n_mem")).alias("n_ids"))


@query(S.with_(S.TOKENS, S.BATCHES, f"m AS (SELECT t.doc_id, batch_id, {S.with_mem(f'tk[1:{CMAX}]')} AS ids FROM t JOIN b ON t.doc_id = b.doc_id)", S.padded("m")) + f"SELECT doc_id, batch_id, width, {S.joined('padded')} AS padded FROM w")
def compressor_preprocess(spark, sf_dir):
    ids = _tokens(spark, sf_dir).select("doc_id", A.with_mem(A.head(F.col("tk"), CMAX), RATE, SP).alias("ids"))
    return batching.padded(batching.assign(ids, "doc_id", BATCH), "ids", SP.pad).select("doc_id", "batch_id", "width", joined("padded").alias("padded"))


# -- pretraining ------------------------------------------------------------------------


@query(S.with_(S.TEXTS) + f"SELECT doc_id, CASE WHEN {S.u32('doc_id', 'task')} / 4294967296.0 < 0.5 THEN 'autoencode' ELSE 'continuation' END AS task FROM p")
def task_mix(spark, sf_dir):
    return tables.texts(spark, sf_dir).select("doc_id", F.when(pretraining.is_autoencode(PRE), "autoencode").otherwise("continuation").alias("task"))


@query(S.recursive(S.TOKENS, *S.AUTOENCODE) + f"SELECT doc_id, n_chunks, n_mem, {S.joined('decoder')} AS decoder FROM auto")
def autoencode(spark, sf_dir):
    rows = pretraining.rows(_tokens(spark, sf_dir), PRE, "autoencode")
    return rows.select("doc_id", F.size("chunks").alias("n_chunks"), "n_mem", joined("decoder").alias("decoder"))


@query(S.with_(S.TOKENS, *S.CONTINUATION) + f"SELECT doc_id, {S.joined('t1')} AS t1, {S.joined('t2')} AS t2, len(t3) AS n3 FROM parts")
def continuation_split(spark, sf_dir):
    return pretraining.continuation_parts(_tokens(spark, sf_dir), PRE).select("doc_id", joined("t1").alias("t1"), joined("t2").alias("t2"), F.size("t3").alias("n3"))


@query(S.with_(S.TOKENS, *S.CONTINUATION) + f"SELECT doc_id, n_mem, {S.joined('decoder')} AS decoder FROM cont")
def continuation(spark, sf_dir):
    return pretraining.rows(_tokens(spark, sf_dir), PRE, "continuation").select("doc_id", "n_mem", joined("decoder").alias("decoder"))


@query(S.recursive(S.TOKENS, *S.PRETRAIN) + f"SELECT doc_id, task, n_chunks, n_mem, len(decoder) AS n_decoder, {S.joined('decoder')} AS decoder, {S.joined(S.mask_special('decoder'))} AS labels FROM rows")
def pretrain_rows(spark, sf_dir):
    rows = pretraining.rows(_tokens(spark, sf_dir), PRE)
    return rows.select("doc_id", "task", F.size("chunks").alias("n_chunks"), "n_mem", F.size("decoder").alias("n_decoder"), joined("decoder").alias("decoder"), joined("labels").alias("labels"))


# -- batches, padding, labels -----------------------------------------------------------


@query(S.with_(S.TEXTS, S.BATCHES) + "SELECT doc_id, batch_id FROM b")
def batch_assign(spark, sf_dir):
    return batching.assign(tables.texts(spark, sf_dir).select("doc_id"), "doc_id", BATCH).select("doc_id", "batch_id")


_HEADS = (S.TOKENS, S.BATCHES, f"m AS (SELECT t.doc_id, batch_id, tk[1:{CMAX}] AS ids FROM t JOIN b ON t.doc_id = b.doc_id)", S.padded("m"))


def _heads(spark, sf_dir):
    ids = _tokens(spark, sf_dir).select("doc_id", A.head(F.col("tk"), CMAX).alias("ids"))
    return batching.padded(batching.assign(ids, "doc_id", BATCH), "ids", SP.pad)


@query(S.with_(*_HEADS) + f"SELECT doc_id, batch_id, width, {S.joined('padded')} AS padded FROM w")
def left_pad(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", "batch_id", "width", joined("padded").alias("padded"))


@query(S.with_(*_HEADS) + "SELECT doc_id, width, repeat('0', width - len(ids)) || repeat('1', len(ids)) AS mask FROM w")
def attention_mask(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", "width", F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"))


@query(S.recursive(S.TOKENS, *S.PRETRAIN, S.BATCHES, "m AS (SELECT rows.doc_id, batch_id, decoder AS ids FROM rows JOIN b ON rows.doc_id = b.doc_id)", S.padded("m")) + f"SELECT doc_id, batch_id, width, {S.joined('padded')} AS padded FROM w")
def decoder_inputs(spark, sf_dir):
    rows = pretraining.rows(_tokens(spark, sf_dir), PRE).select("doc_id", "decoder")
    return batching.padded(batching.assign(rows, "doc_id", BATCH), "decoder", SP.pad).select("doc_id", "batch_id", "width", joined("padded").alias("padded"))


@query(S.with_(S.TOKENS, *S.CONTINUATION) + f"SELECT doc_id, {S.joined(S.mask_special('decoder'))} AS labels FROM cont")
def mask_special(spark, sf_dir):
    return pretraining.rows(_tokens(spark, sf_dir), PRE, "continuation").select("doc_id", joined(A.mask_special(F.col("decoder"), SP)).alias("labels"))


@query(S.with_(S.TOKENS, *S.CONTINUATION) + f"SELECT doc_id, {S.joined(S.mask_before_mem('decoder'))} AS labels FROM cont")
def mask_before_mem(spark, sf_dir):
    return pretraining.rows(_tokens(spark, sf_dir), PRE, "continuation").select("doc_id", joined(A.mask_before_mem(F.col("decoder"), SP.mem)).alias("labels"))


@query(S.recursive(S.TOKENS, *S.PRETRAIN) + f"SELECT doc_id, {S.joined(S.mask_special(S.mask_before_mem('decoder')))} AS labels FROM rows")
def labels_pretrain(spark, sf_dir):
    """With the prefix mask in force; the labels as observed, without it, are those of ``pretrain_rows``."""
    return pretraining.rows(_tokens(spark, sf_dir), Pretraining(mask_prefix=True)).select("doc_id", joined("labels").alias("labels"))


@query(S.recursive(S.TOKENS, *S.PRETRAIN) + f"SELECT doc_id, {S.joined(S.unmask('decoder', S.mask_special('decoder')))} AS unmasked FROM rows")
def unmask_labels(spark, sf_dir):
    rows = pretraining.rows(_tokens(spark, sf_dir), PRE)
    return rows.select("doc_id", joined(A.unmask(F.col("decoder"), F.col("labels"), SP.pad)).alias("unmasked"))


@query(S.recursive(S.TOKENS, *S.PRETRAIN) + f"SELECT doc_id, {S.joined(S.decode(S.unmask(S.mask_special('decoder'), S.mask_special('decoder'))))} AS label_text FROM rows")
def decode_labels(spark, sf_dir):
    rows = pretraining.rows(_tokens(spark, sf_dir), PRE)
    return rows.select("doc_id", T.decode(A.unmask(F.col("labels"), F.col("labels"), SP.pad), SP).alias("label_text"))


# -- retrieval-augmented rows -----------------------------------------------------------


def _questions(spark, sf_dir):
    return tables.questions(spark, sf_dir)


@query(S.with_(S.QUESTIONS) + f"SELECT ex_id, k - 1 AS doc_no, docs[k] AS doc FROM (SELECT ex_id, docs, unnest(range(1, len(docs) + 1)) AS k FROM q) WHERE k <= {TOPK}")
def topk_docs(spark, sf_dir):
    return _questions(spark, sf_dir).select("ex_id", F.posexplode(F.slice("docs", 1, TOPK)).alias("doc_no", "doc"))


@query(S.with_(S.QUESTIONS) + f"SELECT ex_id, k - 1 AS doc_no, {S.clean(chr(39) + 'Query: ' + chr(39) + ' || query || chr(10) || ' + chr(39) + ' Document: ' + chr(39) + ' || docs[k]')} AS doc FROM (SELECT ex_id, query, docs, unnest(range(1, len(docs) + 1)) AS k FROM q) WHERE k <= {TOPK}")
def query_prefix(spark, sf_dir):
    docs = rag.kept_docs(Rag(query_dependent=True))
    return _questions(spark, sf_dir).select("ex_id", F.posexplode(docs).alias("doc_no", "doc"))


@query(S.with_(S.QUESTIONS, S.NMEMS) + "SELECT ex_id, array_to_string(list_transform(range(1, len(m) + 1), lambda k: 'Document ' || (k - 1) || ':' || repeat('<MEM>', m[k])), '') AS section FROM n")
def doc_section(spark, sf_dir):
    return rag.with_docs(_questions(spark, sf_dir), RAG).select("ex_id", T.doc_section(F.col("n_mems")).alias("section"))


@query(S.with_(S.QUESTIONS, S.NMEMS, S.PROMPTS) + "SELECT ex_id, usr AS prompt FROM pr")
def rag_prompt(spark, sf_dir):
    return _prompted(spark, sf_dir).select("ex_id", F.col("user").alias("prompt"))


def _prompted(spark, sf_dir):
    return rag.prompts(rag.with_docs(_questions(spark, sf_dir), RAG), RAG, T.spaced_section(F.col("n_mems")))


@query(S.with_(S.QUESTIONS, S.NMEMS, S.PROMPTS) + "SELECT ex_id, chat FROM pr")
def chat_render(spark, sf_dir):
    return _prompted(spark, sf_dir).select("ex_id", T.render_chat(F.col("system"), F.col("user"), F.col("answer")).alias("chat"))


@query(S.with_(S.QUESTIONS, S.NMEMS, S.PROMPTS) + f"SELECT ex_id, len({S.tok('opened')}) AS prefix FROM pr")
def prefix_length(spark, sf_dir):
    opened = T.render_chat(F.col("system"), F.col("user"), F.lit(""))
    return _prompted(spark, sf_dir).select("ex_id", F.size(T.space_tokens(opened)).alias("prefix"))


@query(S.with_(S.QUESTIONS, S.NMEMS, S.PROMPTS, S.RAG_ROWS) + f"SELECT ex_id, n_mem, prefix, len(decoder) AS n_decoder, {S.joined('decoder')} AS decoder, {S.joined('labels')} AS labels, len(list_filter(labels, lambda x: x <> '-100')) AS n_loss, n_mem - len(list_filter(decoder, lambda x: x = '<MEM>')) AS lost_mem FROM rr")
def rag_rows(spark, sf_dir):
    rows = rag.rows(_questions(spark, sf_dir), RAG)
    return rows.select("ex_id", "n_mem", "prefix", F.size("decoder").alias("n_decoder"), joined("decoder").alias("decoder"), joined("labels").alias("labels"), "n_loss", "lost_mem")


@query(S.with_(S.QUESTIONS, S.CHUNKED, S.PROMPTS, S.RAG_ROWS) + f"SELECT ex_id, n_chunks, n_mem, section, prefix, {S.joined('decoder')} AS decoder, {S.joined('labels')} AS labels FROM rr JOIN ch USING (ex_id)")
def rag_rows_chunked(spark, sf_dir):
    """Documents in up to three overlapping chunks each; one header covers all chunks of a document."""
    c = Rag(chunk_docs=True, chunk_overlap=OVERLAP, n_max_chunks=3)
    rows = rag.rows(_questions(spark, sf_dir), c)
    return rows.select("ex_id", F.size("chunks").alias("n_chunks"), "n_mem", T.doc_section(F.col("n_mems")).alias("section"), "prefix", joined("decoder").alias("decoder"), joined("labels").alias("labels"))


@query(S.with_(S.QUESTIONS, S.NMEMS, S.PROMPTS, S.RAG_ROWS) + f"SELECT ex_id, {S.joined(S.mask_prefix('decoder', 'prefix', 4))} AS labels FROM rr")
def mask_prefix(spark, sf_dir):
    rows = rag.rows(_questions(spark, sf_dir), RAG)
    return rows.select("ex_id", joined(A.mask_prefix(F.col("decoder"), F.col("prefix"), SP.pad, 4)).alias("labels"))


@query(S.with_(S.QUESTIONS, S.NMEMS, S.PROMPTS, S.RAG_ROWS) + f"SELECT ex_id, {S.joined('labels')} AS labels FROM rr")
def labels_rag(spark, sf_dir):
    return rag.rows(_questions(spark, sf_dir), RAG).select("ex_id", joined("labels").alias("labels"))


@query(S.with_(S.QUESTIONS, S.NMEMS, S.PROMPTS, S.RAG_ROWS) + "SELECT count(*) FILTER (WHERE n_mem <> len(list_filter(decoder, lambda x: x = '<MEM>'))) AS n_mismatch, count(*) AS n_records FROM rr")
def mem_consistency(spark, sf_dir):
    return registry.check(rag.rows(_questions(spark, sf_dir), RAG), "ex_id", RATE)


@query(S.with_(S.TOKENS, S.chunks(0)) + f"SELECT max(len(chunk) + len(chunk) // {RATE} + 1) AS widest, CAST({CMAX + CMAX // RATE + 2} AS BIGINT) AS bound, max(len(chunk) + len(chunk) // {RATE} + 1) <= {CMAX + CMAX // RATE + 2} AS fits FROM c")
def width_check(spark, sf_dir):
    tk = _tokens(spark, sf_dir).select("doc_id", A.fixed_chunks(F.col("tk"), CMAX).alias("chunks"))
    return batching.width_check(batching.compressor_rows(tk, "doc_id", "chunks", RATE), CMAX, RATE)


# -- trajectories -----------------------------------------------------------------------


def _trajectories(spark, sf_dir):
    return tables.trajectories(spark, sf_dir)


@query(S.with_(*S.STEPS) + "SELECT traj_id, step_no, n, flag, mems FROM st")
def traj_flags(spark, sf_dir):
    return trajectory.steps(_trajectories(spark, sf_dir), TRAJ).select("traj_id", "step_no", "n", "flag", "mems")


@query(S.with_(*S.STEPS, S.budget("st", "bu")) + "SELECT traj_id, step_no, CAST(before AS BIGINT) AS before, kept FROM bu")
def traj_budget(spark, sf_dir):
    return trajectory.budget(trajectory.steps(_trajectories(spark, sf_dir), TRAJ), TRAJ).select("traj_id", "step_no", "before", "kept")


@query(S.with_(*S.STEPS, S.budget("st", "bu")) + "SELECT traj_id, CAST(sum(CASE WHEN flag THEN n_chunks ELSE 0 END) AS BIGINT) AS n_chunks, CAST(sum(CASE WHEN flag THEN kept ELSE 0 END) AS BIGINT) AS n_mem, CAST(sum(kept + 1) AS BIGINT) AS n_decoder FROM bu GROUP BY traj_id")
def traj_compress(spark, sf_dir):
    """The first pass, before any step is forced."""
    kept = trajectory.budget(trajectory.steps(_trajectories(spark, sf_dir), TRAJ), TRAJ)
    on = lambda c: F.sum(F.when(F.col("flag"), F.col(c)).otherwise(0))
    return kept.groupBy("traj_id").agg(on("n_chunks").alias("n_chunks"), on("kept").alias("n_mem"), F.sum(F.col("kept") + 1).alias("n_decoder"))


@query(S.with_(*S.STEPS, *S.FORCED) + "SELECT traj_id, forced FROM fo GROUP BY ALL")
def traj_force_first(spark, sf_dir):
    return trajectory.forced(trajectory.steps(_trajectories(spark, sf_dir), TRAJ), TRAJ).select("traj_id", "forced").distinct()


@query(S.with_(*S.STEPS, *S.FORCED) + "SELECT traj_id, step_no, array_to_string(seq, ' ') AS seq FROM sq")
def traj_sequence(spark, sf_dir):
    kept = trajectory.budget(trajectory.forced(trajectory.steps(_trajectories(spark, sf_dir), TRAJ), TRAJ), TRAJ)
    return kept.select("traj_id", "step_no", joined(trajectory.sequence(F.col("flag"), F.col("tk"), F.col("kept"), TRAJ)).alias("seq"))


@query(S.with_(*S.STEPS, *S.FORCED, S.TRAJ_ROWS) + f"SELECT traj_id, n_steps, forced, n_chunks, n_mem, {S.joined('decoder')} AS decoder, {S.joined(S.mask_special('decoder'))} AS labels FROM tr WHERE n_chunks > 0")
def traj_rows(spark, sf_dir):
    rows = trajectory.rows(_trajectories(spark, sf_dir), TRAJ)
    return rows.select("traj_id", "n_steps", "forced", F.size("chunks").alias("n_chunks"), "n_mem", joined("decoder").alias("decoder"), joined("labels").alias("labels"))


@query(S.with_(*S.STEPS, *S.FORCED, S.TRAJ_ROWS) + "SELECT traj_id FROM tr WHERE n_chunks = 0")
def traj_rejects(spark, sf_dir):
    return trajectory.rejects(_trajectories(spark, sf_dir), TRAJ)


@query(S.with_(*S.STEPS, *S.FORCED, S.TRAJ_ROWS) + f"SELECT traj_id, {S.joined(S.mask_special('decoder'))} AS labels FROM tr WHERE n_chunks > 0")
def labels_traj(spark, sf_dir):
    return trajectory.rows(_trajectories(spark, sf_dir), TRAJ).select("traj_id", joined("labels").alias("labels"))


# -- vectors ----------------------------------------------------------------------------

HIDDEN, OUT, IN = 8, 4, 64


def weight(name: str, k: int) -> float:
    """A weight in [-0.5, 0.5) by rule; the SQL computes the same from the name and its number."""
    return int(hashlib.md5(f"{name}|{k}".encode()).hexdigest()[:8], 16) / 4294967296 - 0.5


def _hidden(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    token = F.when(F.col("vec_id") % 3 == 0, SP.mem).otherwise("x")
    return rows.select(F.floor(F.col("vec_id") / 8).alias("ex_id"), (F.col("vec_id") % 8).alias("pos"), token.alias("token"), F.col("embedding").alias("vec"))


def _connector(vec: Column) -> Column:
    w1 = [[weight("w1", h * IN + d) for d in range(IN)] for h in range(HIDDEN)]
    w2 = [[weight("w2", o * HIDDEN + h) for h in range(HIDDEN)] for o in range(OUT)]
    return vectors.connector(vec, w1, [0.1] * HIDDEN, w2, [0.2] * OUT)


@query(S.with_(S.HIDDEN) + "SELECT ex_id, mem_ordinal, pos, round(CAST(list_sum(vec) AS DOUBLE), 3) AS total FROM g")
def mem_gather(spark, sf_dir):
    rows = vectors.mem_gather(_hidden(spark, sf_dir), "ex_id", SP.mem)
    return rows.select("ex_id", "mem_ordinal", "pos", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query(S.with_(S.HIDDEN, S.CONNECTOR) + "SELECT ex_id, mem_ordinal, o, y FROM cn")
def connector_mlp(spark, sf_dir):
    rows = vectors.mem_gather(_hidden(spark, sf_dir), "ex_id", SP.mem)
    return rows.select("ex_id", "mem_ordinal", _connector(F.col("vec")).alias("v")).select("ex_id", "mem_ordinal", F.posexplode("v").alias("o", "y")).withColumn("y", F.round("y", 4))


@query(S.with_(S.HIDDEN) + "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at FROM embeddings WHERE embedding IS NOT NULL")
def argmax_tokens(spark, sf_dir):
    return tables.read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", vectors.argmax(F.col("embedding")).alias("at"))


@query(S.with_(S.PAIRS, S.VOCABULARY) + f"SELECT ex_id, h, count(*) AS n, count(rank) AS n_known, round(avg(rank), 6) AS mean FROM (SELECT ex_id, md5(prediction || reference) AS h, unnest({S.words('prediction')}) AS token FROM pa) LEFT JOIN v USING (token) GROUP BY ex_id, h")
def embed_lookup(spark, sf_dir):
    """Predictions' tokens joined with the list of frequent words as a vocabulary of one-dimensional vectors."""
    rows = tables.pairs(spark, sf_dir).select("ex_id", F.md5(F.concat("prediction", "reference")).alias("h"), F.explode(T.words(F.col("prediction"))).alias("token"))
    listed = tables.read(spark, sf_dir, "common_words").where("word is not null")
    vocabulary = listed.groupBy(F.lower("word").alias("token")).agg(F.array(F.min("rank_no").cast("double")).alias("vec"))
    at = F.col("vec")[0]
    return vectors.lookup(rows, vocabulary).groupBy("ex_id", "h").agg(F.count("*").alias("n"), F.count(at).alias("n_known"), F.round(F.avg(at), 6).alias("mean"))


@query(S.recursive(S.TOKENS, *S.PRETRAIN) + f"SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS mem_ordinal, round({S.u32('doc_id', 'vec', 'row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1')} / 4294967296.0, 6) AS v FROM (SELECT doc_id, i - 1 AS pos FROM (SELECT doc_id, decoder, unnest(range(1, len(decoder) + 1)) AS i FROM rows) WHERE decoder[i] = '<MEM>')")
def embed_scatter(spark, sf_dir):
    """Vectors of a record's chunks, in order, to the placeholders of its decoder sequence."""
    rows = pretraining.rows(_tokens(spark, sf_dir), PRE)
    vec = F.transform(F.sequence(F.lit(0), F.col("n_mem") - 1), lambda k: F.array(uniform(SEED, F.col("doc_id"), "vec", k)))
    rows = rows.where("n_mem > 0").select("doc_id", F.explode(vectors.scatter_in_row(F.col("decoder"), vec, SP.mem)).alias("m"))
    return rows.select("doc_id", "m.pos", "m.mem_ordinal", F.round(F.col("m.vec")[0], 6).alias("v"))


@query(S.with_(S.HIDDEN, S.CONNECTOR) + "SELECT ex_id, count(DISTINCT mem_ordinal) AS n_mem, CAST(sum(CAST(round(y * 10000) AS BIGINT)) AS BIGINT) AS total FROM cn GROUP BY ex_id")
def compress(spark, sf_dir):
    """Hidden states to compressed vectors of a record: gathered at placeholders, sent through the connector; their sum in ten thousandths."""
    rows = encoder.connected(_hidden(spark, sf_dir), "ex_id", _connector, SP.mem)
    rows = rows.withColumn("total", F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, y: a + F.round(F.round(y, 4) * 10000).cast("bigint")))
    return rows.groupBy("ex_id").agg(F.count("*").alias("n_mem"), F.sum("total").alias("total"))


# -- metrics ----------------------------------------------------------------------------



def _pairs(spark, sf_dir):
    return tables.pairs(spark, sf_dir)


@query(S.with_(S.PAIRS) + f"SELECT ex_id, {S.normalize('prediction')} AS prediction, {S.normalize('reference')} AS reference FROM pa")
def normalize_text(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ex_id", T.normalize(F.col("prediction")).alias("prediction"), T.normalize(F.col("reference")).alias("reference"))


@query(S.with_(S.PAIRS) + f"SELECT ex_id, len({S.words('prediction')}) AS n_pred, len({S.words('reference')}) AS n_ref FROM pa")
def metric_tokens(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ex_id", F.size(T.words(F.col("prediction"))).alias("n_pred"), F.size(T.words(F.col("reference"))).alias("n_ref"))


@query(S.with_(S.PAIRS) + f"SELECT ex_id, CAST({S.normalize('prediction')} = {S.normalize('reference')} AS DOUBLE) AS em FROM pa")
def exact_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ex_id", metrics.exact(F.col("prediction"), F.col("reference")).alias("em"))


@query(S.with_(S.PAIRS) + f"SELECT round(avg(CAST({S.normalize('prediction')} = {S.normalize('reference')} AS DOUBLE)), 6) AS em FROM pa")
def exact_match_score(spark, sf_dir):
    return exact_match(spark, sf_dir).agg(F.round(F.avg("em"), 6).alias("em"))


@query(S.with_(S.PAIRS) + f"SELECT ex_id, CAST(contains({S.normalize('prediction')}, {S.normalize('reference')}) AS DOUBLE) AS m FROM pa")
def match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ex_id", metrics.contained(F.col("prediction"), F.col("reference")).alias("m"))


@query(S.with_(S.PAIRS) + f"SELECT round(avg(CAST(contains({S.normalize('prediction')}, {S.normalize('reference')}) AS DOUBLE)), 6) AS m FROM pa")
def match_score(spark, sf_dir):
    return match(spark, sf_dir).agg(F.round(F.avg("m"), 6).alias("m"))


@query(S.with_(S.QUESTIONS) + f"SELECT ex_id, token, count(*) AS n FROM (SELECT ex_id, unnest({S.words('query')}) AS token FROM q) GROUP BY ex_id, token")
def token_multiset(spark, sf_dir):
    return metrics.token_counts(_questions(spark, sf_dir), "ex_id", "query")


def _f1(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("pair", F.struct("ex_id", F.md5(F.concat("prediction", F.lit("|"), "reference")).alias("h")))
    return metrics.f1_pairs(pairs, "pair").select("pair.ex_id", "pair.h", "overlap", "n_pred", "n_ref", "f1", "precision", "recall")


@query(S.with_(S.PAIRS, *S.F1) + "SELECT ex_id, h, overlap, n_pred, n_ref FROM f1")
def f1_overlap(spark, sf_dir):
    return _f1(spark, sf_dir).select("ex_id", "h", "overlap", "n_pred", "n_ref")


@query(S.with_(S.PAIRS, *S.F1) + f"SELECT ex_id, h, {S.F1_SCORES} FROM f1")
def f1_single(spark, sf_dir):
    return _f1(spark, sf_dir).select("ex_id", "h", *(F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")))


@query(S.F1_MULTI)
def f1_multiref(spark, sf_dir):
    """Each label against the record's passages as references."""
    rows = _questions(spark, sf_dir).where("label is not null").select("ex_id", "label", "docs")
    out = metrics.f1_multi(rows, "ex_id", "label", "docs")
    return out.select("ex_id", *(F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")))


@query(S.with_(S.PAIRS) + f"SELECT ex_id, {S.rouge('prediction', 'reference', 1)} AS rouge_1 FROM pa")
def rouge1(spark, sf_dir):
    return metrics.with_rouge_n(metrics.with_words(_pairs(spark, sf_dir)), 1).select("ex_id", F.round("rouge_1", 6).alias("rouge_1"))


@query(S.with_(S.PAIRS) + f"SELECT ex_id, {S.rouge('prediction', 'reference', 2)} AS rouge_2 FROM pa")
def rouge2(spark, sf_dir):
    return metrics.with_rouge_n(metrics.with_words(_pairs(spark, sf_dir)), 2).select("ex_id", F.round("rouge_2", 6).alias("rouge_2"))


@query(S.with_(S.PAIRS, S.SCORES) + "SELECT ex_id, rouge_l FROM sc")
def rougeL(spark, sf_dir):  # noqa: N802
    return metrics.with_words(_pairs(spark, sf_dir)).select("ex_id", F.round(metrics.rouge_l("p_words", "r_words"), 6).alias("rouge_l"))


@query(S.with_(S.PAIRS, S.SCORES) + f"SELECT {S.MEANS[0]} FROM sc")
def rouge_scores(spark, sf_dir):
    return metrics.hard_metrics(_pairs(spark, sf_dir)).select(*(F.round(c, 4).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l")))


@query(S.with_(S.PAIRS, S.SCORES) + f"SELECT {S.MEANS[0]}, {S.MEANS[1]} FROM sc")
def hard_metrics(spark, sf_dir):
    return _means(metrics.hard_metrics(_pairs(spark, sf_dir)))


def _means(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) for c in metrics.MEANS))


@query(S.with_(S.QUESTIONS, S.MATCHED, S.SCORES) + f"SELECT {S.MEANS[0]}, {S.MEANS[1]} FROM sc")
def eval_metrics(spark, sf_dir):
    """Predictions against the labels of the retrieval records, from two tables that meet by key."""
    return _means(metrics.hard_metrics(metrics.matched(_predictions(spark, sf_dir), _labels(spark, sf_dir), "ex_id")))


def _predictions(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ex_id", T.clean_text(F.col("prediction")).alias("prediction"))


def _labels(spark, sf_dir):
    return _questions(spark, sf_dir).where("label is not null").select("ex_id", T.clean_text(F.col("label")).alias("reference"))


@query(S.with_(S.QUESTIONS, S.PAIRS) + "SELECT 'prediction' AS side, count(*) AS n FROM pa WHERE ex_id NOT IN (SELECT ex_id FROM q WHERE label IS NOT NULL) UNION ALL SELECT 'reference', count(*) FROM q WHERE label IS NOT NULL AND ex_id NOT IN (SELECT ex_id FROM pa)")
def unmatched_pairs(spark, sf_dir):
    """Predictions without a labelled record, and labelled records without a prediction."""
    return metrics.unmatched(_predictions(spark, sf_dir), _labels(spark, sf_dir), "ex_id")


# -- looking at rows, streams -----------------------------------------------------------


@query(S.recursive(S.TOKENS, *S.PRETRAIN) + f"SELECT doc_id, task, {S.joined(S.decode('decoder'))} AS decoder_text, {S.joined(S.decode(S.counted(S.mask_special('decoder'))))} AS label_text, repeat('1', len(decoder)) AS mask, array_to_string(list_transform({S.mask_special('decoder')}, lambda y: CASE WHEN y = '-100' THEN '0' ELSE '1' END), '') AS loss FROM rows ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 2")
def preview_rows(spark, sf_dir):
    return preview(pretraining.rows(_tokens(spark, sf_dir), PRE), "doc_id", 2, keep=("task",))


@query(S.with_(S.PAIRS) + "SELECT ex_id, reference, prediction FROM pa ORDER BY md5(CAST(ex_id AS VARCHAR)), ex_id, prediction, reference LIMIT 1")
def preview_prediction(spark, sf_dir):
    """A label beside its prediction."""
    return preview_pairs(_pairs(spark, sf_dir), "ex_id", 1)


@query(S.with_(S.TOKENS, S.chunks(0)) + f"SELECT t.doc_id, len(tk) AS n_tokens, count(chunk) AS n_chunks, CAST(coalesce(sum(len(chunk) // {RATE} + 1), 0) AS BIGINT) AS n_mem FROM t LEFT JOIN c ON t.doc_id = c.doc_id GROUP BY t.doc_id, len(tk)")
def row_stage(spark, sf_dir):
    """The row-wise stage that also runs on streams, over the whole table."""
    return streams.chunk_counts(tables.first_deliveries(tables.read(spark, sf_dir, "pretrain_in"), "doc_id"), CMAX, RATE).drop("loaded_at")


@query("SELECT strftime(loaded_at, '%Y-%m-%d') AS day, count(*) AS records, CAST(sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(replace(replace(text, '<RET>', '< RET >'), '<MEM>', '< MEM >'), ' ')) END) AS BIGINT) AS tokens FROM (SELECT doc_id, any_value(text) AS text, min(loaded_at) AS loaded_at FROM pretrain_in WHERE text IS NOT NULL GROUP BY doc_id) GROUP BY 1")
def window_totals(spark, sf_dir):
    """Daily totals by load time, as the streaming windows give them; a record counts on the day of its first delivery."""
    rows = tables.first_deliveries(tables.read(spark, sf_dir, "pretrain_in"), "doc_id")
    totals = streams.windows(streams.chunk_counts(rows, CMAX, RATE))
    return totals.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "records", "tokens")
