"""Agent trajectories: some steps compressed, all within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Trajectory
from ..functions import arrays as A
from ..functions.rng import uniform
from ..functions.text import Tokenizer, clean_text, space_tokens


def steps(trajectories: DataFrame, c: Trajectory, tokenize: Tokenizer = space_tokens) -> DataFrame:
    """(traj_id, step_no, tk, n, flag, n_chunks, mems): one row a step; ``flag`` is the draw to compress."""
    rows = trajectories.select("traj_id", F.posexplode("steps").alias("step_no", "step"))
    rows = rows.withColumn("tk", tokenize(clean_text(F.col("step"))))
    n, cmax, rate = F.size("tk"), c.lengths.compressor_max, c.lengths.rate
    rest = n % cmax
    mems = F.floor(n / cmax).cast("int") * (cmax // rate + 1) + F.when(rest > 0, A.n_mem(rest, rate)).otherwise(0)
    flag = uniform(c.lengths.seed, F.col("traj_id"), "step", F.col("step_no")) < c.p_compress
    return rows.select("traj_id", "step_no", "tk", n.alias("n"), flag.alias("flag"), F.ceil(n / cmax).cast("int").alias("n_chunks"), mems.alias("mems"))


def budget(rows: DataFrame, c: Trajectory) -> DataFrame:
    """Steps up to the budget with ``kept``, the tokens or placeholders that each adds after its line return.

    A step is kept while the length before it is at most the budget. A clear step that
    overflows gives the room left; at an exactly full budget that room is -1, which
    keeps all but its last token unless ``strict_budget`` is set.
    """
    dmax = c.lengths.decoder_max
    adds = F.when(F.col("flag"), F.col("mems")).otherwise(F.col("n"))
    before = F.coalesce(F.sum(adds + 1).over(Window.partitionBy("traj_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") <= dmax)
    room = F.lit(dmax) - F.col("before") - 1
    short = F.lit(0) if c.strict_budget else F.greatest(F.col("n") - 1, F.lit(0))
    clear = F.when(F.col("n") <= room, F.col("n")).when(room >= 0, room).otherwise(short)
    return rows.withColumn("kept", F.when(F.col("flag"), F.col("mems")).otherwise(clear).cast("int"))


def forced(rows: DataFrame, c: Trajectory) -> DataFrame:
    """The steps again, the first one flagged in trajectories whose budget holds no compressed chunk; ``forced`` marks them."""
    made = budget(rows, c).groupBy("traj_id").agg(F.sum(F.when(F.col("flag"), F.col("n_chunks")).otherwise(0)).alias("made"))
    rows = rows.join(made, "traj_id")
    change = (F.col("made") == 0) & (F.col("step_no") == 0)
    return rows.withColumn("forced", F.col("made") == 0).withColumn("flag", F.col("flag") | change).drop("made")


def rows(trajectories: DataFrame, c: Trajectory, tokenize: Tokenizer = space_tokens) -> DataFrame:
    """(traj_id, n_steps, forced, chunks, n_mem, decoder, labels); trajectories without any chunk are left to :func:`rejects`."""
    out = _assembled(trajectories, c, tokenize).where("size(chunks) > 0")
    return out.withColumn("labels", A.mask_special(F.col("decoder"), c.specials))


def rejects(trajectories: DataFrame, c: Trajectory, tokenize: Tokenizer = space_tokens) -> DataFrame:
    """(traj_id) of trajectories in which even the forced first step is empty."""
    return _assembled(trajectories, c, tokenize).where("size(chunks) = 0").select("traj_id")


def sequence(flag: Column, tk: Column, kept: Column, c: Trajectory) -> Column:
    """What one step adds to the decoder: a line return, then placeholders or tokens."""
    return F.concat(F.array(F.lit(c.specials.newline)), F.when(flag, F.array_repeat(F.lit(c.specials.mem), kept)).otherwise(F.slice(tk, 1, kept)))


def _assembled(trajectories: DataFrame, c: Trajectory, tokenize: Tokenizer) -> DataFrame:
    kept = budget(forced(steps(trajectories, c, tokenize), c), c)
    parts = kept.select("traj_id", "forced", F.struct("step_no", sequence(F.col("flag"), F.col("tk"), F.col("kept"), c).alias("seq"), F.when(F.col("flag"), A.fixed_chunks(F.col("tk"), c.lengths.compressor_max)).otherwise(A.empty(A.NO_CHUNKS)).alias("chunks"), F.when(F.col("flag"), F.col("kept")).otherwise(0).alias("mems")).alias("s"))
    whole = parts.groupBy("traj_id").agg(F.max("forced").alias("forced"), F.array_sort(F.collect_list("s")).alias("s"))  # the steps of one input row
    return whole.select("traj_id", F.size("s").alias("n_steps"), "forced", F.flatten("s.chunks").alias("chunks"), A.total(F.col("s.mems")).alias("n_mem"), F.flatten("s.seq").alias("decoder"))
