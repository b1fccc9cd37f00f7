"""Token arrays: chunks, placeholders, masks. All are expressions; no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Specials
from .rng import randint

NO_TOKENS, NO_CHUNKS = "array<string>", "array<array<string>>"
IGNORED = "-100"


def empty(kind: str = NO_TOKENS) -> Column:
    return F.array().cast(kind)


def head(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def fixed_chunks(tokens: Column, length: int, overlap: int = 0) -> Column:
    """Chunks of ``length`` tokens that start every ``length - overlap``; none for no tokens."""
    if not 0 <= overlap < length:
        raise ValueError("overlap must be smaller than the chunk length")
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(length - overlap))
    return F.when(F.size(tokens) == 0, empty(NO_CHUNKS)).otherwise(F.transform(starts, lambda at: F.slice(tokens, at + 1, length)))


def random_tail_spans(key: Column, n: Column, longest: int, min_ratio: float, seed: int) -> Column:
    """(st, len) of random chunks of at most ``longest`` tokens whose last is not tiny.

    A fold over at most ceil(n / least) + 1 steps: what is left is taken whole if it
    fits; a rest that would be too short shortens this chunk; else a length is drawn.
    """
    if not 0 < min_ratio <= 1:
        raise ValueError("min_ratio must lie in (0, 1]")
    least = max(1, int(longest * min_ratio))

    def step(state: Column, k: Column) -> Column:
        rest = n - state["pos"]
        over = rest - longest
        drawn = randint(seed, key, least, longest, "tail", k).cast("int")
        size = F.when(rest <= longest, rest).when((over > 0) & (over < least), longest - (least - over)).otherwise(drawn).cast("int")
        more = F.struct((state["pos"] + size).alias("pos"), F.concat(state["spans"], F.array(F.struct(state["pos"].alias("st"), size.alias("len")))).alias("spans"))
        return F.when(rest <= 0, state).otherwise(more)

    steps = F.sequence(F.lit(1), F.ceil(n / least).cast("int") + 1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<st:int,len:int>>").alias("spans"))
    return F.aggregate(steps, start, step, lambda s: s["spans"])


def spans_to_chunks(tokens: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.slice(tokens, s["st"] + 1, s["len"]))


def random_k_sizes(key: Column, n: Column, k: Column, longest: int, seed: int) -> Column:
    """Sizes of exactly ``k`` parts of 1 to ``longest`` units that make up ``n``; null where there is no such split.

    One draw for each part, between what the parts behind it need and what they can hold.
    """

    def step(s: Column, i: Column) -> Column:
        behind = k - i
        low = F.greatest(F.lit(1), s["rest"] - behind * longest)
        high = F.least(F.lit(longest), s["rest"] - behind)
        size = randint(seed, key, low, high, "parts", i).cast("int")
        return F.struct((s["rest"] - size).alias("rest"), F.concat(s["sizes"], F.array(size)).alias("sizes"))

    start = F.struct(n.cast("int").alias("rest"), F.array().cast("array<int>").alias("sizes"))
    sizes = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step, lambda s: s["sizes"])
    return F.when((k >= 1) & (n >= k) & (n <= k * longest), sizes)


def n_mem(length: Column, rate: int) -> Column:
    """Placeholders of a chunk: at least one, and one more at exact multiples."""
    return (F.floor(length / rate) + 1).cast("int")


def with_mem(chunk: Column, rate: int, specials: Specials) -> Column:
    out = F.concat(chunk, F.array_repeat(F.lit(specials.mem), n_mem(F.size(chunk), rate)))
    return F.concat(out, F.array(F.lit(specials.retrieval))) if specials.retrieval else out


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def chunk_mems(chunks: Column, rate: int) -> Column:
    return F.transform(chunks, lambda c: n_mem(F.size(c), rate))


def positions(tokens: Column, token: str) -> Column:
    """Positions, from 0, that hold a token."""
    return F.filter(F.transform(tokens, lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())


def left_pad(tokens: Column, width: Column, pad: str) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), (width - F.size(tokens)).cast("int")), tokens)


def attention_mask(length: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), (width - length).cast("int")), F.array_repeat(F.lit(1), length.cast("int")))


def mask_special(labels: Column, specials: Specials) -> Column:
    return F.transform(labels, lambda x: F.when(x.isin(specials.unscored), F.lit(IGNORED)).otherwise(x))


def mask_before_mem(labels: Column, mem: str) -> Column:
    """Everything up to the last placeholder is ignored; a row without one stays."""
    last = F.coalesce(F.array_max(positions(labels, mem)), F.lit(-1))
    return F.transform(labels, lambda x, i: F.when(i <= last, F.lit(IGNORED)).otherwise(x))


def mask_prefix(labels: Column, prefix: Column, pad: str, margin: int) -> Column:
    """Everything before (pads - margin + prefix) is ignored; pads are counted by value."""
    first = F.size(F.filter(labels, lambda x: x == pad)) - margin + prefix
    return F.transform(labels, lambda x, i: F.when(i < first, F.lit(IGNORED)).otherwise(x))


def unmask(values: Column, labels: Column, pad: str) -> Column:
    """``values`` with the pad token where the label is ignored."""
    return F.zip_with(values, labels, lambda v, y: F.when(y == IGNORED, F.lit(pad)).otherwise(v))
