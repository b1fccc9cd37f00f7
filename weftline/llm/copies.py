"""Problem 1: passages that differ in formatting only, each once with its copies.

Method: every field of a passage (its name and value, letters and digits only) is
hashed to 128 bits; the hashes are added up modulo 2^64 in both halves, so that
the order of fields does not matter but their number does. Passages that are not
made of fields hash their letters and digits. Rows are grouped by fingerprint, and
members are held against the first passage of their group by counting fields,
without sorting them.

A passage of fields and one that has the same letters in the same order (its
separators lost, say) are copies as well; a class of equal letters takes the
field fingerprint of any of its members.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, fold, read, sorted_out

_BRACES = re.compile(r"\s*\{(.*)\}\s*", re.S)
_QUOTED = re.compile(r"""\s*["'“]([^"”]*)["'”]\s*[:=]\s*(?:["“]((?:[^"\\]|\\.)*)["”]|(\[[^\]]*\]|[^",{}]*))\s*(?:,|;|$)""", re.S)
_NOT_ALNUM = re.compile(r"[\W_]+")
#: A class of equal letters with at least this share of all passages is joined by broadcast: 1 / HEAVY classes at most.
HEAVY = 1e-3


def letters(text: str) -> str:
    return _NOT_ALNUM.sub("", fold(text))


def fields(text: str) -> list[tuple[str, str]] | None:
    """The normalized (name, value) pairs of a passage that consists only of fields, else None.

    Fewer than two fields need no order and count as plain text; a blank value is a
    value; names may have any length.
    """
    found = []
    inner = _BRACES.fullmatch(text)
    if inner and '"' in inner[1]:
        at, body = 0, inner[1].rstrip()
        while at < len(body):
            m = _QUOTED.match(body, at)
            if not m or m.end() == at:
                return None
            found.append((letters(m[1]), letters(m[2] if m[2] is not None else m[3] or "")))
            at = m.end()
    else:
        for part in re.split(r"[\n\r;|\x0b\x0c\x85  ]", inner[1] if inner else text):
            if not any(map(str.isalnum, part)):
                continue
            cuts = [k for k in (part.find(":"), part.find("=")) if k >= 0]
            if not cuts:
                return None
            k = min(cuts)
            name = letters(part[:k])
            if not name:
                return None
            found.append((name, letters(part[k + 1 :])))
    return found if len(found) > 1 and all(n for n, _ in found) else None


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str) -> tuple[int, int, int | None, int | None]:
    """Two halves of the hash of the letters, two of the fields' multiset (or None)."""
    a = xxhash.xxh3_128_intdigest(letters(text))
    pairs = fields(text) if ":" in text or "=" in text else None
    if pairs is None:
        return _signed(a >> 64), _signed(a), None, None
    high = low = 0
    for name, value in pairs:
        h = xxhash.xxh3_128_intdigest(f"{name}\x1f{value}")
        high, low = high + (h >> 64), low + (h & ((1 << 64) - 1))
    return _signed(a >> 64), _signed(a), _signed(high), _signed(low)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    for b in batches:
        rows = []
        for ex, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for pos, text in enumerate(docs or ()):
                if text and any(map(str.isalnum, text)):
                    rows.append((ex, pos, *fingerprint(text)))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["ex_id", "pos", "a1", "a2", "f1", "f2"])


def groups(df: DataFrame, ex_id: str, docs: str) -> tuple[DataFrame, DataFrame]:
    """(marks, classes): every passage's place and hashes; every class of equal letters with its group's first passage and size."""
    marks = df.select(F.col(ex_id).cast("bigint").alias("e"), F.col(docs).cast("array<string>").alias("d")).where("e is not null").mapInArrow(_fingerprints, "ex_id bigint, pos int, a1 bigint, a2 bigint, f1 bigint, f2 bigint")
    marks = cut_lineage(marks.dropDuplicates(["ex_id", "pos"]))  # 40 bytes a passage, read three times
    classes = marks.groupBy("a1", "a2").agg(F.min(F.struct("ex_id", "pos")).alias("at"), F.count("*").alias("n"), F.min(F.when(F.col("f1").isNotNull(), F.struct("f1", "f2"))).alias("f"))
    plain = F.struct(F.lit(0).alias("k"), F.col("a1").alias("x"), F.col("a2").alias("y"))
    by_field = F.struct(F.lit(1).alias("k"), F.col("f.f1").alias("x"), F.col("f.f2").alias("y"))
    classes = classes.select("a1", "a2", "at", "n", F.when(F.col("f").isNull(), plain).otherwise(by_field).alias("key"))
    firsts = classes.groupBy("key").agg(F.min("at").alias("first"), F.sum("n").alias("copies"))
    return marks, cut_lineage(classes.join(firsts, "key").select("a1", "a2", "n", "first", "copies"))


def same_passages(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two passages have the same letters in order or the same fields, counted and not sorted."""

    def same(x: str, y: str) -> bool:
        if letters(x) == letters(y):
            return True
        p, q = fields(x), fields(y)
        if p is not None and q is not None:
            return Counter(p) == Counter(q)
        return Counter(letters(x)) == Counter(letters(y))  # linked through a third passage

    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype=bool)


#: Members of a group that one task holds against the group's first passage.
MEMBERS_A_TASK = 20_000


def members(df: DataFrame, ex_id: str, docs: str, marks: DataFrame, classes: DataFrame) -> DataFrame:
    """(first, ex_id, pos, copies, same) of every passage but the first of its group; ``same`` where its fields equal the first's.

    Hot classes are joined by broadcast and never shuffled by their hash; the first
    passage is repeated once for each ``MEMBERS_A_TASK`` members, which are spread over
    these. Of the passages only those that may be repeated travel.
    """
    several = classes.where("copies > 1").select("a1", "a2", "n", "first", "copies")
    least = HEAVY * marks.count()
    heavy, light = F.broadcast(several.where(F.col("n") >= least).drop("n")), several.where(F.col("n") < least).drop("n")
    places = marks.select("ex_id", "pos", "a1", "a2")
    many = places.join(heavy, ["a1", "a2"]).unionByName(places.join(heavy, ["a1", "a2"], "left_anti").join(light, ["a1", "a2"]))
    many = cut_lineage(many.select("ex_id", "pos", "first", "copies"))
    passages = df.select(F.col(ex_id).cast("bigint").alias("ex_id"), F.posexplode(F.col(docs).cast("array<string>")).alias("pos", "passage"))
    found = sorted_out(passages, many, "ex_id", "pos").join(many, ["ex_id", "pos"]).withColumn("parts", F.ceil(F.col("copies") / MEMBERS_A_TASK).cast("int"))
    is_first = (F.col("first.ex_id") == F.col("ex_id")) & (F.col("first.pos") == F.col("pos"))
    heads = found.where(is_first).dropDuplicates(["ex_id", "pos"]).select("first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("passage").alias("head"))
    others = found.where(~is_first).withColumn("part", F.pmod(F.xxhash64("ex_id", "pos"), F.col("parts")).cast("int"))
    held = others.join(heads, ["first", "part"]).select("first", "ex_id", "pos", "copies", F.pandas_udf(same_passages, "boolean")("passage", "head").alias("same"))
    return held.dropDuplicates(["ex_id", "pos"])


def copies(df: DataFrame, ex_id: str, docs: str) -> DataFrame:
    """(first_ex_id, first_doc_pos, ex_id, doc_pos, copies) of every passage but the first of its group.

    Null, empty and blank passages and null arrays give none; a record delivered
    twice counts once; ties go to the smaller (ex_id, doc_pos). A group may hold
    any share of the rows: it is counted before the shuffle and its members are spread.
    """
    held = members(df, ex_id, docs, *groups(df, ex_id, docs)).where("same")
    return held.select(F.col("first.ex_id").alias("first_ex_id"), F.col("first.pos").alias("first_doc_pos"), "ex_id", F.col("pos").alias("doc_pos"), "copies")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(read(spark, sf_dir, "rag_in"), "ex_id", "docs").drop("copies")


def distinct_passages(df: DataFrame, ex_id: str, docs: str) -> DataFrame:
    """(ex_id, doc_pos, copies): every distinct passage once, at its first place; a member whose fields differ stands for itself."""
    marks, classes = groups(df, ex_id, docs)
    held = members(df, ex_id, docs, marks, classes)
    one = F.lit(1).cast("bigint")
    firsts = classes.select("first", one.alias("copies")).distinct()
    counted = held.where("same").groupBy("first").agg(F.count("*").alias("copies"))
    own = held.where("not same").select(F.struct("ex_id", "pos").alias("first"), one.alias("copies"))
    rows = firsts.unionByName(counted).unionByName(own).groupBy("first").agg(F.sum("copies").alias("copies"))
    return rows.select(F.col("first.ex_id").alias("ex_id"), F.col("first.pos").alias("doc_pos"), "copies")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_passages(read(spark, sf_dir, "rag_in"), "ex_id", "docs")
