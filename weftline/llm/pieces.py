"""Problem 5: oversized items cut at natural boundaries.

Method: dynamic programming over boundary positions. A piece that ends at e is
followed by one that starts at most ``overlap`` characters before e, at a word's
start where there is one; both bounds together give the candidates that can
follow each other. The sum of cut penalties and of squared deviations from an
even size is minimal over all admissible sequences of the candidates: paragraph,
line and sentence ends; the word ends of each stretch between two of these that no
piece can span; and every position of each run without white space that no piece can
span. (A word end costs more than any imbalance, a position inside a word more than
any word ends, so that opening them where they are needed only loses no better cut.)
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import first_deliveries
from .common import read

LIMIT, OVERLAP = 1200, 100
KINDS = ("paragraph", "line", "sentence", "word", "character")
PENALTY = {"paragraph": 0.0, "line": 0.2, "sentence": 0.4, "word": 1e3, "character": 1e6}
_STRONG = re.compile(r"(?P<p>\s*\n\s*\n\s*)|(?P<l>[^\S\n]*\n\s*)|[.!?…]+[\"'”’»)\]]*(?P<s>\s+)|[。！？]+[”’」』）]*(?P<c>\s*)")
_SPACE = re.compile(r"\s+")
_START = re.compile(r"\s\S")


def _safe(text: str, at: int) -> int:
    """A position at or before ``at`` that parts no character from its combining marks."""
    while 0 < at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def _boundaries(text: str) -> dict[int, str]:
    found = {}
    for m in _STRONG.finditer(text):
        kind = "paragraph" if m.lastgroup == "p" else "line" if m.lastgroup == "l" else "paragraph" if "\n\n" in m.group() else "line" if "\n" in m.group() else "sentence"
        found[m.end()] = kind
    found.pop(len(text), None)
    found.pop(0, None)
    return found


def _back(text: str, end: int, overlap: int) -> int:
    """Where the piece after a cut at ``end`` starts: at a word's start within the overlap, where there is one."""
    m = _START.search(text, max(0, end - overlap), end)
    return m.start() + 1 if m else _safe(text, max(0, end - overlap))


def _chain(text: str, at: list[int], kinds: list[str], limit: int, overlap: int) -> list[tuple[int, int, str]] | None:
    """The cheapest admissible pieces (start, end, kind of the cut at the end), or None.

    Ends within ``overlap`` of each other cannot follow each other: such a block is
    priced at once, against all earlier ends that a piece can span.
    """
    n = len(text)
    ends = np.array([*at, n], np.int64)
    own = np.array([*(PENALTY[k] for k in kinds), 0.0])
    backs = np.array([*(_back(text, e, overlap) for e in at), n], np.int64)
    pieces = max(1, -(-(n - overlap) // (limit - overlap)))
    even = (n + (pieces - 1) * overlap) / pieces
    cost, via = np.full(len(ends), np.inf), np.full(len(ends), -1, np.int64)
    j = lo = 0
    while j < len(ends):
        stop = int(np.searchsorted(ends, ends[j] + overlap, "right")) if j < len(ends) - 1 else len(ends)
        stop = max(j + 1, min(stop, len(ends) - 1)) if j < len(ends) - 1 else stop
        block = ends[j:stop]
        while lo < j and ends[j] - backs[lo] > limit and ends[j] - ends[lo] > limit:
            lo += 1
        best = np.where(block <= limit, ((block - even) / even) ** 2, np.inf)
        if lo < j:
            size = (block[:, None] - backs[None, lo:j]).astype(float)
            gap = 0 if j == len(ends) - 1 else overlap
            price = np.where((size <= limit) & (ends[None, lo:j] < block[:, None] - gap), cost[None, lo:j] + ((size - even) / even) ** 2, np.inf)
            k = price.shape[1] - 1 - np.argmin(price[:, ::-1], 1)  # of equal ones the last
            cheapest = price[np.arange(len(block)), k]
            better = cheapest < best
            best, via[j:stop] = np.where(better, cheapest, best), np.where(better, lo + k, -1)
        cost[j:stop] = best + own[j:stop]
        j = stop
    if cost[-1] == np.inf:
        return None
    out, j = [], len(ends) - 1
    while j >= 0:
        i = int(via[j])
        out.append((int(backs[i]) if i >= 0 else 0, int(ends[j]), [*kinds, "end"][j] if j == len(ends) - 1 else kinds[j]))
        j = i
    return out[::-1]


def _gaps(text: str, found: dict[int, str], limit: int, overlap: int) -> list[tuple[int, int]]:
    """The stretches between neighbouring candidates that no piece can span."""
    marks = [0, *sorted(found), len(text)]
    return [(a, b) for a, b in zip(marks, marks[1:]) if b - (_back(text, a, overlap) if a else 0) > limit]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind) of at most ``limit`` code points that cover the text.

    A text within the limit, empty texts included, is one piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    found = _boundaries(text)
    for tier in ("strong", "word", "character", "all words", "all"):
        if tier in ("word", "all words"):
            for a, b in _gaps(text, found, limit, overlap) if tier == "word" else [(0, n)]:
                for m in _SPACE.finditer(text, a, b):
                    if a < m.end() < b:
                        found.setdefault(m.end(), "word")
        elif tier in ("character", "all"):
            for a, b in _gaps(text, found, limit, overlap) if tier == "character" else [(0, n)]:
                for x in {_safe(text, x) for x in range(a + 1, b)}:
                    if a < x < b:
                        found.setdefault(x, "character")
        if _gaps(text, found, limit, overlap):
            continue
        at = sorted(found)
        if (chain := _chain(text, at, [found[x] for x in at], limit, overlap)) is not None:
            return chain
    # runs of combining marks longer than the limit: nothing natural is left to keep
    step = limit - overlap
    return [(x, min(n, x + limit), "character") for x in range(0, max(1, n - overlap), step)]


def split_items(items: DataFrame, field: str, item_id: str, pos: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, unique: bool = False) -> DataFrame:
    """One row for each piece of each item longer than ``limit`` code points.

    ``field_name, item_id bigint, item_pos int, piece_no int, piece_start int,
    piece_end int, cut string`` and, with ``with_text``, ``piece``; positions
    count code points from 0. Nulls, empty and short items and items without an id give
    no row; repeated deliveries of an item give its pieces once. Other columns are not read. With
    ``unique`` the caller vouches that no item is repeated, and no piece is shuffled.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must lie below half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ids, places, texts = (b.column(k).to_pylist() for k in range(4))
            cols: list[list] = [[] for _ in range(8)]
            for f, i, p, t in zip(names, ids, places, texts):
                for k, (s, e, kind) in enumerate(cut(t, limit, overlap)):
                    for col, v in zip(cols, (f, i, p, k, s, e, kind, t[s:e] if with_text else None)):
                        col.append(v)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: 8 if with_text else 7], [x.split()[0] for x in schema.split(", ")])

    schema = "field_name string, item_id bigint, item_pos int, piece_no int, piece_start int, piece_end int, cut string" + ", piece string" * with_text
    long = items.select(F.col(field).alias("f"), F.col(item_id).cast("bigint").alias("i"), F.col(pos).cast("int").alias("p"), F.col(text).cast("string").alias("t")).where((F.length("t") > limit) & F.col("i").isNotNull())
    pieces = long.mapInArrow(run, schema)
    return pieces if unique else pieces.dropDuplicates(["field_name", "item_id", "item_pos", "piece_no"])


def corpus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, item_id, item_pos, item) of all passages and pretraining texts, a record delivered again once."""
    docs = first_deliveries(read(spark, sf_dir, "rag_in"), "ex_id").select(F.lit("docs").alias("field_name"), F.col("ex_id").alias("item_id"), F.posexplode("docs").alias("item_pos", "item"))
    texts = first_deliveries(read(spark, sf_dir, "pretrain_in"), "doc_id").select(F.lit("text").alias("field_name"), F.col("doc_id").alias("item_id"), F.lit(0).alias("item_pos"), F.col("text").alias("item"))
    return docs.unionByName(texts)


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(corpus_items(spark, sf_dir), "field_name", "item_id", "item_pos", "item", unique=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that come out in more than one piece: each has a piece with number 1."""
    pieces = split_items(corpus_items(spark, sf_dir), "field_name", "item_id", "item_pos", "item", with_text=False, unique=True)
    return pieces.where("piece_no = 1").select("field_name", "item_id", "item_pos")


P5_FOUND_SQL = """
SELECT DISTINCT 'text' AS field_name, doc_id AS item_id, CAST(0 AS INTEGER) AS item_pos FROM pretrain_in WHERE length(text) > 1200
UNION ALL
SELECT DISTINCT 'docs', ex_id, CAST(k - 1 AS INTEGER)
FROM (SELECT ex_id, docs, unnest(range(1, len(docs) + 1)) AS k FROM rag_in) WHERE length(docs[k]) > 1200
"""
