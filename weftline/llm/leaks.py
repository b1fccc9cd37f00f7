"""Problem 7: held-out items that occur in documents, whole or in part.

Method: a prefix-filtered set join. The shingles (five words) of the items are
ordered by rarity, that is by the number of documents they occur in. Of every two
shingles in a row the rarer is a necessary token: six intact words hold two shingles
in a row, and a passage of 15 words or more with one changed word in ten keeps six.
A run of n intact words holds (n - 4) // 2 tokens or more, so 25 words in such
passages hold four. Items' tokens are joined with documents' shingles: in the tasks if
the items have at most ``ITEM_WORDS`` words, which is checked, and by shuffle beyond. A
length bound (the shingles that the least overlap shares) and the least number of
tokens thin the candidates, and each is verified word by word.

Texts are read and cut into words once, however many items there are: a filter of
``FILTER_BITS`` bits over all items' shingles goes to the tasks, and documents with
enough shingles that pass it are kept as word numbers, which all that follows reads.
The filter only spares space; one full of items lets every document pass. Items that are
broadcast bring all their shingles, and a document is kept if it shares enough places of
one item: phrases that many items have in common keep none.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, signless

SHINGLE = 5
LEAST_WORDS, LEAST_PASSAGE, CHANGED = 25, 15, 0.1
#: Tokens (of every two shingles one) and shingles that the least overlap shares: n words with a tenth changed keep n - 5 n / 10 - 4 shingles.
MIN_HITS, MIN_SHARED = 4, 11
#: Bits of the filter that goes to the tasks (16 MB), and the tasks over which rows of a hot shingle or item are spread.
FILTER_BITS, SALTS = 27, 16
#: Words of all items up to which they are broadcast (40 MB, and as much for their shingles).
ITEM_WORDS = 2_000_000
#: Characters of texts whose words are looked up at once.
BLOCK_CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TAG = re.compile(r"""<!--.*?-->|</?[a-z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))*\s*/?>""", re.I | re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]\w{1,30});")


def plain(text: str) -> str:
    """A text without signs; tags are white space, so that none is glued to a word, and entities are what they stand for."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return signless(text)


def words(text: str) -> list[str]:
    return plain(text).split()


def _hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every five word numbers in a row; 0 where one is unknown (negative)."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    good = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            part = ids[k : k + n]
            good &= part >= 0
            h = (h ^ (part.astype(np.uint64) + np.uint64(1))) * _BASE
            h ^= h >> np.uint64(29)
    return np.where(good, np.maximum(h, np.uint64(1)), np.uint64(0))


class Numbers(dict):
    """63-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word) >> 1
        return n


def _numbers(texts: list[str], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts in one array, -1 after each text, and where each begins.

    Words are cut by Arrow, so that each is looked up once in a block of texts.
    """
    out, lengths = [], []
    block: list[str] = []
    size = 0
    for k, text in enumerate(texts, 1):
        block.append(plain(text) + " \n")  # ends with an empty part, the place of -1
        size += len(text)
        if size < BLOCK_CHARS and k < len(texts):
            continue
        cut = pc.utf8_split_whitespace(pa.array(block, pa.string()))  # the same white space as that of str.split
        each = cut.values.dictionary_encode()
        number = np.fromiter((numbers[w] if w else -1 for w in each.dictionary.to_pylist()), np.int64, len(each.dictionary))
        ids, offsets = number[each.indices.to_numpy()], cut.offsets.to_numpy()
        keep = ids >= 0
        keep[offsets[1:] - 1] = True
        out.append(ids[keep])
        lengths.append(np.diff(np.concatenate([[0], np.cumsum(keep)])[offsets]))
        block, size = [], 0
    return np.concatenate([*out, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(np.concatenate([*lengths, np.zeros(0, np.int64)]))])


def _extend(a: list[int], b: list[int], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """Matched places from (i, j) on in one direction, over single changed, added or missing words.

    A changed word needs one intact word behind it, an added or missing one three, as it
    moves all that follows; the longest stretch behind decides, a changed word first.
    """
    out = []
    na, nb = len(a), len(b)

    def run(x: int, y: int) -> int:
        n = 0
        while n < LEAST_PASSAGE and 0 <= x < na and 0 <= y < nb and a[x] == b[y]:
            x, y, n = x + step, y + step, n + 1
        return n

    while True:
        while 0 <= i < na and 0 <= j < nb and a[i] == b[j]:
            out.append((i, j))
            i, j = i + step, j + step
        most, to = 0, None
        for di, dj, least in ((1, 1, 1), (0, 1, 3), (1, 0, 3)):
            x, y = i + di * step, j + dj * step
            if (n := run(x, y)) >= least and n > most:
                most, to = n, (x, y)
        if to is None:
            return out
        i, j = to


def passages(a: list[int], b: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(item from, to, text from, to, words) of the passages through the seeds; changed words inside count.

    Every stretch of intact runs is one that has the least length and at most one changed word in ten.
    """
    done: set[tuple[int, int]] = set()
    found = []
    for i, j in seeds:
        if (i, j) in done:
            continue
        chain = _extend(a, b, i - 1, j - 1, -1)[::-1] + _extend(a, b, i, j, 1)
        done.update(chain)
        at = [0, *(k for k in range(1, len(chain)) if chain[k] != (chain[k - 1][0] + 1, chain[k - 1][1] + 1)), len(chain)]
        for p, lo in enumerate(at[:-1]):
            i0, j0 = chain[lo]
            for hi in at[p + 1 :]:
                i1, j1 = chain[hi - 1]
                n, wide = min(i1 - i0, j1 - j0) + 1, max(i1 - i0, j1 - j0) + 1
                if n >= LEAST_PASSAGE and wide - (hi - lo) <= CHANGED * n:
                    found.append((i0, i1, j0, j1, n))
    return found


def _apart(spans: list[tuple[int, int, int]]) -> int:
    """The most words of (from, to, words) stretches that do not overlap."""
    ends: list[int] = []
    best = [0]
    for lo, hi, n in sorted(spans, key=lambda s: s[1]):
        best.append(max(best[-1], best[bisect_left(ends, lo)] + n))
        ends.append(hi)
    return best[-1]


def overlap(a: list[int], b: list[int], seeds: list[tuple[int, int]]) -> int:
    """The most words that passages of LEAST_PASSAGE or more repeat.

    Words keep their order inside a passage; the passages may come in any order. They do
    not overlap in the item, nor in the text: the smaller of both counts.
    """
    found = set(passages(a, b, seeds))
    return min(_apart([(i0, i1, n) for i0, i1, _, _, n in found]), _apart([(j0, j1, n) for _, _, j0, j1, n in found]))


def seeds(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The places at which two sequences of word numbers have a shingle in common."""
    x, y = _hashes(a), _hashes(b)
    order = np.argsort(x, kind="stable")
    lo, hi = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
    return [(int(order[k]), w) for w in np.flatnonzero(hi > lo).tolist() for k in range(lo[w], hi[w])]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word numbers and shingles of items that have enough words."""
    numbers = Numbers()
    for b in batches:
        ids, starts = _numbers(b.column(1).to_pylist(), numbers)
        own = [ids[x : y - 1] for x, y in zip(starts, starts[1:])]
        good = [len(x) >= LEAST_WORDS for x in own]
        own = [x for x, g in zip(own, good) if g]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), _lists(own), _lists([_hashes(x).view(np.int64) for x in own])], ["i", "item", "shingles"])


def shingle_filter(held: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, set at every shingle ``h``; put together by Spark, 4 KB a row."""
    at = F.pmod("h", F.lit(1 << FILTER_BITS)) + 1
    rows = held.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows.collect():  # FILTER_BITS / 32,768 rows at most
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    return bits


def _entries(held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of at most ``ITEM_WORDS`` words in order, the place of each in the row of all items, and which item is at a place."""
    rows = held.select("i", "place", "h").toArrow().sort_by([("i", "ascending"), ("place", "ascending")])
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    return h[order], order.astype(np.int32), rows.column("i").to_numpy()


def sharing(doc: np.ndarray, h: np.ndarray, shingle: np.ndarray, place: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The documents that share at least ``MIN_SHARED`` places of one item; ``doc`` is in order, ``h`` its shingles."""
    lo = np.searchsorted(shingle, h, "left")
    n = np.searchsorted(shingle, h, "right") - lo
    ends = np.cumsum(n)
    found = [doc[:0]]
    a = 0
    while a < len(doc):  # whole documents, a million entries at once
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000, "right"))
        b = int(np.searchsorted(doc, doc[max(a, b - 1)], "right"))
        m = n[a:b]
        at = place[np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        key = np.sort(np.repeat(doc[a:b], m) * len(item) + at)
        key = key[np.diff(key, prepend=-1) != 0]  # a place counts once
        owner, own = key // max(1, len(item)), item[key % max(1, len(item))]
        first = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(own) != 0))[: len(key)])
        found.append(owner[first[np.diff(first, append=len(key)) >= MIN_SHARED]])
        a = b
    return np.unique(np.concatenate(found))


def contained(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """(item_id bigint, doc_id bigint, n_words int): items that documents repeat, with the words repeated.

    An item's passages count together in whatever order a document holds them.
    Null, empty and blank items and texts never match; items with fewer than
    ``LEAST_WORDS`` words cannot. Repeated rows give their pair once. Both tables stay
    distributed and may have any size; hot shingles and items are spread by a salt.
    """
    texts = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).cast("string").alias("t")).where("d is not null and length(t) > 0")
    queries = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and length(t) > 0").dropDuplicates(["i"])
    given = cut_lineage(queries.mapInArrow(_words, "i bigint, item array<bigint>, shingles array<bigint>"))
    held = given.select("i", F.posexplode("shingles").alias("place", "h"))
    small = (given.agg(F.sum(F.size("item"))).first()[0] or 0) <= ITEM_WORDS
    sent = docs.sparkSession.sparkContext.broadcast((shingle_filter(held), _entries(held) if small else None))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, entries), numbers = sent.value, Numbers()
        for b in batches:
            ids, starts = _numbers(b.column(1).to_pylist(), numbers)
            h = _hashes(ids)
            at = h.view(np.int64) % (1 << FILTER_BITS)
            hit = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (h != 0))
            doc = np.searchsorted(starts, hit, "right") - 1
            first, number = np.unique(doc, return_counts=True)
            kept = first[(number >= MIN_SHARED) & (np.diff(starts)[first] > LEAST_WORDS)] if len(first) else first
            if entries is not None:  # of one item, not of all
                kept = kept[np.isin(kept, sharing(doc, h[hit], *entries))]
            own = [np.unique(h[hit[np.searchsorted(doc, k, "left") : np.searchsorted(doc, k, "right")]]).view(np.int64) for k in kept]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), _lists([ids[starts[k] : starts[k + 1] - 1] for k in kept]), _lists(own)], ["d", "doc", "shingles"])

    found = texts.mapInArrow(hold, "d bigint, doc array<bigint>, shingles array<bigint>").withColumn("r", F.xxhash64("d", "doc"))
    found = cut_lineage(found)  # a row given twice gives its pairs twice, which are counted once at the end
    often = found.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    ranked = held.join(often, "h", "left").select("i", "h", "place", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h").alias("rank"))
    w = Window.partitionBy("i").orderBy("place")
    rarer = (F.col("rank") <= F.lead("rank").over(w)) | (F.col("rank") < F.lag("rank").over(w))
    tokens = cut_lineage(ranked.withColumn("chosen", F.coalesce(rarer, F.lit(True))).where("chosen").select("i", "h", "place"))
    pairs = _held_in_tasks(found, given, tokens) if small else _joined(found, given, tokens)
    return pairs.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"))


PAIRS = "item_id bigint, doc_id bigint, n_words int"


def _rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["item_id", "doc_id", "n_words"])


def _held_in_tasks(found: DataFrame, given: DataFrame, tokens: DataFrame) -> DataFrame:
    """The join with items of at most ``ITEM_WORDS`` words, which are broadcast: no document moves."""
    items = {r["i"]: r["item"] for r in given.select("i", "item").collect()}
    rows = tokens.select("h", "i", "place").sort("h").toArrow()
    sent = found.sparkSession.sparkContext.broadcast((items, *(rows.column(k).to_numpy() for k in range(3))))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, token, owner, place = sent.value
        for b in batches:
            out = []
            for d, doc in zip(b.column(0).to_pylist(), b.column(1)):
                doc = doc.values.to_numpy()
                h = _hashes(doc).view(np.int64)
                lo, hi = np.searchsorted(token, h, "left"), np.searchsorted(token, h, "right")
                hit = np.flatnonzero(hi > lo)
                n = (hi - lo)[hit]
                entry = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own, at, where = owner[entry], place[entry], np.repeat(hit, n)
                several, number = np.unique(own, return_counts=True)
                words = None
                for i in several[number >= MIN_HITS].tolist():
                    mine = own == i
                    p = at[mine]
                    if len(np.unique(p)) < MIN_HITS:
                        continue
                    words = words or doc.tolist()
                    k = overlap(items[i], words, list(zip(p.tolist(), where[mine].tolist())))
                    if k >= LEAST_WORDS:
                        out.append((i, d, k))
            yield _rows(out)

    return found.select("d", "doc").mapInArrow(join, PAIRS)


def _joined(found: DataFrame, given: DataFrame, tokens: DataFrame) -> DataFrame:
    """The join by shuffle, for items of any size; hot shingles and items are spread over ``SALTS`` tasks."""
    seen = found.select("r", F.explode("shingles").alias("h")).distinct()
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod("r", F.lit(SALTS)).cast("int").alias("salt")
    tokens = tokens.groupBy("i", "h").agg(F.count("*").alias("places")).select("i", "h", "places", spread)
    pairs = seen.select("r", "h", salt).join(tokens, ["h", "salt"]).groupBy("i", "r").agg(F.sum("places").alias("tokens")).where(F.col("tokens") >= MIN_HITS).select("i", "r", salt)
    whole = pairs.join(found.select("r", "d", "doc"), "r").join(given.select("i", "item", spread), ["i", "salt"]).select("i", "d", "item", "doc")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, d, a, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                a, t = a.values.to_numpy(), t.values.to_numpy()
                k = overlap(a.tolist(), t.tolist(), seeds(a, t))
                if k >= LEAST_WORDS:
                    out.append((i, d, k))
            yield _rows(out)

    return whole.mapInArrow(verify, PAIRS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_overlaps(spark, sf_dir).select("item_id", "doc_id")


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "heldout_items"), "doc_id", "text", "item_id", "text")
