"""Problem 8: abusive, hateful and sexual content, a score for every document.

Method: FTRL-proximal logistic regression over hashed word n-grams and skip-grams,
one model for each kind, with per-coordinate rates and L1 sparsity; the non-zero
weights are broadcast and every document is scored by its worst passage.

The model is fit on reviewers' verdicts (at most ``MOST_LABELLED`` documents, a hash
sample beyond that), in parts of ``PART_CHARS`` characters: every task runs FTRL over
one part, and Spark averages the weights feature by feature, by the evidence that each
part has for them; only sparse weights reach the driver. The passages of a part are
shuffled once and kept as one row, which every round reads. What is usual is told by the
number of documents that hold a word, counted over all documents. Verdicts are given
for documents, of which mostly one sentence counts, and some are wrong: training
starts from the log odds of words between flagged and all documents, takes the passage
of a flagged document that scores highest as its example, refits, and leaves out
verdicts that the fit contradicts. The cutoff is the one with the best F1 on a fifth
of the verdicts, by a model fit on the others. Every document is scored.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read

KINDS = ("abuse", "hate", "sexual")
MOST_LABELLED = 8_000
#: Characters of labelled text that one task fits on.
PART_CHARS = 2_000_000
BITS = 21
#: One of so many verdicts is held out for the cutoff, which is one of these.
FOLDS = 5
CUTOFFS = (0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3, 0.4, 0.5)
#: Weight of an example against that of a usual passage.
POSITIVE = 8.0
#: Added to the counts of documents behind the odds of a word, and the errors that its lower bound lies below.
SUPPORT, ERRORS = 0.5, 0.5
#: A word tells from this bound on, if so many times more flagged than other labelled documents hold it.
FLOOR, PURE = 0.5, 2
#: The summed bounds of its four most telling words that make a passage an example. One rule for every size.
EVIDENCE = 2.5
#: The log odds of a passage in which no word counts.
OFFSET = -4.0
#: Rate, smoothing, L1 and L2 of FTRL-proximal.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.1, 0.1
EPOCHS, ROUNDS = 2, 3
#: Steps of an epoch, whatever the number of rows, so that few and many documents are fit as far.
STEPS = 32
LONG, WINDOW, STRIDE = 40, 24, 12
#: Characters of texts whose words are looked up at once.
BLOCK_CHARS = 2_000_000
#: Ranges of features that are put together by themselves.
RANGES = 64
NUMBER = "#"

# Letters of other scripts that look Latin, and signs that stand for letters.
LOOKALIKES = str.maketrans("аеорсухіѕјкмтвнԁһӏαοερνικτυ", "aeopcyxisjkmtbhdhlaoepviktu")
SIGNS = str.maketrans("@$€!|", "aseil")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SPLIT = re.compile(r"[.!?…\n](?:(?<=\n)\n*|(?<!\n)[\"'”’»)]*\s+)")  # begins with one set, which is found fast
_TOKEN = re.compile(r"[\w*@$€!|'’-]+")
_EDGE = "_@!|'’-"
#: Signs that leave a word of letters alone when they stand around it.
_OUTER = "".join(c for c in string.punctuation if c not in "*$")
_SPACED = re.compile(r"[ \t]\w[ \t]\w(?!\w)(?<=(?<!\w)\w[ \t]\w[ \t]\w)")
_REPEAT = re.compile(r"(.)\1+")
_INNER = re.compile(r"['’_-]")
_MARKS = re.compile("[̀-ͯ]")


def plain(word: str) -> str:
    """A word without disguise: no inner signs, repeats or accents; masked letters stay '*'. Empty for signs alone."""
    word = word.strip(_EDGE)
    if not any(map(str.isalnum, word)):
        return ""
    if word.isalpha() and word.isascii():
        return _REPEAT.sub(r"\1", word)
    if word.isdigit():
        return NUMBER
    w = _INNER.sub("", word)
    if not w.isascii():
        w = _MARKS.sub("", unicodedata.normalize("NFKD", w)).translate(LOOKALIKES)
    if not w.isalpha():
        if sum(map(str.isalpha, w)) <= sum(map(str.isdigit, w)):
            return NUMBER
        w = re.sub(r"\d+$", "", w) if not re.search(r"\d[^\W\d_]", w) else w
        w = re.sub(r"(?<=[^\W\d_])[@$€!|]", lambda m: m[0].translate(SIGNS), w)
        if any(map(str.isdigit, w)):  # a digit stands for a letter, mostly a vowel
            w = re.sub(r"\d", "*", w)
    return _REPEAT.sub(lambda m: m[0] if m[1] == "*" else m[1], w) or NUMBER


def _folded(text: str) -> str:
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower() if not text.isascii() else text.lower()


def _plain_words(part: str) -> list[str]:
    """The plain words of what stands between white space."""
    inner = part.strip(_OUTER)
    if inner.isascii() and inner.isalpha():
        return [_REPEAT.sub(r"\1", inner)]
    return list(filter(None, map(plain, _TOKEN.findall(part))))


class _Known(dict):
    """What stands between white space or one plain word, and what it becomes."""

    def __init__(self, of: Callable[[str], Iterable]):
        self.of = of

    def __missing__(self, part: str) -> tuple:
        found = self[part] = tuple(self.of(part))
        return found


class Tokens:
    """Passages of a text as plain words, or what ``of`` makes of these; what a word becomes is kept."""

    def __init__(self, of: Callable[[list[str]], Iterable] = list) -> None:
        self.of, self.known, self.one = of, _Known(lambda part: of(_plain_words(part))), _Known(lambda word: of([word]))

    def _look(self) -> Callable[[str], tuple]:
        for known in (self.known, self.one):
            if len(known) > 300_000:
                known.clear()
        return self.known.__getitem__

    def distinct(self, text: str) -> set:
        """The different words of all passages."""
        text = _folded(text)
        if _SPACED.search(text) is not None:
            return {w for p in self.passages(text) for w in p}
        return set(chain.from_iterable(map(self._look(), set(text.split()))))

    def _spaced(self, part: str) -> list:
        return list(self.of(_joined([w for x in part.split() for w in _plain_words(x)])))

    def passages(self, text: str) -> list[list]:
        text = _folded(text)
        out, look = [], self._look()
        spaced = _SPACED.search(text) is not None
        for part in _SPLIT.split(text):
            row = self._spaced(part) if spaced else list(chain.from_iterable(map(look, part.split())))
            if not row:
                continue
            if len(row) <= LONG:
                out.append(row)
            else:
                out += [row[k : k + WINDOW] for k in range(0, len(row) - WINDOW + STRIDE, STRIDE)]
        return out

    def blocks(self, texts: list[str | None], cut: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text of each sentence, words in it, values of all words) for numeric values; every text is in one block.

        Without ``cut`` a text may be one sentence. Words are cut and numbered by Arrow, so
        that each is looked up once in a block.
        """
        parts: list[str] = []
        owner: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            text = _folded(text)
            if _SPACED.search(text) is not None:
                rows = list(map(self._spaced, _SPLIT.split(text)))
                n = np.fromiter(map(len, rows), np.int64, len(rows))
                yield np.full(len(rows), k), n, np.fromiter(chain.from_iterable(rows), np.uint64, int(n.sum()))
                continue
            found = _SPLIT.split(text) if cut else [text]
            parts += found
            owner += [k] * len(found)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield self._block(parts, owner)
                parts, owner, size = [], [], 0
        if parts:
            yield self._block(parts, owner)

    def _block(self, parts: list[str], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = pc.utf8_split_whitespace(pa.array(parts, pa.string()))  # the same white space as that of str.split
        each = cut.values.dictionary_encode()
        look = self._look()
        inner = pc.ascii_trim(each.dictionary, _OUTER)
        easy = pc.and_(pc.string_is_ascii(inner), pc.ascii_is_alpha(inner))
        at = easy.to_numpy(zero_copy_only=False)
        known = np.empty(len(at), object)
        for chosen, of, given in ((at, self.one.__getitem__, unrepeated(inner.filter(easy))), (~at, look, each.dictionary.filter(pc.invert(easy)))):
            known[chosen] = np.fromiter(map(of, given.to_pylist()), object, len(given))
        n = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.uint64, int(n.sum()))
        at = each.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(n[at])])
        return np.array(owner), np.diff(ends[cut.offsets.to_numpy()]), flat[spans((np.cumsum(n) - n)[at], n[at])]

    def held(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, value) for the different values of each text."""
        for owner, n, values in self.blocks(texts, cut=False):
            doc = np.repeat(owner, n)
            if len(values):
                size = int(values.max()) + 1
                pairs = np.unique(doc * size + values.astype(np.int64))
                yield pairs // size, pairs % size

    def tables(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The blocks with passages in place of sentences: long ones are cut, those without a word dropped."""
        for owner, n, values in self.blocks(texts):
            first = np.cumsum(n) - n
            cuts = np.where(n > LONG, -(-(n - WINDOW + STRIDE) // STRIDE), n > 0)
            if (cuts != 1).any():
                owner, whole, start = (np.repeat(x, cuts) for x in (owner, n, first))
                step = STRIDE * spans(np.zeros_like(cuts), cuts)
                n = np.where(whole > LONG, np.minimum(WINDOW, whole - step), whole)
                values = values[spans(start + step, n)]
            yield owner, n, values


def unrepeated(words: pa.StringArray) -> pa.StringArray:
    """ASCII words without repeated letters."""
    words = pa.concat_arrays([words])  # begins at 0
    offsets, data = words.buffers()[1:]
    ends = np.frombuffer(offsets, np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    letters = np.frombuffer(data, np.uint8, ends[-1]) if ends[-1] else np.zeros(0, np.uint8)
    kept = np.diff(letters, prepend=np.uint8(0)) != 0
    kept[ends[:-1]] = True
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(kept)])[ends].astype(np.int32)), pa.py_buffer(letters[kept]))


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first``, ``first`` + 1, ... of every stretch of ``n`` places, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _joined(found: list[str]) -> list[str]:
    """Runs of three or more single letters become one word."""
    out: list[str] = []
    run: list[str] = []
    for x in [*found, ""]:
        if len(x) == 1 and x.isalpha():
            run.append(x)
            continue
        out += [_REPEAT.sub(r"\1", "".join(run))] if len(run) > 2 else run
        run = []
        if x:
            out.append(x)
    return out


class Words:
    """Words as 64-bit hashes; a masked word is the most telling word that it can be."""

    def __init__(self, telling: dict[str, float]):
        self.value = telling
        self.known: dict[str, int] = {}
        self.by_shape: dict[tuple[int, str], list[tuple[float, str]]] = defaultdict(list)
        for w, value in telling.items():
            if len(w) > 2:
                self.by_shape[len(w), w[0]].append((value, w))

    def plain(self, word: str) -> str:
        if "*" not in word or word.count("*") > (len(word) + 1) // 2:
            return word
        shape = re.compile("".join("." if c == "*" else re.escape(c) for c in word))
        fits = [x for x in self.by_shape.get((len(word), word[0]), ()) if shape.fullmatch(x[1])]
        return max(fits)[1] if fits else word

    def of(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) > 300_000:
                self.known.clear()
            n = self.known[word] = xxhash.xxh3_64_intdigest(self.plain(word))
        return n


def features(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The features of lists of words."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return hashed(np.repeat(np.arange(len(rows)), lengths), np.fromiter((x for r in rows for x in r), np.uint64, int(lengths.sum())))


def hashed(row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of words ``w`` in rows: words, pairs, triples, and pairs with one or two words skipped."""
    out_row, out_key = [row], [w * np.uint64(0x9E3779B97F4A7C15)]
    with np.errstate(over="ignore"):
        for kind, steps in enumerate(((1,), (1, 2), (2,), (3,)), 1):
            n = len(w) - steps[-1]
            if n <= 0:
                continue
            same = row[:n] == row[steps[-1] :]
            h = w[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind)
            for s in steps:
                h = (h ^ (h >> np.uint64(31)) ^ w[s : s + n]) * np.uint64(0x9E3779B97F4A7C15)
            out_row.append(row[:n][same])
            out_key.append(h[same])
    key = np.concatenate(out_key)
    return np.concatenate(out_row), ((key ^ (key >> np.uint64(29))) % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1


def closely(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers below ``size``, in order, and the place of each number among them; nothing is sorted."""
    used = np.zeros(size, bool)
    used[numbers] = True
    own = np.flatnonzero(used)
    place = np.empty(size, np.int32)
    place[own] = np.arange(len(own))
    return own, place[numbers]


class Ftrl:
    """FTRL-proximal for all kinds side by side, over a fixed offset."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros((len(KINDS), size)), np.zeros((len(KINDS), size))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def fit(self, starts: np.ndarray, keys: np.ndarray, target: np.ndarray, weight: np.ndarray, used: np.ndarray, seed: int) -> None:
        """One pass in a fixed random order; row k has ``keys[starts[k]:starts[k + 1]]``."""
        order = np.random.default_rng(seed).permutation(used)
        for chosen in np.array_split(order, min(STEPS, max(1, len(order)))):
            n = starts[chosen + 1] - starts[chosen]
            r = np.repeat(np.arange(len(chosen)), n)
            f = keys[np.repeat(starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            at, inverse = closely(f, self.n.shape[1])
            w = self.weights(at)
            for k in range(len(KINDS)):
                p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[k][inverse], len(chosen)) + OFFSET, -30, 30)))
                error = (p - target[chosen, k]) * weight[chosen]
                g = np.bincount(inverse, error[r], len(at))
                old = self.n[k, at]
                self.z[k, at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w[k]
                self.n[k, at] = old + g * g


def scores(rows: list[list[int]], weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The probability of every kind for every passage."""
    if not rows:
        return np.zeros((0, len(KINDS)))
    return probabilities(*features(rows), len(rows), weights)


def telling(bad: float, expected: float) -> float:
    """A lower bound of the log odds of a word that ``bad`` flagged documents hold where ``expected`` would by chance.

    Rises with the odds and with the documents behind them, whatever the number of all documents.
    """
    return math.log((bad + SUPPORT) / (expected + SUPPORT)) - ERRORS / math.sqrt(bad + SUPPORT)


PASSAGES = "part int, fold int, doc_id bigint, share double, kind int, first double, keys array<int>"
BLOCKS = "block int, data binary"


def best_four(row: np.ndarray, w: np.ndarray, rows: int, told: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The summed worth of the four most telling words of each row; four, so that long ones do not win by length."""
    if not len(told):
        return np.zeros(rows)
    at = np.minimum(np.searchsorted(told, w), len(told) - 1)
    hit = np.flatnonzero(told[at] == w)
    row, value = row[hit], worth[at[hit]]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    behind = np.searchsorted(row, row, "right") - np.arange(len(row))
    return np.bincount(row[behind <= 4], value[behind <= 4], rows)


def passages(sample: DataFrame, telling: dict[str, float]) -> DataFrame:
    """One row for each passage of the labelled documents: its features, and ``first``, its four most telling words."""
    sent = sample.sparkSession.sparkContext.broadcast(telling)
    names = [x.split()[0] for x in PASSAGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        tokens = Tokens(lambda found: map(words.of, found))
        value = sorted((xxhash.xxh3_64_intdigest(w), v) for w, v in sent.value.items())
        told, worth = np.array([h for h, _ in value], np.uint64), np.array([v for _, v in value], float)
        for b in batches:
            for owner, n, w in tokens.tables(b.column("text").to_pylist()):
                row = np.repeat(np.arange(len(n)), n)
                at = pa.array(owner, pa.int64())
                r, f = hashed(row, w)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(n)))])
                kind = [KINDS.index(x) if x in KINDS else -1 for x in b.column("kind").to_pylist()]
                keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f[np.argsort(r, kind="stable")].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names[:4]), pa.array(kind, pa.int32()).take(at), pa.array(best_four(row, w, len(n), told, worth) / EVIDENCE), keys], names)

    return sample.select("part", "fold", "doc_id", "share", "kind", "text").mapInArrow(run, PASSAGES)


def examples(first: np.ndarray, share: float, kind: int, seen: np.ndarray | None) -> tuple[np.ndarray, int, int]:
    """(weight of each passage of a document, its example or -1, the example's kind) by its verdicts and the last fit."""
    if share <= 0.5:  # what looks bad in documents without a clear verdict is left out
        doubt = first > 0.75 if seen is None else (seen.max(1) > 0.5) & (first > 0.5)
        if share <= 0.25 and seen is None:
            doubt[:] = False
        return np.where(doubt, 0.0, 1.0 if share <= 0.25 else 0.5), -1, -1
    if seen is None:
        best = int(np.argmax(first))
        sure = first[best] >= 1
    else:
        own = seen.max(1) if kind < 0 else seen[:, kind]
        best = int(np.argmax(own + 0.4 * np.minimum(first, 1.25)))
        sure = own[best] >= 0.15 and first[best] >= 0.75
        kind = kind if kind >= 0 else int(np.argmax(seen[best]))
    weight = np.where(first > 0.5, 0, 0.5)
    weight[best] = POSITIVE if kind >= 0 and sure else 0
    return weight, best if weight[best] else -1, kind


Sparse = tuple[np.ndarray, np.ndarray]


def spread(sparse: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """The weights of all kinds at their features, zero elsewhere, and where they are not all zero."""
    dense, used = np.zeros((len(KINDS), 1 << BITS), np.float32), np.zeros(1 << BITS, bool)
    dense[:, sparse[0]], used[sparse[0]] = sparse[1], True
    return dense, used


def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def packed(rows: DataFrame) -> DataFrame:
    """One row for each part: its passages in the order of their documents, as an Arrow stream; they are shuffled once."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"data": pa.array([_packed(table.sort_by([("doc_id", "ascending")]).combine_chunks())], pa.binary())})

    return cut_lineage(rows.groupBy("part").applyInArrow(run, "data binary"))


def _ranges(block: int, feature: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block, data) for every range of features, which are in order."""
    edges = np.searchsorted(feature, np.arange(RANGES + 1) << BITS >> RANGES.bit_length() - 1)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            yield block * RANGES + k, _packed(pa.table([feature[a:b].astype(np.int32), *(v[a:b] for v in values)], [f"c{k}" for k in range(len(values) + 1)]))


def _merged(parts: DataFrame, merge: Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, ...]]) -> dict[int, list[np.ndarray]]:
    """The columns of every block, put together range by range in tasks: ``merge`` gets close numbers of features and all values, and gives which features stay and their values."""

    def run(table: pa.Table) -> pa.Table:
        found = pa.concat_tables(map(_unpacked, table.column("data")))
        feature, *values = (c.to_numpy() for c in found.columns)
        own, at = closely(feature, 1 << BITS)
        keep, *merged = merge(at, values)
        data = _packed(pa.table([own[keep], *(m[keep] for m in merged)], [f"c{k}" for k in range(len(merged) + 1)]))
        return pa.table({"block": table.column("block")[:1], "data": pa.array([data], pa.binary())})

    out: dict[int, list[pa.Table]] = defaultdict(list)
    rows = parts.groupBy("block").applyInArrow(run, BLOCKS).toArrow()  # at most 2 ** BITS features a block
    for block, data in sorted(zip(rows.column("block").to_pylist(), rows.column("data")), key=lambda x: x[0]):
        out[block // RANGES].append(_unpacked(data))
    return {k: [c.to_numpy() for c in pa.concat_tables(t).columns] for k, t in out.items()}


def _blocks_of(found: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["block", "data"])


def shared_features(parts: DataFrame) -> np.ndarray:
    """The features of more than one passage, in order; one of a single passage says nothing of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data"):
                keys = _unpacked(data).column("keys").combine_chunks()
                row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
                n = np.bincount(np.unique(row << BITS | keys.values.to_numpy()) & (1 << BITS) - 1)
                own = np.flatnonzero(n)
                yield _blocks_of(_ranges(0, own, np.minimum(n[own], 2).astype(np.int32)))

    def merge(at: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        return (np.bincount(at, values[0]) > 1,)

    return _merged(parts.mapInArrow(run, BLOCKS), merge).get(0, [np.zeros(0, np.int64)])[0]


def fit_part(table: pa.Table, sparse: Sparse | None, number: int) -> tuple[np.ndarray, Ftrl]:
    """(features, the model of these) of one part whose keys are all in use."""
    keys = table.column("keys").combine_chunks()
    at, flat = keys.offsets.to_numpy().astype(np.int64), keys.values.to_numpy()
    own, close = closely(flat, 1 << BITS)  # features in use, numbered closely
    first, share, kinds, docs = (table.column(c).to_numpy() for c in ("first", "share", "kind", "doc_id"))
    seen = None
    if sparse is not None:
        row = np.repeat(np.arange(len(first)), np.diff(at))
        seen = probabilities(row, flat, len(first), spread(sparse))
    target, weight = np.zeros((len(first), len(KINDS))), np.ones(len(first))
    edges = [0, *(np.flatnonzero(np.diff(docs)) + 1).tolist(), len(docs)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            weight[a:b], best, kind = examples(first[a:b], share[a], int(kinds[a]), None if seen is None else seen[a:b])
            if best >= 0:
                target[a + best, kind] = 1
    model = Ftrl(len(own))
    for epoch in range(EPOCHS):
        model.fit(at, close, target, weight, np.flatnonzero(weight > 0), seed=17 * number + epoch)
    return own, model


def fit(parts: DataFrame, listed: np.ndarray) -> tuple[Sparse, Sparse]:
    """(features, their weights for all kinds) by all folds but the first, and by all: ``ROUNDS`` rounds, in each of which every part is fit by itself and Spark averages.

    Both are fit side by side. ``listed`` holds the features that count.
    """
    context = parts.sparkSession.sparkContext
    sparse: list[Sparse | None] = [None, None]
    for number in range(ROUNDS):
        sent = context.broadcast((listed, sparse, number))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed, sparse, number = sent.value
            used = np.zeros(1 << BITS, bool)
            used[listed] = True
            for b in batches:
                for data in b.column("data"):
                    table = _unpacked(data).combine_chunks()
                    keys = table.column("keys").combine_chunks()
                    at, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
                    keep = used[flat]
                    keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[at], pa.int32()), pa.array(flat[keep]))
                    table = table.set_column(table.column_names.index("keys"), "keys", keys)
                    for k, chosen in enumerate((table.filter(pc.field("fold") > 0), table)):
                        if len(chosen):
                            own, model = fit_part(chosen, sparse[k], number)
                            met = np.flatnonzero(model.n.any(0))
                            yield _blocks_of(_ranges(k, own[met], *model.weights(met), *model.n[:, met]))

        def merge(at: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
            """Averages by the evidence that each part has."""
            w, n = values[: len(KINDS)], values[len(KINDS) :]
            mean = [np.bincount(at, x * y) / np.maximum(np.bincount(at, y), 1e-9) for x, y in zip(w, n)]
            return np.any(mean, 0), *(m.astype(np.float32) for m in mean)

        found = _merged(parts.mapInArrow(run, BLOCKS), merge)
        none = [np.zeros(0, np.int64), *(np.zeros(0, np.float32) for _ in KINDS)]
        sparse = [(f, np.stack(w)) for f, *w in (found.get(k, none) for k in range(2))]
        sent.unpersist()
    return sparse[0], sparse[1]


def probabilities(row: np.ndarray, keys: np.ndarray, n: int, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dense, used = weights
    hit = np.flatnonzero(used[keys])  # most features have no weight
    row, keys = row[hit], keys[hit]
    out = np.stack([np.bincount(row, w[keys], n) + OFFSET for w in dense], 1)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def cutoff(held: list[float], flagged: dict[float, float]) -> float:
    """The cutoff with the best F1 in all documents, the middle one of equals.

    ``held`` are the scores of held-out flagged documents: they give the recall. In how
    many of all documents the score reaches a cutoff (``flagged``) gives the precision;
    reviewers see more flagged documents than there are, so that theirs would be too high.
    """
    recall = {c: sum(s >= c for s in held) / max(1, len(held)) for c in flagged}
    sure = max(CUTOFFS)
    true = flagged[sure] / recall[sure] if recall[sure] else flagged[sure]
    f1 = {c: 2 * true * recall[c] / max(1e-9, true + flagged[c]) for c in CUTOFFS}
    equal = [c for c in CUTOFFS if f1[c] >= max(f1.values()) - 1e-9]
    return equal[(len(equal) - 1) // 2]


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, share, kind, part, fold) of documents with verdicts, at most about ``MOST_LABELLED``."""
    verdicts = labels.where("doc_id is not null and flagged is not null").groupBy("doc_id").agg(F.avg("flagged").alias("share"), F.mode("kind").alias("kind"))
    total = verdicts.count()
    if total > MOST_LABELLED:
        verdicts = verdicts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * MOST_LABELLED / total))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = cut_lineage(texts.join(F.broadcast(verdicts), "doc_id").dropDuplicates(["doc_id"]))
    parts = -(-int(sample.agg(F.sum(F.length("text"))).first()[0] or 1) // PART_CHARS)
    of = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).cast("int")
    return sample.withColumns({"part": of(5, parts), "fold": of(6, FOLDS)})


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, bad, good): in how many flagged and in how many other labelled documents a word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        tokens, seen = Tokens(lambda words: [number.setdefault(w, len(number)) for w in words]), np.zeros((2, 0), np.int64)
        for b in batches:
            good = b.column(1).to_numpy() <= 0.5
            for doc, w in tokens.held(b.column(0).to_pylist()):
                seen = np.pad(seen, ((0, 0), (0, len(number) - seen.shape[1])))
                for side in (0, 1):
                    seen[side] += np.bincount(w[good[doc] == bool(side)], minlength=len(number))
        yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *map(pa.array, seen)], ["word", "bad", "good"])

    return sample.select("text", "share").mapInArrow(run, "word string, bad bigint, good bigint").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def telling_words(docs: DataFrame, sample: DataFrame) -> dict[str, float]:
    """Words that tell flagged documents, with the lower bounds of their log odds against all documents."""
    flagged = sample.where("share > 0.5").count()
    rows = word_counts(sample).where(f"bad > {PURE} * good and word not like '%*%' and word <> '{NUMBER}'").collect()  # words of MOST_LABELLED documents
    bad = {r["word"]: r["bad"] for r in rows}
    count, total = document_counts(docs, set(bad))
    odds = {w: telling(n, count[w] * flagged / max(1, total)) for w, n in bad.items() if count[w] > 1}  # others are as rare in new texts
    return {w: v for w, v in odds.items() if v > FLOOR}


def model(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray, np.ndarray, list[float]]:
    """(telling words, features in use, their weights, scores of held-out flagged documents), all of bounded size."""
    sample = labelled_sample(docs, labels)
    words = telling_words(docs, sample)
    rows = cut_lineage(passages(sample, words))
    parts = packed(rows)
    trial, final = fit(parts, shared_features(parts))
    held = rows.where("fold = 0")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = spread(sent.value)
        for b in batches:
            keys = b.column("keys")
            n = np.diff(keys.offsets.to_numpy())
            flat = keys.values.to_numpy()[keys.offsets[0].as_py() : keys.offsets[-1].as_py()]
            top = probabilities(np.repeat(np.arange(b.num_rows), n), flat, b.num_rows, dense).max(1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(top), b.column("share")], ["doc_id", "top", "share"])

    sent = docs.sparkSession.sparkContext.broadcast(trial)
    judged = held.mapInArrow(judge, "doc_id bigint, top double, share double").groupBy("doc_id").agg(F.max("top").alias("top"), F.first("share").alias("share"))
    top = [r["top"] for r in judged.where("share > 0.5").collect()]  # a fifth of MOST_LABELLED
    return words, *final, top


def document_counts(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How many of all documents hold each word of the (bounded) vocabulary, and how many have a text."""
    names = sorted(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = sent.value, np.zeros(len(sent.value) + 1, np.int64)
        tokens = Tokens(lambda words: [number[w] for w in words if w in number])
        for b in batches:
            seen[-1] += b.num_rows
            for _, w in tokens.held(b.column(0).to_pylist()):
                seen += np.bincount(w, minlength=len(seen))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], ["k", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    found = {r["k"]: r["n"] for r in rows}
    total = found.pop(len(names), 0)
    return {w: found.get(k, 0) for k, w in enumerate(names)}, total


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, kind, abuse, hate, sexual): one row for each row of ``doc_id, text``.

    Scores are probabilities of the worst passage; ``kind`` is the likeliest kind if
    its score reaches the cutoff, else null. Null, empty and blank texts score 0.
    Without any verdict that flags, all scores are equal and low and no kind is given.
    """
    telling, used, weights, held = model(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((telling, used, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling, at, w = sent.value
        words = Words(telling)
        dense = spread((at, w))
        tokens = Tokens(lambda found: map(words.of, found))
        for b in batches:
            out = np.zeros((b.num_rows, len(KINDS)))
            for owner, n, values in tokens.tables(b.column(1).to_pylist()):
                each = probabilities(*hashed(np.repeat(np.arange(len(n)), n), values), len(n), dense)
                first = np.flatnonzero(np.diff(owner, prepend=-1))  # passages of a text follow one another
                if len(first):
                    out[owner[first]] = np.maximum.reduceat(each, first)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, k]) for k in range(len(KINDS)))], ["doc_id", *KINDS])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(given.mapInArrow(run, "doc_id bigint, abuse double, hate double, sexual double").withColumn("score", F.greatest(*KINDS)))
    reached = rows.agg(*(F.count_if(F.col("score") >= c).alias(str(c)) for c in CUTOFFS)).first()
    least = cutoff(held, {c: reached[k] for k, c in enumerate(CUTOFFS)})
    kind = F.coalesce(*(F.when(F.col(k) == F.col("score"), k) for k in KINDS))
    return rows.select("doc_id", "score", F.when(F.col("score") >= least, kind).alias("kind"), *KINDS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "content_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("kind is not null").select("doc_id", "kind").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and flagged shares by source and by its family; a null source is a group of its own."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    families = read(spark, sf_dir, "corpus_sources").dropDuplicates(["source"])
    flagged = _scored(spark, sf_dir).select("doc_id", "kind")
    rows = docs.join(flagged, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), *(F.sum((F.col("kind") == k).cast("int")).alias(k) for k in KINDS))
    rows = rows.join(F.broadcast(families), "source", "left").fillna(0, list(KINDS))
    return rows.select("source", "family", "documents", *KINDS, ((F.col("abuse") + F.col("hate") + F.col("sexual")) / F.col("documents")).alias("rate"))
