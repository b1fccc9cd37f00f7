"""Problem 3: records of the evaluation splits that also occur, exactly or almost, in training.

Method: Aho-Corasick automata over sharded, normalised passages of the evaluation
records scan all training texts; matched intervals are merged into the coverage of
each evaluation record, and records covered enough are compared word by word.

Records are taken as classes of equal word sequences. A text becomes a row of codes,
four signs a word; a question keeps its letters. Every distinct evaluation record
gives passages at places that do not overlap, so that each allowed change can hit
one of them only: of more passages than changes one stays intact in every copy, and
no copy is missed. The rarest passages of a record are taken, as counted in its shard.

A shard holds ``SHARD_WORDS`` words of evaluation texts or ``QUERY_WORDS`` of questions. Every
training text streams through the automaton of every shard, without a shuffle of texts; copies are
dropped in each task. There are ceil(evaluation words / ``SHARD_WORDS``) passes over the coded
training texts (15 % of the size of the texts), each with a broadcast of one shard's codes. The
automaton over texts reads words, in arrays, and a block of texts at once; a record is met by its
rarest passages only, as many as surely hold one or more that no change hits.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, side_of, words

#: Changed, added or missing words, as a share of the longer text.
CHANGED = 0.14
ADDRESS = 3
#: Words in a passage of a text, passages of a text beyond its allowed changes (where it has so many), and parts of a question.
PASSAGE, SPARE, PARTS = 4, 6, 4
#: Passages of a text, the rarest ones, beyond its allowed changes by which it is met.
SEEDS = 3
#: Words of evaluation texts in one shard: 4 million passages, 300 MB in each worker; and of questions.
SHARD_WORDS, QUERY_WORDS = 16_000_000, 2_000_000
#: Words of the texts whose matches are counted together.
BLOCK_WORDS = 200_000
#: Places of passages, or words, of pairs that are held at once.
MOST_MET = 8_000_000
#: Rows of a hot class are spread over so many tasks when pairs are written out.
SALTS = 16
#: Signs of a word's code: 24 bits, so that a changed word looks the same once in 16 million.
SIGNS, WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", 4
_SEEN = 100_000
_NONE: dict = {}


def _halves(w: list[str]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(" ".join(w))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


class Codes(dict):
    """Four signs for each word, kept while there are not too many."""

    def __missing__(self, word: str) -> str:
        h = xxhash.xxh32_intdigest(word)
        code = SIGNS[h & 63] + SIGNS[h >> 6 & 63] + SIGNS[h >> 12 & 63] + SIGNS[h >> 18 & 63]
        if len(self) > 500_000:
            self.clear()
        self[word] = code
        return code


def most_changes(n: int) -> int:
    """The changes that a text of ``n`` words and its longest possible copy may have."""
    return int(CHANGED * int(n / (1 - CHANGED) + 1e-9) + 1e-9)


def edits(a: list[str], b: list[str], most: int) -> int | None:
    """Changed, added and missing words between two sequences, or None if more than ``most``.

    Furthest places on each diagonal for 0, 1, 2, ... edits; exact.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None

    def slide(i: int, d: int) -> int:
        j = i + d
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    reach = {0: slide(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        new = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i >= 0 and i + d >= 0:
                new[d] = slide(i, d)
        reach = new
    return None


def one_slip(a: str, b: str) -> bool:
    """Whether two strings are equal or differ by one letter changed, added, missing or two swapped; digits must agree."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or "".join(filter(str.isdigit, a)) != "".join(filter(str.isdigit, b)):
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def same_question(a: list[str], b: list[str]) -> tuple[int, int] | None:
    """The words of address in front of either, up to three, behind which they are equal up to one slip of the pen; None if they are not."""
    for i in range(min(ADDRESS, len(a) - 1) + 1):
        for j in range(min(ADDRESS, len(b) - 1) + 1):
            if abs((len(a) - i) - (len(b) - j)) <= 1 and one_slip("".join(a[i:]), "".join(b[j:])):
                return i, j
    return None


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals (from, to), in order; such as touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def text_spans(a: np.ndarray, b: np.ndarray, places: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """The words of ``a`` in the matches of its passages in ``b``, each carried on in both directions while words are equal."""
    out = []
    for d in np.unique(at - places).tolist():
        low = max(0, -d)
        high = min(len(a), len(b) - d)
        breaks = np.concatenate([[low - 1], low + np.flatnonzero(a[low:high] != b[low + d : high + d]), [high]])
        k = np.unique(np.searchsorted(breaks, places[at - places == d]))
        out += zip((breaks[k - 1] + 1).tolist(), breaks[k].tolist())
    return merged(out)


def question_spans(a: list[str], b: list[str], address: tuple[int, int]) -> list[tuple[int, int]]:
    """The letters of question ``a`` that match those of ``b`` before and behind the slip, without the address."""
    x, y = "".join(a[address[0] :]), "".join(b[address[1] :])
    first = len("".join(a)) - len(x)
    before = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    behind = next((k for k, (p, q) in enumerate(zip(x[::-1], y[::-1])) if p != q), min(len(x), len(y)))
    return merged([(first, first + before), (first + len(x) - behind, first + len(x))])


def _automaton(numbers: dict[str, int]) -> Any:
    """The automaton over passages with their numbers, None without any."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for passage, number in numbers.items():
        automaton.add_word(passage, number)
    if numbers:
        automaton.make_automaton()
    return automaton if numbers else None


def _symbols(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts one behind another, a number each, and where each text begins; no copy is made."""
    _, offsets, data = codes.buffers()
    at = np.frombuffer(offsets, np.int32)[codes.offset : codes.offset + len(codes) + 1]
    flat = np.frombuffer(data, "<u4", (at[-1] - at[0]) // WIDTH, at[0]) if data and at[-1] > at[0] else np.zeros(0, np.uint32)
    return flat, (at - at[0]).astype(np.int64) // WIDTH


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, ``n`` numbers a row."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class WordAutomaton:
    """Aho-Corasick over words, for passages of at most ``PASSAGE`` words, that reads all words of a block at once.

    States are the beginnings of passages, 0 is the root; the goto function is one hash table in arrays,
    keyed by state and word. The states that a word leaves the automaton in, the longest and those that its failure
    links lead to, differ in length and are at most ``PASSAGE``: they are walked length by length.
    """

    def __init__(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.final, keys, n = np.zeros(len(at), np.int64), [np.array([-1])], 1
        for depth in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > depth)
            own, inverse = np.unique(self.final[on] << 32 | flat[at[on] + depth], return_inverse=True)
            self.final[on] = n + inverse
            keys.append(own)
            n += len(own)
        self.keys = np.concatenate(keys)
        self.shift = np.uint64(64 - max(4, int(2 * n).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.table = np.zeros(self.mask + 1, np.int32)
        left, slot = np.arange(1, n), self._slot(self.keys[1:])
        while len(left):
            free = self.table[slot] == 0
            self.table[slot[free]] = left[free]
            missed = self.table[slot] != left
            left, slot = left[missed], slot[missed] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F) >> self.shift).astype(np.int64)

    def goto(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        keys = states << 32 | words
        slot = self._slot(keys)
        found = self.table[slot]
        wrong = np.flatnonzero((self.keys[found] != keys) & (found > 0))
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & self.mask
            again = self.table[slot[wrong]]
            found[wrong] = again
            wrong = wrong[(self.keys[again] != keys[wrong]) & (again > 0)]
        return found

    def scan(self, flat: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(where it begins, state) of all states that are passed, by length; ``begins`` marks the first words of texts."""
        at = np.arange(len(flat))
        states = np.zeros(len(flat), np.int64)
        for depth in range(PASSAGE):
            states = self.goto(states, flat[at + depth]).astype(np.int64)
            alive = np.flatnonzero(states)
            at, states = at[alive], states[alive]
            yield at, states
            on = at + depth + 1 < len(flat)
            on[on] = ~begins[at[on] + depth + 1]
            at, states = at[on], states[on]


class Texts:
    """Evaluation texts, given by their classes and codes, and the automaton over their passages.

    Of the passages that are taken of a record, as many stay whole in every copy as are taken beyond its changes. So
    records are met by their rarest passages alone, ``SEEDS`` beyond the changes; all that are taken give the coverage.
    """

    def __init__(self, table: pa.Table):
        self.c1, self.c2 = (table.column(c).to_numpy() for c in ("c1", "c2"))
        self.words, edges = _symbols(table.column("code").combine_chunks())
        self.start, self.length, rows = edges[:-1], np.diff(edges), table.num_rows
        changes = np.array([most_changes(n) for n in self.length.tolist()], np.int64)
        self.size = np.maximum(1, np.minimum(PASSAGE, self.length // (changes + 1)))
        number = self.length // self.size
        record = np.repeat(np.arange(rows), number)
        place = _ranges(np.zeros(rows, np.int64), number) * self.size[record]
        self.automaton = WordAutomaton(self.words, self.start[record] + place, self.size[record])
        final, self.automaton.final = self.automaton.final, None
        self.states = len(self.automaton.keys)
        order = np.lexsort((np.bincount(final, minlength=1)[final], record))  # each record's, the rarest first
        rank = _ranges(np.zeros(rows, np.int64), number)
        seeds, taken = order[rank < changes[record] + SEEDS], order[rank < changes[record] + SPARE]
        self.seed_need, self.need = np.minimum(number - changes, SEEDS), np.minimum(number - changes, SPARE)
        # passages of each record
        self.own = np.concatenate([[0], np.cumsum(np.minimum(number, changes + SPARE))])
        self.own_state, self.own_place = final[taken].astype(np.int32), place[taken].astype(np.int32)
        # records of each passage by their length
        seeds = seeds[np.lexsort((self.length[record[seeds]], final[seeds]))]
        self.record, self.place = record[seeds].astype(np.int32), place[seeds].astype(np.int32)
        self.key = final[seeds] << 32 | self.length[self.record]
        self.first = np.searchsorted(final[seeds], np.arange(self.states + 1)).astype(np.int32)
        self.listed = np.zeros(self.states, bool)
        self.listed[final[taken]] = True

    def _covered(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """(text, record) of the pairs in which passages cover the record enough, and (number of the pair, place in the record, place in the text) of these passages; None if the texts are too many to be counted at once."""
        rows = len(self.length)
        begins = np.zeros(len(flat), bool)
        begins[starts] = True
        passed = [(a[self.listed[s]], s[self.listed[s]]) for a, s in self.automaton.scan(flat, begins)]
        at, state = (np.concatenate(x) for x in zip(*passed))
        text = np.repeat(np.arange(len(lengths)), lengths)[at]
        key = text * self.states + state
        order = np.argsort(key, kind="stable")
        hit, low = np.unique(key[order], return_index=True)  # a passage in a text, and its first and last place there
        high = at[order[np.append(low[1:], len(order)) - 1]] if len(order) else low
        low = at[order[low]]
        text, state = hit // self.states, hit % self.states
        low, high = low - starts[text], high - starts[text]
        # seeds: records of a length that fits, in which the passage is not moved further than there may be changes
        some = np.flatnonzero(self.first[state + 1] > self.first[state])
        n = lengths[text[some]]
        longest = np.ceil(n / (1 - CHANGED)).astype(np.int64)
        key = state[some] << 32
        key = np.stack([key | np.floor(n * (1 - CHANGED)).astype(np.int64), key | longest])
        order = np.argsort(key[0])  # neighbours are looked up one after another
        some, n, longest, key = some[order], n[order], longest[order], key[:, order]
        a, b = np.searchsorted(self.key, key[0]), np.searchsorted(self.key, key[1], "right")
        if (b - a).sum() > MOST_MET and len(lengths) > 1:
            return None
        most = (CHANGED * longest).astype(np.int64)
        x, h = _ranges(a, b - a), np.repeat(np.arange(len(some), dtype=np.int32), b - a)
        place = self.place[x]
        fits = np.flatnonzero((place >= (low[some] - most).astype(np.int32)[h]) & (place <= (high[some] + most).astype(np.int32)[h]))
        k, h = self.record[x[fits]].astype(np.int64), h[fits]
        fits = np.abs(self.length[k] - n[h]) <= CHANGED * np.maximum(self.length[k], n[h])
        k, h = k[fits], some[h[fits]]
        pair, hits = np.unique(text[h] * rows + k, return_counts=True)
        pair = pair[hits >= self.seed_need[pair % rows]]
        # coverage by all passages taken
        t, k = pair // rows, pair % rows
        own = self.own[k + 1] - self.own[k]
        x, which = _ranges(self.own[k], own), np.repeat(np.arange(len(pair)), own)
        key = t[which] * self.states + self.own_state[x]
        at = np.minimum(np.searchsorted(hit, key), len(hit) - 1)
        found = np.flatnonzero(hit[at] == key)
        at, which, place = at[found], which[found], self.own_place[x[found]].astype(np.int64)
        enough = np.bincount(which, minlength=len(pair)) >= self.need[k]
        at, place, which = at[enough[which]], place[enough[which]], (np.cumsum(enough) - 1)[which[enough[which]]]
        closest = np.where(np.abs(low[at] - place) <= np.abs(high[at] - place), low[at], high[at])
        return t[enough], k[enough], which, place, closest

    def _common(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Words that each pair has in common, in any order."""
        pair = np.arange(len(t))
        a = np.repeat(pair, lengths[t]) << 32 | flat[_ranges(starts[t], lengths[t])]
        b = np.repeat(pair, self.length[k]) << 32 | self.words[_ranges(self.start[k], self.length[k])]
        (a, n), (b, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return np.bincount(both >> 32, np.minimum(n[i], m[j]), len(t)).astype(np.int64)

    def matches(self, codes: pa.Array) -> Iterator[tuple[int, int, int, int, list[tuple[int, int]]]]:
        """(text, class, class, length, matched intervals) of the records that texts are copies of, in words."""
        if not len(self.length) or not len(codes):
            return
        flat, edges = _symbols(codes)
        starts, lengths = edges[:-1], np.diff(edges)
        if (covered := self._covered(flat, starts, lengths)) is None:
            half = len(codes) // 2
            yield from self.matches(codes[:half])
            yield from ((half + i, *x) for i, *x in self.matches(codes[half:]))
            return
        t, k, which, place, at = covered
        last = np.searchsorted(which, np.arange(len(t) + 1))
        longer = np.maximum(lengths[t], self.length[k])
        most = (CHANGED * longer).astype(np.int64)
        edges = np.searchsorted(np.cumsum(longer) // MOST_MET, np.arange(2 + longer.sum() // MOST_MET))  # so many words at once
        common = [self._common(flat, starts, lengths, t[x:y], k[x:y]) for x, y in zip(edges, edges[1:])]
        near = np.concatenate(common) >= longer - most  # bounds the edits from below
        for j in np.flatnonzero(near).tolist():
            i, r = int(t[j]), int(k[j])
            a, b = self.words[self.start[r] : self.start[r] + self.length[r]], flat[starts[i] : starts[i] + lengths[i]]
            if np.array_equal(a, b) or edits(a.tolist(), b.tolist(), int(most[j])) is not None:
                own = slice(last[j], last[j + 1])
                yield i, int(self.c1[r]), int(self.c2[r]), len(a), text_spans(a, b, place[own], at[own])


class Queries:
    """Evaluation questions, (class, class, words) each; a passage knows its records by the letters that follow it."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        self.rows = rows
        self.tiny: list[int] = []
        parts, count = [], Counter()
        for k, (_, _, code) in enumerate(rows):
            w = code.split(" ")
            rest = "".join(w[min(ADDRESS, len(w) - 1) :])  # what is left whatever the address
            own = []
            if len(rest) < 3:
                self.tiny.append(k)
            else:  # a letter between two parts, so that a slip hits one of them
                n = max(2, min(PARTS, len(rest) // 8))
                cuts = [round(x * (len(rest) + 1) / n) for x in range(n + 1)]
                own = [(rest[a : b - 1], len(rest) - b + 1) for a, b in zip(cuts, cuts[1:])]
            parts.append(own)
            count.update(p for p, _ in own)
        # a record with three parts is met by two of them, each at its place, one with two by either
        number: dict[str, int] = defaultdict(lambda: len(number))
        self.index: dict[tuple[int, int], dict[tuple[int, int] | None, list[int]]] = {}
        for k, own in enumerate(parts):
            keys = [(number[passage], after) for passage, after in sorted(own, key=lambda x: count[x[0]])[: PARTS - 1]]
            for i, key in enumerate(keys):
                for other in keys[i + 1 :] if len(keys) > 2 else [None]:
                    if not (at := self.index.get(key)):
                        at = self.index[key] = {}
                    at.setdefault(other, []).append(k)
                self.index.setdefault(key, _NONE)
        self.places = [0] * len(number)  # of each part, bit a + 1 where a letters follow it
        for part, after in self.index:
            self.places[part] |= 1 << after + 1
        self.automaton = _automaton(number)

    def matches(self, code: str) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
        """(class, class, length, matched intervals) of the records that ask the same, in letters."""
        w, letters = code.split(" "), code.replace(" ", "")
        index, places, found = self.index, self.places, set()
        if self.automaton is not None:
            last = len(letters) - 1
            for end, p in self.automaton.iter(letters):
                if near := places[p] >> last - end & 7:  # a slip behind the part moves it by one
                    found.update((p, last - end - 1 + k) for k in range(3) if near >> k & 1)
        met = set(self.tiny) if len(w) <= ADDRESS + 2 else set()
        for key in found:
            own = index[key]
            if None in own:
                met.update(own[None])
            for other in own.keys() & found:
                met.update(own[other])
        for k in met:
            c1, c2, other = self.rows[k]
            if (address := same_question(own := other.split(" "), w)) is not None:
                yield c1, c2, len("".join(own)), question_spans(own, w, address)


_built: dict[str, Texts | Queries] = {}


def _shard(key: str, field: str, table: pa.Table) -> Texts | Queries:
    """The automaton of a shard, built once in each worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Texts(table) if field == "text" else Queries(list(zip(*(table.column(c).to_pylist() for c in ("c1", "c2", "code")))))
    return _built[key]


def _blocks(codes: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``BLOCK_WORDS`` words, each with the place of its first."""
    edges = _symbols(codes)[1]
    at = 0
    while at < len(codes):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK_WORDS, "right")) - 1)
        yield at, codes[at:to]
        at = to


#: An interval is one number, from * 2 ** 32 + to.
NEAR = "field string, e1 bigint, e2 bigint, t1 bigint, t2 bigint, length bigint, spans array<bigint>"


def _pass(field: str, trains: DataFrame, evals: DataFrame) -> DataFrame:
    """All distinct training records of a field through the automaton of one shard."""
    sent = trains.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, field, evals.select("c1", "c2", "code").toArrow()))  # SHARD_WORDS or QUERY_WORDS words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _shard(*sent.value)
        for b in batches:
            codes = b.column(2).cast(pa.string())
            if field == "text":
                found = [(at + i, *x) for at, block in _blocks(codes) for i, *x in shard.matches(block)]
            else:
                found = [(i, *x) for i, code in enumerate(codes.to_pylist()) for x in shard.matches(code)]
            i, e1, e2, length, spans = list(zip(*found)) or [()] * 5
            spans = pa.array([[x << 32 | y for x, y in own] for own in spans], pa.list_(pa.int64()))
            i = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(i), pa.string()), pa.array(e1, pa.int64()), pa.array(e2, pa.int64()), b.column(0).take(i), b.column(1).take(i), pa.array(length, pa.int64()), spans], [x.split()[0] for x in NEAR.split(", ")])

    found = cut_lineage(trains.select("c1", "c2", "code").mapInArrow(scan, NEAR))
    sent.unpersist()
    return found


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, near): every record's class, and the pairs of classes that overlap, with the matched intervals of the evaluation record.

    Exact copies are a pair of a class with itself and come from the automata like all others.
    """
    given = records.select("field", "side", F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("side is not null and id is not null and length(text) > 0")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = Codes(), set()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for field, side, i, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                if not (w := words(t)):
                    continue
                c1, c2 = _halves(w)
                code = None
                if (field, side, c1, c2) not in seen:  # copies in one task give their code once
                    seen.add((field, side, c1, c2))
                    code = "".join(map(codes.__getitem__, w)) if field == "text" else " ".join(w)
                rows.append((field, side, i, c1, c2, code))
            if len(seen) > _SEEN:
                seen.clear()
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["field", "side", "id", "c1", "c2", "code"])

    marked = cut_lineage(given.mapInArrow(mark, "field string, side string, id bigint, c1 bigint, c2 bigint, code string"))
    members = marked.select("field", "side", "id", "c1", "c2").distinct()
    coded = marked.where("code is not null")
    trains = coded.where("side = 'train'").select("field", "c1", "c2", "code")
    evals = cut_lineage(coded.where("side = 'eval'").groupBy("field", "c1", "c2").agg(F.min("code").alias("code")))
    n_words = F.when(F.col("field") == "text", F.length("code") / WIDTH).otherwise(F.size(F.split("code", " ")))
    held = {r["field"]: int(r["n"]) for r in evals.groupBy("field").agg(F.sum(n_words).alias("n")).collect()}
    near = records.sparkSession.createDataFrame([], NEAR)
    for field, size in (("text", SHARD_WORDS), ("query", QUERY_WORDS)):
        passes = -(-held.get(field, 0) // size)
        for s in range(passes):
            near = near.unionByName(_pass(field, trains.where(F.col("field") == field), evals.where((F.col("field") == field) & (F.pmod(F.xxhash64("c1", "c2"), F.lit(passes)) == s))))
    return members, near.dropDuplicates(["field", "e1", "e2", "t1", "t2"])


def overlaps(records: DataFrame) -> DataFrame:
    """(field_name, train_id, eval_id) of all cross-split overlaps in ``field, side, id, text``.

    ``side`` is train or eval, rows of neither side are left out; null and blank
    texts and texts without letters and digits never count. An id delivered twice
    counts once. Distinct texts are compared and expanded at the end, since the
    result has one row for each pair of records; :func:`link_counts` does not expand.
    """
    members, near = classes(records)
    e_side = members.where("side = 'eval'").select("field", F.col("id").alias("e"), F.col("c1").alias("e1"), F.col("c2").alias("e2"))
    t_side = members.where("side = 'train'").select("field", F.col("id").alias("t"), F.col("c1").alias("t1"), F.col("c2").alias("t2"))
    # the rows of a class with very many copies go to several tasks
    t_side = t_side.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int"))
    near = near.select("field", "e1", "e2", "t1", "t2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = near.join(t_side, ["field", "t1", "t2", "salt"]).join(e_side, ["field", "e1", "e2"])
    return pairs.select(F.col("field").alias("field_name"), F.col("t").alias("train_id"), F.col("e").alias("eval_id"))


def coverage(near: DataFrame) -> DataFrame:
    """(field, e1, e2, coverage): the union of each evaluation record's matched intervals as a share of its length."""
    spans = near.select("field", "e1", "e2", "length", F.explode("spans").alias("span")).distinct()
    before = Window.partitionBy("field", "e1", "e2").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    start, end = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit((1 << 32) - 1))
    new = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest(start, F.coalesce(F.max(end).over(before), F.lit(0)))))
    return new.groupBy("field", "e1", "e2").agg((F.sum("new") / F.max("length")).alias("coverage"))


def link_counts(records: DataFrame) -> DataFrame:
    """(field_name, eval_id, e1, e2, pairs, coverage): every overlapping evaluation record with its class, its training records and the share of it that they cover.

    The matched intervals of all training records are merged: coverage is the length of their union (words of a text,
    letters of a question) as a share of the record.
    """
    members, near = classes(records)
    many = members.where("side = 'train'").groupBy("field", F.col("c1").alias("t1"), F.col("c2").alias("t2")).agg(F.count("*").alias("n"))
    each = near.join(many, ["field", "t1", "t2"]).groupBy("field", "e1", "e2").agg(F.sum("n").alias("pairs"))
    each = each.join(coverage(near), ["field", "e1", "e2"])
    e_side = members.where("side = 'eval'").select("field", F.col("id").alias("eval_id"), F.col("c1").alias("e1"), F.col("c2").alias("e2"))
    return e_side.join(each, ["field", "e1", "e2"]).withColumnRenamed("field", "field_name")


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "pretrain_in").select(F.lit("text").alias("field"), side_of(F.col("split")).alias("side"), F.col("doc_id").alias("id"), "text")
    queries = read(spark, sf_dir, "rag_in").select(F.lit("query").alias("field"), side_of(F.col("split")).alias("side"), F.col("ex_id").alias("id"), F.col("query").alias("text"))
    return texts.unionByName(queries)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(corpus_records(spark, sf_dir))
    return found.select("field_name", F.least("train_id", "eval_id").alias("low_id"), F.greatest("train_id", "eval_id").alias("high_id")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation records by field, split and source, with the number of pairs and the mean coverage of a record."""
    found = link_counts(corpus_records(spark, sf_dir)).select("field_name", "eval_id", "pairs", "coverage")
    of = lambda table, key, field: read(spark, sf_dir, table).select(F.lit(field).alias("field_name"), F.col(key).alias("eval_id"), F.lower(F.trim("split")).alias("split"), "source").dropDuplicates(["eval_id"])
    records = of("pretrain_in", "doc_id", "text").unionByName(of("rag_in", "ex_id", "query"))
    return found.join(records, ["field_name", "eval_id"]).groupBy("field_name", "split", "source").agg(F.count("*").alias("records"), F.sum("pairs").alias("pairs"), F.avg("coverage").alias("coverage"))
