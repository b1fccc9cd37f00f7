"""Problem 6: the whole corpus as token ids of a public byte-level BPE.

Method: a lexicon of frequent words is compiled into a minimal acyclic
transducer. Words enter in sorted order; equal suffixes share states, and every
state knows how many words end below it, so that a walk gives the word's number
and, through it, the word's ids. Workers memory-map the arrays and walk all new
words of a batch together, one byte position a step. Words outside the lexicon
are merged exactly by the tokenizer's ranks. The lexicon only decides which way a
word takes; the ids are the same for every lexicon.

The lexicon's words are counted over all texts; a word needs a fixed share of all
words, which bounds what the driver compiles and what each worker maps.
"""

from __future__ import annotations

import base64
import io
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read, write_shared

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
#: Words with at least this share of all words enter the lexicon: 1 / share words at most.
LEXICON_SHARE = 2.5e-6
CACHE_SIZE = 400_000
# The public pattern that splits text before the merges of the 50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same split for texts in which the standard library's classes agree with the pattern's.
PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\t-\r -~ ¡-©«-±´¶-¸»¿-ɏ‐-‧‰€]")


class Ranks:
    """The vocabulary as ranks, and the exact merge of one word."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.split_any = regex.compile(pattern).findall
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if UNUSUAL.search(text) else PLAIN.findall(text)

    def merge(self, word: str) -> tuple[int, ...]:
        one = self.ranks.get(word.encode("utf-8", "surrogatepass"))
        return (one,) if one is not None else tuple(self.coder.encode_ordinary(word))


def compile_lexicon(entries: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of the words, as flat arrays.

    ``keys`` holds state * 256 + byte of every arc in order, ``target`` the arc's
    end, ``skip`` the number of words before those through the arc, ``final``
    whether a word ends in a state; ``start`` and ``ids`` give the ids of the n-th word.
    """
    order = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items() if w)
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    ends: list[bool] = []
    below: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            ends.append(key[0])
            below.append(int(key[0]) + sum(below[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[False, []]]  # the open states of the last word: [final, arcs]
    last = b""
    for word, _ in order:
        common = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), common, -1):
            done = freeze(path.pop())
            path[-1][1].append((last[depth - 1], done))
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        done = freeze(path.pop())
        path[-1][1].append((last[depth - 1], done))
    root = freeze(path[0])
    keys, target, skip = [], [], []
    for state, out in enumerate(arcs):
        before = int(ends[state])
        for byte, to in out:
            keys.append(state * 256 + byte)
            target.append(to)
            skip.append(before)
            before += below[to]
    lengths = np.array([len(ids) for _, ids in order], np.int64)
    return {
        "keys": np.array(keys, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64), "final": np.array(ends, bool), "root": np.array([root], np.int64),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "ids": np.array([i for _, ids in order for i in ids], np.int32),
    }


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line with names, types, sizes and offsets, then the arrays."""
    body, head = io.BytesIO(), {}
    for name, x in arrays.items():
        body.write(b"\0" * (-body.tell() % 8))
        head[name] = [x.dtype.str, len(x), body.tell()]
        body.write(x.tobytes())
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + body.getvalue()


def unpack(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        line = f.readline()
    raw = np.memmap(path, np.uint8, "r")
    return {k: raw[len(line) + at : len(line) + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in json.loads(line).items()}


def look_up(lexicon: dict[str, np.ndarray], found: list[bytes]) -> np.ndarray:
    """The number of every word in the lexicon, -1 for others; all words walk together."""
    n, keys = len(found), lexicon["keys"]
    number = np.zeros(n, np.int64)
    lengths = np.fromiter(map(len, found), np.int64, n)
    if not n or not len(keys):
        return np.full(n, -1)
    flat = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
    offset = np.cumsum(lengths) - lengths
    state = np.full(n, int(lexicon["root"][0]))
    live = np.arange(n)
    step = 0
    while True:
        live = live[lengths[live] > step]
        if not len(live):
            break
        key = state[live] * 256 + flat[offset[live] + step]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        state[live[~hit]] = -1
        live, at = live[hit], at[hit]
        number[live] += lexicon["skip"][at]
        state[live] = lexicon["target"][at]
        step += 1
    good = (state >= 0) & (lengths > 0)
    good[good] = lexicon["final"][state[good]]
    return np.where(good, number, -1)


_ranks: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    if path not in _ranks:
        _ranks[path] = Ranks(path)
    return _ranks[path]


def chunks(text: str) -> list[str]:
    """The text cut before single spaces, so that each piece is split and merged alike wherever it stands.

    A run of white space stays in one piece: a part that is empty or ends in white
    space is joined with what follows.
    """
    parts = text.split(" ")
    if all(parts) and not any(map(str.isspace, [p[-1] for p in parts])):
        return [parts[0], *map(" ".__add__, parts[1:])]
    out, held = [], ""
    for k, part in enumerate(parts):
        held += " " + part if k else part
        if part and not part[-1].isspace():
            out.append(held)
            held = ""
    return [*out, held] if held else out


def frequent_words(df: DataFrame, text: str, vocabulary: str, share: float) -> DataFrame:
    """(word, n) of the words that make up ``share`` or more of all words: 1 / share rows at most.

    ``vocabulary`` is the name of a file that was added to the application.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = ranks_of(SparkFiles.get(vocabulary)).split, Counter()

        def give() -> pa.RecordBatch:
            total: Counter = Counter()
            for chunk, n in seen.items():
                for w in split(chunk):
                    total[w] += n
            return pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})

        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(chunks(x))
            if len(seen) > 200_000:  # the shuffle adds up what comes in parts
                yield give()
                seen.clear()
        yield give()

    parts = df.select(F.col(text).cast("string").alias("t")).where(F.length("t") > 0).mapInArrow(count, "word string, n bigint")
    counts = cut_lineage(parts.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(2.0, total * share))


def encode(df: DataFrame, doc_id: str, text: str, path: str | None = None, share: float = LEXICON_SHARE) -> DataFrame:
    """(``doc_id`` bigint, ``ids`` array<int>), one row for each row of ``df``.

    Null and empty texts give an empty list; blank texts are encoded like any
    other; strings of special tokens are ordinary text. Repeated rows stay
    repeated. Other columns are not read, whatever their names.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    spark = df.sparkSession
    ranks = ranks_of(path)
    spark.sparkContext.addFile(path)  # the vocabulary and the lexicon reach every worker through Spark
    vocabulary = os.path.basename(path)
    words = [r["word"] for r in frequent_words(df, text, vocabulary, share).collect()]  # 1 / share rows at most
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    uri = write_shared(spark, name, pack(compile_lexicon({w: ranks.merge(w) for w in words})))
    spark.sparkContext.addFile(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks_of(SparkFiles.get(vocabulary))
        lexicon = unpack(SparkFiles.get(name))
        start, table = lexicon["start"], lexicon["ids"]
        whole: dict[str, tuple[int, ...]] = {}
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            pieces = [chunks(x) if x else [] for x in batch.column(1).to_pylist()]
            if len(whole) > CACHE_SIZE or len(known) > CACHE_SIZE:
                whole.clear()
                known.clear()
            fresh = {c: own.split(c) for c in set(chain.from_iterable(pieces)) - whole.keys()}
            new = list(set(chain.from_iterable(fresh.values())) - known.keys())
            for w, k in zip(new, look_up(lexicon, [w.encode("utf-8", "surrogatepass") for w in new]).tolist()):
                known[w] = tuple(table[start[k] : start[k + 1]].tolist()) if k >= 0 else own.merge(w)
            for c, parts in fresh.items():
                whole[c] = known[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(known.__getitem__, parts)))
            each = [list(chain.from_iterable(map(whole.__getitem__, p))) for p in pieces]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            flat = np.fromiter(chain.from_iterable(each), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id bigint, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), "doc_id", "text")
