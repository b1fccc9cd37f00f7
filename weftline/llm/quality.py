"""Problem 4: statistics of every text, and whether it is prose, a list, a table or junk.

Method: each statistic is cut by thresholds into a few bins and so votes on the
text's type as a noisy labelling function. What a function's vote is worth is
learned by expectation-maximization from the agreement of all functions over all
texts: texts are counted by their pattern of votes on Spark, and the model is fit
on the distinct patterns (their number is bounded by the product of the bins,
whatever the corpus). The posterior of its pattern gives a text its type.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_COMMON, bounded, cut_lineage, fit_votes, fold, read

TYPES = ("prose", "list", "table", "junk")

# Ends of sentences, marks in front of list items, words of page furniture.
ENDS = ".!?…:;。！？»\"”')"
_FINAL = re.compile(r"[.!?…。！？][\"”’»')\]]*$")
_MARK = re.compile(r"\s*(?:>\s*)*(?:[-–—*•·▪◦‣+●○■□✓✔]\s+|\[[ xX✓]?\]\s*|\(?\d{1,4}[.)]\s+|\(?[a-zA-Z][.)]\s+|\(?[ivxIVX]{1,5}[.)]\s+|#\w|step \d+\b)")
_INDEX = re.compile(r"^.{1,60}?(?:,\s*\d{1,4}|\bpp?\.\s*\d+|\.{3,}\s*\d+)\s*$")
_ATTRIBUTE = re.compile(r"^\s*[\"']?[^\W\d_][\w '’/-]{0,28}[\"']?\s*[:=]\s*\S")
_TAGS = re.compile(r"<[^<>]{0,300}>")
_CELL_TAGS = re.compile(r"</?(?:t[drh]|table|thead|tbody)\b", re.I)
_GAPS = re.compile(r"\S(?: {2,}|\t)\S")
_NUMBER = re.compile(r"^[\d.,:%+-]*\d[\d.,:%+-]*$")
_HEX = re.compile(r"^(?:[0-9a-f]{2}|[0-9a-f]{6,8})$")
_GARBLED = re.compile(r"�|â‚¬|Ã|Â|[^\W\d_][|^~!;<>{}\[\]@$%*+=\\][^\W\d_]|[^\W\d_]\d[^\W\d_]|^[|^~!][^\W_]|[^\W\d_][|^~]$")
_NOT_ALNUM = re.compile(r"[\W_]+")
_JOINTS = ("; ", ", ", " / ", " | ", " • ", " · ", " - ", " – ", " * ", " + ")
_PARTS = re.compile(r"[;|\n]")
_FURNITURE_LINE = re.compile(r"^(?:[«‹]\s*.{1,30}|.{1,30}\s*[»›]|\d+ comments?|loading\W*)$", re.I)
_COUNTED = re.compile(r"^.{1,25} \(\d+\)$")
_STRIP = "\"'“”‘’«»()[]{}<>.,;:!?¡¿…—–-*_#|/\\"
FURNITURE = {
    "menu", "home", "edit", "skip to content", "cookie settings", "skip", "content", "back", "next", "previous", "print", "share", "read", "more", "log", "in", "out", "login", "logout", "sign", "up", "subscribe", "subscribed", "accept", "all", "cookies", "cookie", "page", "next page", "search", "sitemap", "comment", "comments", "loading", "contact", "privacy", "policy", "terms", "click", "here", "top", "follow", "us", "newsletter", "register", "cart", "settings",
    "weiter", "zurück", "startseite", "anmelden", "abmelden", "teilen", "drucken", "mehr", "lesen", "suche", "impressum", "datenschutz", "akzeptieren", "alle", "seite", "nächste", "kontakt",
    "accueil", "retour", "suivant", "précédent", "imprimer", "partager", "connexion", "lire", "suite", "plus", "rechercher", "accepter", "tout", "s'abonner", "abonner", "page suivante",
    "inicio", "volver", "siguiente", "anterior", "imprimir", "compartir", "leer", "más", "buscar", "aceptar", "todo", "suscribirse", "entrar", "página",
}

#: Every labelling function: its thresholds, and what is assumed of its bins for each type before EM.
FUNCTIONS: dict[str, tuple[list[float], list[list[float]]]] = {
    "common_share": ([0.08, 0.18], [[0.02, 0.08, 0.90], [0.60, 0.35, 0.05], [0.90, 0.08, 0.02], [0.80, 0.15, 0.05]]),
    "common_variety": ([0.40, 0.85], [[0.03, 0.07, 0.90], [0.70, 0.25, 0.05], [0.85, 0.12, 0.03], [0.85, 0.10, 0.05]]),
    "closed_lines": ([0.30, 0.70], [[0.10, 0.20, 0.70], [0.85, 0.10, 0.05], [0.90, 0.07, 0.03], [0.80, 0.10, 0.10]]),
    "cell_lines": ([0.20, 0.60], [[0.95, 0.04, 0.01], [0.85, 0.10, 0.05], [0.03, 0.07, 0.90], [0.90, 0.05, 0.05]]),
    "item_lines": ([0.30, 0.60], [[0.92, 0.06, 0.02], [0.02, 0.10, 0.88], [0.90, 0.07, 0.03], [0.85, 0.10, 0.05]]),
    "furniture_share": ([0.12, 0.30], [[0.98, 0.018, 0.002], [0.994, 0.005, 0.001], [0.98, 0.019, 0.001], [0.50, 0.15, 0.35]]),
    "markup_share": ([0.30, 0.70], [[0.97, 0.02, 0.01], [0.97, 0.02, 0.01], [0.85, 0.10, 0.05], [0.75, 0.05, 0.20]]),
    "repeat_share": ([0.30, 0.60], [[0.97, 0.028, 0.002], [0.957, 0.04, 0.003], [0.947, 0.05, 0.003], [0.60, 0.10, 0.30]]),
    "odd_share": ([0.15, 0.40], [[0.9857, 0.014, 0.0003], [0.96, 0.03, 0.01], [0.95, 0.04, 0.01], [0.40, 0.15, 0.45]]),
    "symbol_ratio": ([0.12, 0.30], [[0.966, 0.03, 0.004], [0.80, 0.18, 0.02], [0.50, 0.40, 0.10], [0.60, 0.10, 0.30]]),
    "mean_word": ([3.0, 14.0], [[0.01, 0.98, 0.01], [0.02, 0.93, 0.05], [0.10, 0.75, 0.15], [0.30, 0.40, 0.30]]),
}
PRIOR = (0.85, 0.05, 0.05, 0.05)
STATS = "n_words bigint, mean_word_length double, symbol_ratio double, final_line_share double, common_word_share double"


@lru_cache(200_000)
def _odd(word: str) -> bool:
    """Whether a word looks random, garbled or encoded."""
    if _GARBLED.search(word):
        return True
    if _NUMBER.match(word):
        return False
    if len(word) > 28:
        return True
    core = word.strip(_STRIP)
    if not core:
        return len(word) > 2 and len(set(word)) > 1
    if not core.isascii():
        return False
    if _HEX.match(core):
        return any(map(str.isdigit, core)) and not core.isdigit()
    if len(core) > 5:
        letters = sum(map(str.isalpha, core))
        if letters and letters < 0.6 * len(core):
            return True
        if letters > 6 and sum(map(core.lower().count, "aeiouy")) < 0.15 * letters:
            return True
    return False


def _delimiter(lines: list[str]) -> tuple[str | None, float]:
    """The sign that parts most lines into equally many cells, and the share of lines that it does."""
    best: tuple[str | None, float] = (None, 0.0)
    if len(lines) < 3:
        return best
    joined = "\n".join(lines)
    for sign in ("|", "\t", ";", ",", "  "):
        if joined.count(sign) < 0.4 * len(lines):
            continue
        counts = Counter()
        for x in lines:
            if sign == "  ":
                n = len(_GAPS.findall(x))
            else:
                n = x.strip().strip("|").count(sign)
            if n and sign in ";," and (_FINAL.search(x.strip()) or x.rstrip()[-1] == ";"):
                n = 0
            if n and sign in ";,  " and len(x.split()) > 4 * (n + 1):
                n = 0
            counts[n] += 1
        counts.pop(0, None)
        if counts:
            n, k = counts.most_common(1)[0]
            share = k / len(lines)
            if n == 1 and sign == ",":  # "Name Surname, trade" is an item
                share *= 0.5
            if share > best[1] and k >= 3:
                best = sign, share
    return best if best[1] >= 0.4 else (None, 0.0)


def measure(text: str, common: set[str]) -> tuple[list[float], list[float]]:
    """The five statistics of a text and the values that the labelling functions bin."""
    low = fold(text)
    tokens = low.split()
    n = max(1, len(tokens))
    solid = sum(map(len, tokens))
    alnum = len(_NOT_ALNUM.sub("", low))
    bare = [t.strip(_STRIP) for t in tokens]
    hits = [b for b in bare if b in common]
    known, varied = len(hits) / n, len(set(hits)) / n**0.5
    symbols = (solid - alnum) / max(1, solid)
    lines = [x for x in text.splitlines() if x.strip()]
    k = max(1, len(lines))
    final = sum(x.rstrip()[-1] in ENDS for x in lines) / k
    closed = sum(_FINAL.search(x.rstrip()) is not None for x in lines) / k
    tagged = "<" in text and _CELL_TAGS.search(text) is not None
    markup = sum(map(len, _TAGS.findall(text))) / max(1, len(text)) if "<" in text and not tagged else 0.0
    sign, cells = _delimiter(lines)
    attributes = items = furnished = counted = 0
    for line in set(lines):
        s = line.strip()
        count = s.count(" ") + 1
        if tagged and _CELL_TAGS.search(s):
            attributes += 1
        elif _FURNITURE_LINE.match(s) or s.lower().strip(_STRIP + "0123456789 ") in FURNITURE:
            furnished += 1
        elif _COUNTED.match(s) and not _MARK.match(line):
            counted += 1
        elif _MARK.match(line) or (_INDEX.match(s) and count <= 8):
            items += 1
        elif len(s) < 90 and _ATTRIBUTE.match(s) and not (count > 4 and _FINAL.search(s)):
            attributes += 1
        elif count <= 7 and not _FINAL.search(s):
            items += 1
    if furnished > 1:  # a name with a number is a link among links, else an item
        furnished += counted
    else:
        items += counted
    if k <= 2 and varied < 0.9:  # items in one line, one after the other
        joint = max(_JOINTS, key=low.count)
        parts = low.count(joint)
        attributed = sum(_ATTRIBUTE.match(x) is not None for x in _PARTS.split(text))
        if attributed >= 3:
            attributes = k
        elif parts >= 3 and parts >= n / 6 and len({x.strip() for x in low.split(joint)}) > 0.5 * parts:
            items = k
    cells = max(cells, attributes / k)
    plain = text.replace(sign, " ") if sign else text
    if tagged:
        plain = _TAGS.sub(" ", plain)
    parts = plain.replace('";"', " ").split() if sign or tagged else text.split()
    odd = sum(len(t) for t in parts if _odd(t)) / max(1, sum(map(len, parts)))
    pairs = set(zip(bare, bare[1:]))
    repeat = 1 - len(pairs) / (len(bare) - 1) if len(bare) > 4 else 0.0
    furniture = (sum(b in FURNITURE or not b and t in "«»" for b, t in zip(bare, tokens))) / n
    stats = [float(len(tokens)), solid / n, symbols, final, known]
    return stats, [known, varied, closed, cells, items / k, max(furniture, furnished / k), markup, repeat, odd, symbols if not tagged else 0.0, solid / n]


def bins(values: list[float]) -> str:
    return "".join(str(sum(v >= t for t in cuts)) for v, (cuts, _) in zip(values, FUNCTIONS.values()))


def text_statistics(df: DataFrame, common: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_words, mean_word_length, symbol_ratio, final_line_share, common_word_share, votes).

    One row for each record, deliveries again counted once; rows without an id are left
    out. Null, empty and blank texts have no votes; their counts are 0 and their shares null.
    """
    listed = {r[0] for r in bounded(common.where("word is not null").select(F.lower("word")).distinct(), MOST_COMMON)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                if x is None or not x.strip():
                    rows.append((0, None, None, None, None, None))
                else:
                    stats, values = measure(x, listed)
                    rows.append((int(stats[0]), *stats[1:], bins(values)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    schema = f"doc_id bigint, {STATS}, votes string"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).where("doc_id is not null")
    return rows.mapInArrow(run, schema).dropDuplicates(["doc_id"])


def fit(counts: list[tuple[str, int]]) -> dict[str, list[float]]:
    """The posterior of the types for every pattern of votes, by EM from the assumed tables."""
    post, _, _ = fit_votes(counts, [np.array(t) for _, t in FUNCTIONS.values()], np.array(PRIOR))
    return {p: row.tolist() for p, row in post.items()}


def text_types(df: DataFrame, common: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The statistics with ``kind`` (null for blank texts) and the posterior ``p_prose``, ``p_list``, ``p_table``, ``p_junk``."""
    stats = cut_lineage(text_statistics(df, common, doc_id, text))
    counts = [(r["votes"], r["count"]) for r in stats.where("votes is not null").groupBy("votes").count().collect()]  # at most the product of the bins
    model = fit(sorted(counts))
    spark = df.sparkSession
    rows = [(v, TYPES[int(np.argmax(p))], *p) for v, p in model.items()]
    table = spark.createDataFrame(rows, "votes string, kind string, " + ", ".join(f"p_{t} double" for t in TYPES))
    return stats.join(F.broadcast(table), "votes", "left")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_types(read(spark, sf_dir, "pretrain_in"), read(spark, sf_dir, "common_words"), "doc_id", "text")
    return found.where("kind <> 'prose'").select("doc_id", "kind")


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_types(read(spark, sf_dir, "pretrain_in"), read(spark, sf_dir, "common_words"), "doc_id", "text")
    return found.drop("votes")
