"""Problem 2: broken prompt and response pairs, each with its types of defect.

Method: several noisy labelling functions for every defect vote on each pair; an
expectation-maximization label model for every defect learns from the votes of
all pairs what each function is worth, on the distinct vote patterns that Spark
counts. A pair keeps every label whose posterior exceeds the defect's cutoff; the
cutoff has the best expected F1 on a held half of the pairs, by the model fit on
the other half; the tests check cutoffs against planted defects.

What the functions know is counted over all queries and labels: in how many
records a word occurs by the query's language, and how often a label or a sentence
ends after given words. Words and contexts count from a fixed share on, which
bounds what is broadcast. A share is taken by its lower bound and without the pair
itself, one rule for tables of every size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_COMMON, bounded, cut_lineage, fit_votes, fold, read

DEFECTS = ("empty", "refusal", "copied", "other_language", "truncated")
LANGUAGES = ("en", "de", "fr", "es")
#: A word counts if at least this share of the other records holds it, a context if this share of all others is it.
WORD_SHARE, CONTEXT_SHARE = 2e-4, 5e-6
#: Errors that the lower bound of a share lies below what is seen: chance does not make a word known in a small table.
ERRORS = 3.0
#: Imagined pairs that vote as assumed, for each defect; the others teach the functions' accuracies.
ANCHOR = 150.0

# Turns of phrase that decline to answer, in the four languages.
REFUSAL = re.compile(
    r"\b(?:can(?:not|'t| not)|could(?: not|n't)|un ?able to|not able to|won't be|not possible for me to|do(?: not|n't) let me|rather not|have to|must|nothing i can|outside of what i can)\b.{0,25}?\b(?:answer|answering|help|respond|tell|decline|give|do|say|assist|provide)\b"
    r"|\bi(?:'m| am) (?:sorry|afraid|unable|not able)|\bapologies\b|\bi (?:have to |must )?(?:decline|refuse)\b|\bi do(?: not|n't) (?:know|have)\b|\bas an (?:ai|assistant)\b"
    r"|\btut mir (?:sehr )?leid\b|\bleider (?:nicht|keine?)\b|\b(?:ablehnen|verweigern)\b|\bkeine auskunft\b|\blässt sich für mich\b|\bbitte um (?:verständnis|nachsicht)\b|\bkann ich (?:nichts|nicht|keine)\b|\bich kann .{0,40}\bnicht (?:beantworten|sagen|helfen)\b|\bnicht beantworten\b"
    r"|\bdésolée?\b|\b(?:refuser|refuse) de répondre\b|\bne (?:peux|puis) pas (?:répondre|aider|dire)\b|\bpréfère ne pas\b|\bimpossible de (?:dire|répondre)\b|\bimposible (?:decir|responder|contestar)\b|\bne suis pas en mesure\b|\bje ne (?:sais|peux) pas\b"
    r"|\blo siento\b|\bno puedo (?:responder|contestar|ayudar|decir)\b|\bnegarme\b|\bprefiero no\b|\bno estoy en condiciones\b|\bno me es posible\b|\bpor desgracia\b|\bno sé\b"
)
WEAK = re.compile(r"\b(?:sorry|cannot|can't|unable|decline|refuse|apolog\w+|leider|ablehn\w*|refus\w+|désolée?|impossible|siento|desgracia|negar\w*|assistant|asistente|assistent)\b")
FIRST_PERSON = re.compile(r"\b(?:i|i'm|me|my|ich|mich|mir|mein\w*|je|j'|m'|moi|yo|me|mi|puedo|estoy|tengo|siento|prefiero)\b|\bje\b")
# Short words of other languages that questions may be answered in.
FOREIGN = {
    "het", "een", "van", "niet", "werd", "die", "uit", "naar", "ook", "maar", "mensen", "stad", "toen", "il", "che", "di", "è", "della", "del", "nella", "non", "per", "si", "gli", "una", "sono", "città", "jest", "się", "w", "z", "i", "na", "do", "przez", "który", "nie", "było", "mieście", "o", "que", "não", "uma", "foi", "em", "da", "dos", "och", "att", "det", "som", "på", "av",
}
LEAD_IN = 28
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\n+")
_ENDED = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*\s*$")
_CUT = re.compile(r"(?:\.\.\.|…|[,;:(\[{“«„/–—-])\s*[\"'”’»]?\s*$")
_QUOTED = re.compile(r"[\"“„«][^\"”“»]{1,60}[\"”“»]")
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}

#: Labelling functions by defect: P(bin | fine), P(bin | defect) as assumed before EM.
FUNCTIONS: dict[str, list[tuple[str, list[list[float]]]]] = {
    "empty": [
        ("no_letters", [[0.9999, 0.0001], [0.0001, 0.9999]]),
        ("no_words", [[0.999, 0.001], [0.01, 0.99]]),
    ],
    "refusal": [
        ("phrase", [[0.975, 0.02, 0.005], [0.03, 0.12, 0.85]]),
        ("no_news", [[0.90, 0.10], [0.04, 0.96]]),
        ("first_person", [[0.97, 0.03], [0.15, 0.85]]),
        ("short", [[0.40, 0.60], [0.03, 0.97]]),
    ],
    "copied": [
        ("same_letters", [[0.965, 0.03, 0.005], [0.07, 0.03, 0.90]]),
        ("from_query", [[0.95, 0.04, 0.01], [0.005, 0.095, 0.90]]),
        ("of_query", [[0.90, 0.10], [0.03, 0.97]]),
    ],
    "other_language": [
        ("worst_sentence", [[0.95, 0.035, 0.015], [0.03, 0.12, 0.85]]),
        ("whole", [[0.97, 0.02, 0.01], [0.10, 0.15, 0.75]]),
        ("small_words", [[0.955, 0.043, 0.002], [0.05, 0.25, 0.70]]),
        ("strange_words", [[0.98, 0.018, 0.002], [0.50, 0.15, 0.35]]),
    ],
    "truncated": [
        ("ending", [[0.72, 0.267, 0.012, 0.001], [0.02, 0.33, 0.15, 0.50]]),
        ("open_end", [[0.999, 0.001], [0.50, 0.50]]),
        ("unbalanced", [[0.999, 0.001], [0.80, 0.20]]),
        ("part_of_word", [[0.999, 0.001], [0.65, 0.35]]),
    ],
}
#: Function 3 of ``truncated`` is measured on whole labels: those for which function 0 votes 0, that end as sentences do.
MEASURED = {"truncated": (3, 0)}
PRIOR = {"empty": 0.03, "refusal": 0.03, "copied": 0.03, "other_language": 0.03, "truncated": 0.04}


def least_share(n: Column, total: Column) -> Column:
    """The lower bound (Wilson) of the share that n - 1 of total - 1 others make up."""
    k, of, z = n - 1, F.greatest(total - 1, F.lit(1)), ERRORS
    return (k + z * z / 2 - z * F.sqrt(k * (1 - k / of) + z * z / 4)) / (of + z * z)


def letters(text: str) -> str:
    return re.sub(r"[\W_]+", "", fold(text))


def tokens(text: str) -> list[str]:
    return [t.replace("’", "'") for t in _WORD.findall(fold(text))]


def language(w: list[str], common: dict[str, dict[str, float]]) -> str | None:
    """The language whose frequent words a text has most of."""
    score: Counter = Counter()
    for x in w:
        for lang, value in common.get(x, {}).items():
            score[lang] += value
    return max(sorted(score), key=score.__getitem__) if score else None


@lru_cache(200_000)
def _token(word: str) -> str:
    return fold(word).replace("’", "'")


def _contexts(text: str, known: set[str]) -> list[str]:
    """Every word with the two before it, other words masked by their case; a sign for the start comes first."""
    m = ["^", "^"]
    for x in _WORD.findall(text):
        t = _token(x)
        m.append("#" if t.isdigit() else t if t in known else "N" if x[0].isupper() else "n")
    return [f"{a} {b} {c}" for a, b, c in zip(m, m[1:], m[2:])]


class Knowledge:
    """What is counted over all pairs, broadcast to the functions."""

    def __init__(self, common: dict[str, dict[str, float]], by_language: dict[str, dict[str, float]], ends: dict[str, tuple[float, float]]):
        self.common, self.by_language, self.ends = common, by_language, ends
        self.known = set(by_language)
        self.prefixes: dict[str, int] = {}
        for x in self.known:
            for k in range(1, len(x)):
                self.prefixes[x[:k]] = 1

    def fits(self, w: list[str], lang: str) -> tuple[float, int]:
        """The mean evidence of the words that they belong to a language, and their number."""
        total, n = 0.0, 0
        for x in w:
            v = self.by_language.get(x)
            if v is None or lang not in v:
                continue
            total += v[lang]
            n += 1
        return total / max(1, n), n

    def end_share(self, text: str) -> float:
        """How often other labels or sentences end after the last words; long contexts lean on shorter ones."""
        c = (_contexts(text, self.known) or ["^ ^ ^"])[-1].split(" ")
        share = 0.05
        for k in (2, 1, 0):
            n, e = self.ends.get(" ".join(c[k:]), (1, 1))
            share = (e - 1 + 2 * share) / (n - 1 + 2)  # without this label itself
        return share


def votes(query: str | None, label: str, know: Knowledge) -> dict[str, str]:
    """The votes of every defect's functions; a label without letters and digits gets those of ``empty`` only."""
    if not any(map(str.isalnum, label)):
        return {"empty": "11"}
    low = fold(label).replace("’", "'")
    w, q = tokens(label), tokens(query or "")
    q_set, n = set(q), len(w)
    new = [x for x in w if x not in q_set and (any(map(str.isdigit, x)) or x not in know.known)]
    phrase = 2 if REFUSAL.search(low) else 1 if WEAK.search(low) else 0
    fresh = len([x for x in new if x.isdigit() or len(x) > 2])
    refusal = f"{phrase}{int(fresh == 0)}{int(FIRST_PERSON.search(low) is not None)}{int(n <= 22)}"

    a, b = letters(label), letters(query or "")
    same = times = 0
    if b and len(b) > 8:
        times = a.count(b)
        rest = len(a) - times * len(b)
        same = 2 if times and rest <= LEAD_IN + 0.25 * LEAD_IN * (times - 1) else 1 if times else 0
        if not times and len(a) >= 0.9 * len(b) and abs(len(a) - len(b)) <= LEAD_IN and b[:-3] in a:
            same = 2
    left = sum((Counter(w) - Counter(q)).values()) - max(0, times - 1) * len(q) if b else n
    inside = 1 - left / max(1, n)
    cover = len(q_set & set(w)) / max(1, len(q_set))
    copied = f"{same}{2 if q and left <= 5 and inside >= 0.8 else 1 if q and left <= 5 and inside >= 0.6 else 0}{int(bool(q) and cover >= 0.9)}"

    other = "0000"
    lang = language(q, know.common) if q else None
    if lang is not None:
        worst = 0
        bare = _QUOTED.sub(" ", label)
        for s in _SENTENCE.split(bare):
            sw = tokens(s)
            value, k = know.fits([x for x in sw if x not in q_set or x in know.common], lang)
            if k >= 4 or k >= 2 and k >= 0.4 * len(sw) and len(sw) >= 4:
                worst = max(worst, 2 if value < 0.4 else 1 if value < 1.0 else 0)
        bw = tokens(bare)
        value, k = know.fits([x for x in bw if x not in q_set or x in know.common], lang)
        whole = (2 if value < 0.4 else 1 if value < 1.0 else 0) if k >= 3 else 0
        own = sum(lang in know.common.get(x, ()) for x in bw)
        out = sum(x in FOREIGN or x in know.common and lang not in know.common[x] for x in bw)
        small = 2 if out >= 2 and out > 1.5 * own else 1 if out > own or own == 0 and len(bw) >= 8 else 0
        # words that no pair knows; names are told by their capitals where the label has both cases
        cased = [x for x in _WORD.findall(bare) if not x[0].isdigit()]
        plain = [fold(x).replace("’", "'") for x in cased if not x[0].isupper()]
        odd = sum(x not in know.known and x not in q_set for x in plain) / max(1, len(plain))
        strange = 0 if len(plain) < 5 or len(plain) > 0.95 * len(cased) else 2 if odd >= 0.35 else 1 if odd >= 0.2 else 0
        other = f"{worst}{whole}{small}{strange}"

    s = label.rstrip()
    ended = _ENDED.search(s) is not None and not s.endswith("...")
    if ended:
        ending = 0
    else:
        share = know.end_share(_SENTENCE.split(s)[-1])
        ending = 1 if share >= 0.04 else 2 if share >= 0.012 else 3
    last = w[-1] if w else ""
    small_last = last in know.common and not ended and not last.isdigit() and ending >= 2
    opened = int(_CUT.search(s) is not None or small_last)
    unbalanced = int(any(s.count(x) > s.count(y) for x, y in _OPEN.items()) or s.count('"') % 2 == 1)
    part = 0
    if last not in know.known and not last.isdigit():
        part = int(last in know.prefixes or any(x.startswith(last) and x != last for x in q) and last not in q_set)
    return {"empty": f"0{int(not w)}", "refusal": refusal, "copied": copied, "other_language": other, "truncated": f"{ending}{opened}{unbalanced}{part}"}


def learn(pairs: DataFrame, common: dict[str, dict[str, float]]) -> Knowledge:
    """Count words by the query's language and ends by context over all pairs (query, label)."""

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                qw = tokens(q or "")
                lang = language(qw, common) or "?"
                seen.update((lang, x) for x in {*qw, *tokens(t or "")})
                seen[lang, ""] += 1
            yield pa.RecordBatch.from_pydict({"lang": [k for k, _ in seen], "word": [x for _, x in seen], "n": list(seen.values())})

    counts = cut_lineage(pairs.mapInArrow(word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.where("word = ''").collect()}  # five rows
    total = sum(totals.values())
    often = counts.where("word <> ''").groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))  # at most five languages a word
    by_language: dict[str, dict[str, float]] = {}
    for r in often.where(least_share(F.col("all"), F.lit(total)) >= WORD_SHARE).collect():  # bounded by the share
        own = {x["lang"]: x["n"] for x in r["by"]}
        value = {}
        for lang in LANGUAGES:
            part = totals.get(lang, 0) / max(1, total)
            if r["all"] * (1 - part) < 1:
                continue  # no pair with this word is to be expected in other languages: it tells nothing of this one
            # six imagined records keep a word that few pairs have near no evidence
            inside = (own.get(lang, 0) + 6 * part + 0.01) / (totals.get(lang, 0) + 6)
            outside = (r["all"] - own.get(lang, 0) + 6 * (1 - part) + 0.01) / (total - totals.get(lang, 0) + 6)
            value[lang] = float(np.clip(np.log(inside / outside), -4, 4))
        by_language[r["word"]] = value
    known = pairs.sparkSession.sparkContext.broadcast(set(by_language))

    def end_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for b in batches:
            seen, ends = Counter(), Counter()
            for t in b.column(1).to_pylist():
                for s in _SENTENCE.split(t or ""):
                    found = _contexts(s, own)
                    for k, c in enumerate(found):
                        x = c.split(" ")
                        for key in (c, f"{x[1]} {x[2]}", x[2]):
                            seen[key] += 1
                            if k == len(found) - 1:
                                ends[key] += 1
            yield pa.RecordBatch.from_pydict({"c": list(seen), "n": list(seen.values()), "e": [ends[k] for k in seen]})

    contexts = cut_lineage(pairs.mapInArrow(end_counts, "c string, n bigint, e bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("e").alias("e")))
    size = contexts.agg(F.sum("n")).first()[0] or 0
    ends = {r["c"]: (r["n"], r["e"]) for r in contexts.where(least_share(F.col("n"), F.lit(size)) >= CONTEXT_SHARE).collect()}  # bounded by the share
    return Knowledge(common, by_language, ends)


def cutoff(held: list[tuple[float, float]]) -> float:
    """The posterior above which the expected F1 over held pairs, (posterior, pairs), is best; 0.5 where none is likely."""
    best, at = 0.0, 0.5
    everything = sum(p * n for p, n in held)
    true = taken = 0.0
    for p, n in sorted(held, reverse=True):
        true, taken = true + p * n, taken + n
        f1 = 2 * true / max(1e-9, taken + everything)
        if f1 > best and p >= 0.2:
            best, at = f1, p
    return at


def defects(df: DataFrame, common_words: DataFrame, ex_id: str, query: str, label: str) -> DataFrame:
    """(ex_id, defect, posterior): every defect of every pair whose posterior reaches its cutoff.

    A null label, or one without letters and digits, can be ``empty`` only. A null or blank query leaves out what compares with it. A record
    delivered again counts once. Other columns are not read.
    """
    spark = df.sparkSession
    given = df.select(F.col(ex_id).cast("bigint").alias("ex_id"), F.col(query).cast("string").alias("q"), F.col(label).cast("string").alias("l")).where("ex_id is not null")
    given = cut_lineage(given.dropDuplicates(["ex_id"]))  # read three times
    common: dict[str, dict[str, float]] = defaultdict(dict)
    for r in bounded(common_words.where("word is not null and lang is not null").select("lang", F.lower("word").alias("word")), MOST_COMMON):
        common[r["word"]][r["lang"]] = 1.0
    for own in common.values():  # a word of several languages tells less
        for lang in own:
            own[lang] = 1.0 / len(own)
    know = spark.sparkContext.broadcast(learn(given.select("q", "l"), dict(common)))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = know.value
        for b in batches:
            rows = [votes(q, t or "", own) for q, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.get(d) for r in rows], pa.string()) for d in FUNCTIONS)], ["ex_id", *FUNCTIONS])

    voted = cut_lineage(given.mapInArrow(vote, "ex_id bigint, " + ", ".join(f"{d} string" for d in FUNCTIONS)))
    found = spark.createDataFrame([], "ex_id bigint, defect string, posterior double")
    half = F.pmod(F.xxhash64("ex_id", F.lit(2)), F.lit(2)).alias("half")
    for d, functions in FUNCTIONS.items():
        counts: list[dict[str, int]] = [{}, {}]
        for r in voted.where(F.col(d).isNotNull()).groupBy(half, d).count().collect():  # at most the product of the bins
            counts[r["half"]][r[d]] = r["count"]
        tables = [np.array(t) for _, t in functions]
        prior = np.array([1 - PRIOR[d], PRIOR[d]])
        held = None
        if d in MEASURED and counts[0]:
            j, k = MEASURED[d]
            seen = Counter()
            for p, n in counts[0].items():
                if p[k] == "0":
                    seen[int(p[j])] += n
            rate = ANCHOR * tables[j][0] + np.array([seen[x] for x in range(tables[j].shape[1])])
            held = {j: rate / rate.sum()}
        _, learned, pi = fit_votes(sorted(counts[0].items()), tables, prior, anchor=0.0, rows=ANCHOR, held=held)

        def posterior(p: str) -> float:
            value = pi * np.prod([t[:, int(c)] for t, c in zip(learned, p)], 0)
            return float(value[1] / value.sum())

        at = cutoff([(posterior(p), n) for p, n in counts[1].items()])
        rows = [(p, posterior(p)) for p in sorted({*counts[0], *counts[1]})]
        table = spark.createDataFrame([x for x in rows if x[1] >= at], f"{d} string, posterior double")
        found = found.unionByName(voted.join(F.broadcast(table), d).select("ex_id", F.lit(d).alias("defect"), "posterior"))
    return found


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(read(spark, sf_dir, "rag_in"), read(spark, sf_dir, "common_words"), "ex_id", "query", "label")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each defective pair the first type that applies."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    first = p2_labels(spark, sf_dir).groupBy("ex_id").agg(F.min_by("defect", order).alias("defect"))
    return first.select("ex_id", "defect")
