"""Surface metrics of predictions against references, per pair and as means.

ROUGE here is this engine's own definition: n-grams are distinct and made of the
parts between white space; f = 2pr / (p + r), 0 without overlap or with an empty
side. ROUGE-L takes the longest common subsequence of the whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, words


def exact(prediction: Column, reference: Column) -> Column:
    return (normalize(prediction) == normalize(reference)).cast("double")


def contained(prediction: Column, reference: Column) -> Column:
    """1.0 where the normalized reference is part of the normalized prediction; an empty one always is."""
    return F.contains(normalize(prediction), normalize(reference)).cast("double")


def token_counts(df: DataFrame, key: str, text: str, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(key, token, n): the multiset of a text's tokens."""
    return df.select(key, F.explode(tokenize(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def f1_pairs(df: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(key, overlap, n_pred, n_ref, f1, precision, recall) of each row: multiset overlap of tokens, not normalized; no shuffle."""
    return with_f1(df.select(key, tokenize(F.col(prediction)).alias("p_words"), tokenize(F.col(reference)).alias("r_words"))).drop("p_words", "r_words")


def with_f1(rows: DataFrame) -> DataFrame:
    """Overlap and scores from ``p_words`` and ``r_words``: each distinct common word counts as often as the side with fewer of it."""
    times = lambda side, x: F.size(F.filter(side, lambda y: y == x))
    overlap = F.aggregate(F.array_intersect("p_words", "r_words"), F.lit(0), lambda a, x: a + F.least(times("p_words", x), times("r_words", x)))
    return with_scores(rows.withColumns({"overlap": overlap.cast("bigint"), "n_pred": F.size("p_words").cast("bigint"), "n_ref": F.size("r_words").cast("bigint")}))


def with_scores(rows: DataFrame) -> DataFrame:
    p = F.when(F.col("overlap") > 0, F.col("overlap") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("overlap") > 0, F.col("overlap") / F.col("n_ref")).otherwise(0.0)
    rows = rows.withColumns({"precision": p, "recall": r})
    return rows.withColumn("f1", F.when(F.col("overlap") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def f1_multi(df: DataFrame, key: str, prediction: str, references: str, char_refs: bool = False) -> DataFrame:
    """(key, f1, precision, recall): the best of each over a pair's references, each on its own.

    ``references`` is array<string>; no references give zeros. With ``char_refs``,
    ``references`` is one string whose characters count as references (an empty one
    stops the job).
    """
    if char_refs:
        given = F.when(F.length(references) > 0, F.split(references, "")).otherwise(F.raise_error("an empty reference has no characters").cast("array<string>"))
        given = F.filter(given, lambda c: c != "")
    else:
        given = F.col(references)
    rows = df.select(key, F.col(prediction).alias("prediction"), F.posexplode_outer(F.array_distinct(given)).alias("ref_no", "reference"))
    scores = f1_pairs(rows.withColumn("reference", F.coalesce("reference", F.lit(""))), key)
    return scores.groupBy(key).agg(F.max("f1").alias("f1"), F.max("precision").alias("precision"), F.max("recall").alias("recall"))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams, joined by a space."""
    last = F.size(tokens) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))


def with_words(pairs: DataFrame) -> DataFrame:
    """``p_words`` and ``r_words`` as columns of their own, so that no lambda splits a text again."""
    return pairs.withColumns({"p_words": words(F.col("prediction")), "r_words": words(F.col("reference"))})


def with_rouge_n(rows: DataFrame, *sizes: int) -> DataFrame:
    """``rouge_n`` for each size, from ``p_words`` and ``r_words``."""
    rows = rows.withColumns({f"{side}_{n}": ngrams(F.col(f"{side}_words"), n) for n in sizes for side in "pr"})
    for n in sizes:
        both = F.size(F.array_intersect(f"p_{n}", f"r_{n}"))
        rows = rows.withColumn(f"both_{n}", both)
    score = lambda n: F.when(F.col(f"both_{n}") > 0, 2 * F.col(f"both_{n}") / (F.size(f"p_{n}") + F.size(f"r_{n}"))).otherwise(0.0)
    return rows.withColumns({f"rouge_{n}": score(n) for n in sizes}).drop(*(f"{x}_{n}" for n in sizes for x in ("p", "r", "both")))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table in one number's bits."""
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(p_words: Column | str, r_words: Column | str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            k = lcs_length(list(x), list(y)) if x is not None and y is not None else 0
            out.append(2 * k / (len(x) + len(y)) if k else 0.0)
        return pd.Series(out, dtype=float)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(p_words, r_words)


#: A metric of the user's: a column from prediction and reference.
Metric = Callable[[Column, Column], Column]


def pair_scores(pairs: DataFrame, key: str = "ex_id", more: dict[str, Metric] | None = None) -> DataFrame:
    """Every metric of every (prediction, reference) row, and those in ``more`` by name; one pass without a shuffle."""
    p, r = F.col("prediction"), F.col("reference")
    own = {name: metric(p, r) for name, metric in (more or {}).items()}
    rows = with_f1(with_rouge_n(with_words(pairs), 1, 2))
    return rows.select(key, exact(p, r).alias("em"), contained(p, r).alias("m"), "rouge_1", "rouge_2", rouge_l("p_words", "r_words").alias("rouge_l"), "overlap", "n_pred", "n_ref", "precision", "recall", "f1", *(c.alias(n) for n, c in own.items()))


MEANS = ("rouge_1", "rouge_2", "rouge_l", "precision", "recall", "f1", "em", "m")


def hard_metrics(pairs: DataFrame, key: str = "ex_id", more: dict[str, Metric] | None = None) -> DataFrame:
    """One row of means: ROUGE, precision, recall, f1, exact match, containment and ``more``; null for no pairs."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return pair_scores(pairs, key, more).agg(*map(mean, (*MEANS, *(more or {}))))


def matched(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, prediction, reference) of two tables that meet by key; one row for each pair of rows."""
    return predictions.select(key, "prediction").join(references.select(key, "reference"), key)


def unmatched(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(side, n): how many keys only predictions or only references have."""
    a, b = predictions.select(key).distinct(), references.select(key).distinct()
    only = lambda x, y, name: x.join(y, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return only(a, b, "prediction").unionByName(only(b, a, "reference"))
