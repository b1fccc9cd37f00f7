"""Each operator against brute force and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import content, copies, leaks, pairs, pieces, quality, splits, tokens
from weftline.llm.common import cut_lineage, signless, words

SEED = random.Random(7)
NAMES = ["".join(SEED.choice("bdfgklmnprstvz") + SEED.choice("aeiou") for _ in range(4)) for _ in range(4000)]
COMMON = [("en", w, i) for i, w in enumerate("the of and a in to is was for on with as by at from that it had which were".split(), 1)] + [("fr", w, i) for i, w in enumerate("le la les de des et en un une du dans que qui est pour par".split(), 1)] + [("de", w, i) for i, w in enumerate("der die das und in von zu mit den im ist nicht".split(), 1)] + [("es", w, i) for i, w in enumerate("el los las de y en que se con del por para una".split(), 1)]


def prose(n, rng=SEED):
    frames = ["The {0} of {1} was built by {2} in the year of the {3}.", "From {0} it is {4} miles to {1}, where {2} had a mill.", "A map of {1} shows that {0} and {2} were on the coast for {4} years."]
    return " ".join(rng.choice(frames).format(*rng.sample(NAMES, 4), rng.randint(2, 900)) for _ in range(n))


# -- 1 ----------------------------------------------------------------------------------


def plain_letters(text):
    return "".join(c for c in text.lower() if c.isalnum())


def plain_fields(text):
    """Fields by hand, for the simple passages of these tests."""
    if text.strip().startswith("{"):
        import json

        found = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in json.loads(text).items()]
    else:
        found = []
        for part in text.replace(";", "\n").replace("|", "\n").split("\n"):
            if not plain_letters(part):
                continue
            at = [part.index(c) for c in ":=" if c in part]
            if not at:
                return None
            found.append((part[: min(at)], part[min(at) + 1 :]))
    found = [(plain_letters(n), plain_letters(v)) for n, v in found]
    return found if len(found) > 1 and all(n for n, _ in found) else None


def brute_copies(rows):
    groups, plain = {}, {}
    items = []
    for ex, docs in sorted(rows.items()):
        for pos, t in enumerate(docs or []):
            if t and plain_letters(t):
                items.append((ex, pos, plain_letters(t), plain_fields(t)))
    for _, _, s, f in items:
        if f is not None:
            plain.setdefault(s, frozenset(Counter(f).items()))
    for ex, pos, s, f in items:
        key = frozenset(Counter(f).items()) if f is not None else plain.get(s, s)
        groups.setdefault(key, []).append((ex, pos))
    return {(*min(g), *m) for g in groups.values() for m in g if m != min(g)}


def test_copies(spark):
    base = "Name: Alo; Place: Bree; Height: 20 m"
    rows = {
        1: [base, "Some  text, here."], 2: ["some text here", None, "", "  ", "!!"], 3: None, 4: [],
        5: ['{"Height": "20 m", "Name": "Alo", "Place": "Bree"}', "PLACE = bree | NAME = alo | HEIGHT = 20 m"], 6: ["Name: Bree; Place: Alo; Height: 20 m", base],
        7: ["name alo place bree height 20 m", "x" * 30_000, "X" * 30_000], 8: ["Note: one field only", "note one field only"],
        9: ["Name of the first owner: Anna Holt / Year: 1990\nPlace of the mill: Bree", "place of the mill = BREE | name of the first owner = anna holt / year 1990"],
        10: ["Year: ; Owner: Holt", "owner: holt\nyear:", '{"Owner": "Holt", "Year": ""}', '{"a": [1, 2], "b": "c"}', '{"b": "C", "a": [1, 2]}'],
    }
    data = [(k, v, "clash") for k, v in rows.items()] + [(1, rows[1], "again")]
    df = spark.createDataFrame(data, "ex_id bigint, docs array<string>, a1 string")
    got = [tuple(r)[:4] for r in copies.copies(df, "ex_id", "docs").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_copies(rows)


def test_copies_in_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(copies, "MEMBERS_A_TASK", 10)
    data = [(k, ["Same passage." if k % 3 == 0 else f"other {k}", "same PASSAGE"]) for k in range(200)]
    got = copies.copies(spark.createDataFrame(data, "ex_id bigint, docs array<string>"), "ex_id", "docs")
    assert {tuple(r)[:4] for r in got.collect()} == brute_copies(dict(data))
    assert got.select(F.max("copies")).first()[0] == 200 + 67
    distinct = {(r["ex_id"], r["doc_pos"]): r["copies"] for r in copies.distinct_passages(spark.createDataFrame(data, "ex_id bigint, docs array<string>"), "ex_id", "docs").collect()}
    assert distinct[0, 0] == 267 and sum(distinct.values()) == 400 and len(distinct) == 1 + 133


def test_a_hot_class_is_not_shuffled_by_its_hash(spark):
    """A third of all passages are one text: its members must not meet in one task, whatever Spark adapts at run time."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(9000).select(F.col("id").alias("ex_id"), F.array(F.when(F.col("id") % 3 == 0, "Hot one!").otherwise(F.concat(F.lit("cold "), F.col("id").cast("string")))).alias("docs"))
        marks, classes = copies.groups(df, "ex_id", "docs")
        plan = copies.members(df, "ex_id", "docs", marks, classes)
        assert plan.count() == 2999 and plan.where("not same").count() == 0
        heavy = classes.where(F.col("n") >= copies.HEAVY * marks.count())
        assert heavy.count() == 1 and heavy.first()["n"] == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_multiset_hash_counts_fields():
    assert copies.fingerprint("a: 1; a: 1; b: 2")[2:] != copies.fingerprint("a: 1; b: 2; b: 2")[2:]
    assert copies.fingerprint("a: 1; b: 2")[2:] == copies.fingerprint("B=2\nA=1")[2:]


# -- 2 ----------------------------------------------------------------------------------


def question_rows(n=400):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(n):
        a, b = rng.sample(NAMES, 2)
        a, b = a.title(), b.title()
        q = f"Who was the owner of the mill in {a} on the coast of {b}?"
        good = f"The owner of the mill in {a} was {rng.choice(NAMES).title()} {rng.choice(NAMES).title()}, who had a house in {b} at the time."
        if k % 2 == 0:
            q = f"Qui est le patron du moulin de {a} dans la ville de {b} ?"
            good = f"Le patron du moulin de {a} est {rng.choice(NAMES).title()} {rng.choice(NAMES).title()}, qui est dans une des rues de {b} pour le moment."
        label = good
        if k % 20 == 1:
            label, want[k] = rng.choice([None, "", " - "]), "empty"
        elif k % 20 == 2:
            label, want[k] = "Je suis désolé, mais je ne peux pas répondre.", "refusal"
        elif k % 20 == 3:
            label, want[k] = rng.choice([q, f"{q} {q}", f"You asked: {q.lower()}"]), "copied"
        elif k % 20 == 4:
            label, want[k] = f"The owner of the mill in {a} was a man who had a house on the coast of {b} at the time.", "other_language"
        elif k % 20 == 5:
            part = good.split(" ")
            label, want[k] = " ".join(part[: rng.randint(5, len(part) - 2)]) + rng.choice(["", ",", " (a"]), "truncated"
        rows.append((k, q, label, "extra"))
    return rows, want


def test_defects(spark):
    rows, want = question_rows()
    df = spark.createDataFrame([*rows, rows[7]], "ex_id bigint, query string, label string, defect string")
    common = spark.createDataFrame(COMMON, "lang string, word string, rank_no int")
    found = {}
    for r in pairs.defects(df, common, "ex_id", "query", "label").collect():
        found.setdefault(r["ex_id"], set()).add(r["defect"])
    for kind in pairs.DEFECTS:
        own = {k for k, v in want.items() if v == kind}
        hit = {k for k in own if kind in found.get(k, ())}
        assert len(hit) >= 0.9 * len(own), kind
    assert len(set(found) - set(want)) <= 4


def test_defects_of_odd_rows(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string, rank_no int")
    schema = "ex_id bigint, query string, label string"
    assert pairs.defects(spark.createDataFrame([], schema), common, "ex_id", "query", "label").count() == 0
    rows = [(1, None, "Some answer."), (2, "", None), (3, "Q?", "x" * 20_000), (4, None, None), (5, "???", "a b c " * 3000), (None, "q", "a")]
    got = {(r[0], r[1]) for r in pairs.defects(spark.createDataFrame(rows, schema), common, "ex_id", "query", "label").select("ex_id", "defect").collect()}
    assert {(2, "empty"), (4, "empty")} <= got


def test_label_model_learns_from_agreement():
    from weftline.llm.common import fit_votes

    rng = random.Random(1)
    tables = [[[0.8, 0.2], [0.2, 0.8]]] * 3
    import numpy as np

    truth, patterns = [], []
    for _ in range(4000):
        y = rng.random() < 0.3
        votes = [int(y) if rng.random() < acc else 1 - int(y) for acc in (0.95, 0.9, 0.6)]
        truth.append(y)
        patterns.append("".join(map(str, votes)))
    post, learned, _ = fit_votes(sorted(Counter(patterns).items()), [np.array(t) for t in tables], np.array([0.7, 0.3]), anchor=0.0, rows=pairs.ANCHOR)
    right = sum((post[p][1] > 0.5) == y for p, y in zip(patterns, truth))
    assert right > 0.93 * len(truth) and learned[0][1, 1] > learned[2][1, 1]


def test_a_useless_function_is_found_out():
    """With the settings of the queries, a function that votes at random ends with an accuracy of one half."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, defect = 100_000, "refusal"
    tables = [np.array(t) for _, t in pairs.FUNCTIONS[defect]]
    names = [x for x, _ in pairs.FUNCTIONS[defect]]
    truth = (rng.random(n) < 0.03).astype(int)
    votes = [np.array([rng.choice(t.shape[1], p=t[y] / t[y].sum()) for y in (0, 1)]) for t in tables]
    votes = [np.where(truth == 1, rng.choice(t.shape[1], n, p=t[1] / t[1].sum()), rng.choice(t.shape[1], n, p=t[0] / t[0].sum())) for t in tables]
    votes[names.index("first_person")] = rng.integers(0, 2, n)
    counts = Counter(map("".join, zip(*(v.astype(str) for v in votes))))
    from weftline.llm.common import fit_votes

    _, learned, pi = fit_votes(sorted(counts.items()), tables, np.array([1 - pairs.PRIOR[defect], pairs.PRIOR[defect]]), anchor=0.0, rows=pairs.ANCHOR)
    useless = learned[names.index("first_person")]
    assert np.abs(useless - 0.5).max() <= 0.05 and abs(pi[1] - 0.03) < 0.01


def test_cutoffs_hold_on_planted_defects(spark):
    """On pairs with known truth the cutoff chosen is near the best one of all."""
    rows, want = question_rows(1200)
    common = spark.createDataFrame(COMMON, "lang string, word string, rank_no int")
    df = spark.createDataFrame(rows, "ex_id bigint, query string, label string, extra string")
    found = pairs.defects(df, common, "ex_id", "query", "label").collect()
    for kind in pairs.DEFECTS:
        held = {k for k, v in want.items() if v == kind and k % 2}  # those of either half do
        own = {r["ex_id"] for r in found if r["defect"] == kind}
        right = len([k for k in own if want.get(k) == kind])
        assert right >= 0.9 * len(own) and len(held & own) >= 0.9 * len(held), kind


def test_a_pair_keeps_two_labels(spark):
    rows, _ = question_rows(800)
    a, b = NAMES[1].title(), NAMES[2].title()
    rows.append((5000, f"Qui est le patron du moulin de {a} dans la ville de {b} ?", f"The owner of the mill in {a} was a man who had a house on the coast of the (", "x"))
    rows.append((5001, f"Who was the owner of the mill in {a} on the coast of {b}?", f"Le patron du moulin de {a} est dans une des rues de la (", "x"))
    common = spark.createDataFrame(COMMON, "lang string, word string, rank_no int")
    got = pairs.defects(spark.createDataFrame(rows, "ex_id bigint, query string, label string, extra string"), common, "ex_id", "query", "label")
    for k in (5000, 5001):
        assert {r["defect"] for r in got.where(F.col("ex_id") == k).collect()} == {"other_language", "truncated"}


def test_a_long_list_of_words_is_an_error(spark):
    from weftline.llm.common import bounded

    assert len(bounded(spark.range(5), 5)) == 5
    with pytest.raises(ValueError, match="more than 5"):
        bounded(spark.range(6), 5)


# -- 3 ----------------------------------------------------------------------------------


def edited(text, rng, share):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), int(share * len(w))):
        w[k] = rng.choice(NAMES)
    return " ".join(w)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for k in range(160):
        t = prose(6, rng)
        rows.append(("text", "train", k, t))
        if k % 4 == 0:
            rows.append(("text", "eval", 1000 + k, rng.choice([t.upper(), t.replace(" ", "\n"), edited(t, rng, 0.08), "- " + t])))
        if k % 4 == 1:
            rows.append(("text", "eval", 1000 + k, edited(t, rng, 0.5)))
    rows += [("text", "train", 300, None), ("text", "eval", 301, ""), ("text", "eval", 302, " "), ("text", None, 303, rows[0][3]), ("text", "train", 304, "!!!"), ("text", "eval", 305, "!!!"), rows[0], ("text", "eval", 306, "word " * 20_000)]
    rows += [("query", "train", 1, "Who owned the mill in Talo near Bise?"), ("query", "eval", 2, "Hi, who owned teh mill in talo near bise"), ("query", "eval", 3, "Who owned the mill in Talo near Bisu?!x"), ("query", "train", 4, "When did it open in 1982?"), ("query", "eval", 5, "When did it open in 1985?")]
    df = spark.createDataFrame(rows, "field string, side string, id bigint, text string")
    got = {tuple(r) for r in splits.overlaps(df).collect()}
    want = set()
    for f, same in (("text", near_text), ("query", near_question)):
        want |= {(f, i, j) for i, a in plain_words(rows, f, "train") for j, b in plain_words(rows, f, "eval") if same(b, a)}
    assert got == want and len(want) > 40


def plain_words(rows, field, side):
    own = {(r[2], r[3]) for r in rows if r[0] == field and r[1] == side and r[3]}
    split = [(i, "".join(c if c.isalnum() else "" if not c.isspace() else " " for c in t.lower()).split()) for i, t in own]
    return [(i, w) for i, w in split if w]


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def near_text(a, b):
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 0.14 * longest and distance(a, b) <= 0.14 * longest


def near_question(a, b):
    """One slip (swapped letters are one) in the letters behind at most three words of either; digits agree."""
    for x in ("".join(a[i:]) for i in range(min(4, len(a)))):
        for y in ("".join(b[j:]) for j in range(min(4, len(b)))):
            if [c for c in x if c.isdigit()] == [c for c in y if c.isdigit()]:
                swapped = [y[:k] + y[k + 1] + y[k] + y[k + 2 :] for k in range(len(y) - 1)]
                if abs(len(x) - len(y)) <= 1 and (distance(x, y) <= 1 or x in swapped):
                    return True
    return False


def test_overlaps_lose_no_link_to_edits(spark):
    """Every allowed number of changes, texts of common words only, questions with few telling words and a slip."""
    rng = random.Random(12)
    rows, pool = [], ["the", "of", "a", "in", "to", "and", "was", "is", "mill", "year"]
    for k in range(90):
        n = rng.randint(3, 60)
        w = [rng.choice(pool if k % 3 else NAMES) for _ in range(n)]
        rows.append(("text", "train", k, " ".join(w)))
        for e in range(2):
            v = list(w)
            for _ in range(rng.randint(0, n // 6)):
                at = rng.randrange(len(v))
                move = rng.randint(0, 2)
                v[at : at + 1] = [[rng.choice(NAMES)], [], [v[at], rng.choice(NAMES)]][move] if len(v) > 2 or move != 1 else [v[at]]
            rows.append(("text", "eval", 1000 + 2 * k + e, " ".join(v)))
    for k in range(60):
        q = f"What is the capital of {rng.choice(NAMES[:40])} in {rng.choice(NAMES[:8])}" if k % 2 else f"Who won in {rng.randint(1900, 1920)}"
        rows.append(("query", "train", 5000 + k, q))
        at = rng.randrange(3, len(q) - 2)
        slip = rng.choice([q[:at] + q[at + 1] + q[at] + q[at + 2 :], q[:at] + q[at + 1 :], q[:at] + "x" + q[at:], q])
        rows.append(("query", "eval", 6000 + k, rng.choice(["", "Please tell me ", "Hi, ", "Well so ok "]) + slip + rng.choice(["?", " ?", ""])))
    got = {tuple(r) for r in splits.overlaps(spark.createDataFrame(rows, "field string, side string, id bigint, text string")).collect()}
    want = set()
    for f, same in (("text", near_text), ("query", near_question)):
        want |= {(f, i, j) for i, a in plain_words(rows, f, "train") for j, b in plain_words(rows, f, "eval") if same(b, a)}
    assert got == want and len(want) > 100


def test_overlaps_of_a_hot_text(spark):
    """10^5 copies of one text in training: one class, counted without pairs."""
    hot = spark.range(100_000).select(F.lit("text").alias("field"), F.lit("train").alias("side"), "id", F.lit("one hot text that very many records of training have").alias("text"))
    rest = spark.createDataFrame([("text", "eval", -1, "One hot text, that very many records of training have!"), ("text", "eval", -2, "One hot text that very few records of training have"), ("text", "eval", -3, "another one")], hot.schema)
    got = {r["eval_id"]: (r["pairs"], r["coverage"]) for r in splits.link_counts(hot.unionByName(rest)).collect()}
    assert got.keys() == {-1, -2} and got[-1][0] == got[-2][0] == 100_000 and got[-1][1] > got[-2][1] > 0
    assert splits.overlaps(hot.unionByName(rest)).count() == 200_000


def test_overlaps_in_several_shards(spark, monkeypatch):
    rng = random.Random(3)
    texts = [prose(4, rng) for _ in range(60)]
    rows = [("text", "train", k, t) for k, t in enumerate(texts)] + [("text", "eval", 100 + k, edited(t, rng, 0.05)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "field string, side string, id bigint, text string")
    whole = {tuple(r) for r in splits.overlaps(df).collect()}
    monkeypatch.setattr(splits, "SHARD_WORDS", 900)
    assert {tuple(r) for r in splits.overlaps(df).collect()} == whole and len(whole) >= 60


def test_word_automaton_finds_every_passage():
    import numpy as np

    rng = random.Random(8)
    texts = [[rng.randrange(4) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    passages = sorted({tuple(rng.randrange(4) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    flat, size = np.array([w for p in passages for w in p], np.uint32), np.array([len(p) for p in passages])
    automaton = splits.WordAutomaton(flat, np.cumsum(size) - size, size)
    of = dict(zip(automaton.final.tolist(), passages))
    words, starts = np.array([w for t in texts for w in t], np.uint32), np.cumsum([0, *map(len, texts)])
    begins = np.zeros(len(words), bool)
    begins[starts[:-1]] = True
    got = {(a, of[s]) for at, states in automaton.scan(words, begins) for a, s in zip(at.tolist(), states.tolist()) if s in of}
    assert got == {(int(starts[k]) + i, p) for k, t in enumerate(texts) for p in passages for i in range(len(t)) if tuple(t[i : i + len(p)]) == p}


def test_few_records_are_met_in_vain(monkeypatch):
    """Questions and texts of one form: the work for a record does not grow with all others of the form."""
    import pyarrow as pa

    names = NAMES[:600]
    form = lambda n: (f"which year was the old mill near the town of {n} built and by which of the four owners of it").split()
    queries = splits.Queries([(k, k, " ".join(form(n + n[::-1]))) for k, n in enumerate(names)])
    assert all([x[:2] for x in queries.matches(" ".join(form(n + n[::-1])))] == [(k, k)] for k, n in enumerate(names[:50]))
    codes = splits.Codes()
    text = lambda n, k: "".join(codes[w] for w in [*form(n), *NAMES[k : k + 40]])
    table = pa.table({"c1": range(600), "c2": range(600), "code": [text(n, k) for k, n in enumerate(names)]})
    given = pa.array([text(n, k) for k, n in enumerate(names)])
    monkeypatch.setattr(splits, "MOST_MET", 500)
    found = {x[:3] for x in splits.Texts(table).matches(given)}
    assert {(k, k, k) for k in range(600)} <= found and len(found) < 600 * 10


def test_matched_intervals_are_merged(spark):
    """Coverage is the union of what all training records match, not the best of them or a count of passages."""
    w = NAMES[:30]
    half = [w[:14] + ["x", "y", "z"] + w[17:], w[:4] + ["x"] + w[5:27] + ["y"] + w[28:]]
    rows = [("text", "eval", 1, " ".join(w)), ("text", "eval", 2, " ".join(NAMES[100:107])), ("text", "train", 3, " ".join(NAMES[100:107]))]
    rows += [("text", "train", 10 + k, " ".join(x)) for k, x in enumerate(half)]
    rows += [("query", "eval", 20, "Who owned the mill in Talo near Bise?"), ("query", "train", 21, "Please who owned the mxll in Talo near Bise")]
    schema = "field string, side string, id bigint, text string"
    got = {r["eval_id"]: (r["pairs"], r["coverage"]) for r in splits.link_counts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 20: (1, pytest.approx(28 / 29))}
    alone = splits.link_counts(spark.createDataFrame([r for r in rows if r[2] in (1, 10)], schema)).first()
    assert alone["coverage"] == pytest.approx(27 / 30)
    assert splits.merged([(4, 6), (0, 2), (2, 3), (5, 9)]) == [(0, 3), (4, 9)]


def test_overlaps_of_empty_tables(spark):
    schema = "field string, side string, id bigint, text string"
    assert splits.overlaps(spark.createDataFrame([], schema)).count() == 0
    assert splits.overlaps(spark.createDataFrame([("text", "eval", 1, "a b c")], schema)).count() == 0


def test_overlap_rows_of_copies(spark):
    rows = [("text", "train", k, "one text that is the same in all of these rows") for k in range(30)] + [("text", "eval", 100 + k, "One text that is the same - in all of these rows!") for k in range(5)]
    assert splits.overlaps(spark.createDataFrame(rows, "field string, side string, id bigint, text string")).count() == 150


def test_edits_is_levenshtein():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        want = prev[-1]
        assert splits.edits(a, b, 20) == want
        assert splits.edits(a, b, want - 1) is None if want else True


# -- 4 ----------------------------------------------------------------------------------


def test_text_types(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(300):
        t = prose(5, rng)
        if k % 10 == 1:
            t, want[k] = "\n".join(f"- {rng.choice(NAMES)} {rng.choice(NAMES)}" for _ in range(9)), "list"
        elif k % 10 == 2:
            t, want[k] = "\n".join("| " + " | ".join(str(rng.randint(1, 999)) for _ in range(4)) + " |" for _ in range(8)), "table"
        elif k % 10 == 3:
            t, want[k] = rng.choice(["".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(300)), "buy now " * 40, "".join(rng.choice("#<>[]{}*^~") for _ in range(200))]), "junk"
        elif k % 10 == 4:
            t = t.upper()
        elif k % 10 == 5:
            t = t.replace(" ", "\n", 30)
        rows.append((k, t, 1))
    rows += [(900, None, 1), (901, "", 1), (902, " \n ", 1), (903, prose(900, rng), 1), rows[1], (None, "- one\n- two\n- three", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, votes int")
    common = spark.createDataFrame(COMMON, "lang string, word string, rank_no int")
    got = {r["doc_id"]: r for r in quality.text_types(df, common, "doc_id", "text").collect()}
    assert len(got) == 304 and got[900]["kind"] is None and got[901]["n_words"] == 0 and got[902]["kind"] is None
    assert {k: r["kind"] for k, r in got.items() if r["kind"] not in (None, "prose")} == want
    assert got[0]["n_words"] == len(rows[0][1].split())
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.text_types(empty, common.limit(0), "doc_id", "text").count() == 0


# -- 5 ----------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["Short.", "", "word " * 700, "x" * 5000, "A sentence here. " * 200, ("para\n\n" * 300), "é" * 3000, "漢字。" * 900, "́" * 4000, " " * 3000, "a b‍c " * 800])
def test_cut_covers(text):
    out = pieces.cut(text)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for (s, e, _), (s2, e2, _) in zip(out, out[1:]):
        assert s < s2 <= e < e2 and e - s2 <= pieces.OVERLAP
    assert all(e - s <= pieces.LIMIT for s, e, _ in out)


def test_cut_is_cheapest():
    """Against all admissible cut sequences of a small text."""
    text = "Aa bb. Cc dd ee. Ff. Gg hh ii jj. Kk. Ll mm. Nn oo pp. Qq rr."
    found = {m.end(): "sentence" for m in re.finditer(r"\. ", text)}
    at = sorted(found)
    limit, overlap = 24, 4
    chain = pieces._chain(text, at, ["sentence"] * len(at), limit, overlap)

    def cost(parts):
        n = max(1, -(-(len(text) - overlap) // (limit - overlap)))
        even = (len(text) + (n - 1) * overlap) / n
        return sum(((e - s - even) / even) ** 2 for s, e in parts) + 0.4 * (len(parts) - 1)

    def back(e):
        m = pieces._START.search(text, max(0, e - overlap), e)
        return m.start() + 1 if m else max(0, e - overlap)

    best = []

    def go(start, last, parts):
        if len(text) - start <= limit:
            best.append(cost([*parts, (start, len(text))]))
        for e in at:
            if e > last and (not parts or e - last > overlap) and e - start <= limit:
                go(back(e), e, [*parts, (start, e)])

    go(0, 0, [])
    assert abs(cost([(s, e) for s, e, _ in chain]) - min(best)) < 1e-9


def test_word_ends_are_opened_only_where_they_are_needed():
    sentences, run = "Aa bb cc. " * 300, "word " * 900
    out = pieces.cut(sentences + run + sentences)
    words = [e for _, e, kind in out if kind == "word"]
    assert words and all(len(sentences) < e < len(sentences + run) for e in words)
    assert {kind for _, e, kind in out if e <= len(sentences)} == {"sentence"}


def test_cut_of_a_run_is_even():
    """Without any boundary every position is a candidate, so that the pieces are as even as they can be."""
    for n in (1300, 2500, 4001):
        sizes = [e - s for s, e, _ in pieces.cut("x" * n)]
        assert max(sizes) - min(sizes) <= 1


def test_items_without_an_id_give_no_piece(spark):
    rows = [("text", None, 0, "a sentence here. " * 200), ("text", None, 0, "another one there. " * 150), ("text", 1, 0, "a sentence here. " * 200)]
    got = pieces.split_items(spark.createDataFrame(rows, "f string, i bigint, p int, t string"), "f", "i", "p", "t").collect()
    assert {r["item_id"] for r in got} == {1} and len({r["piece_no"] for r in got}) == len(got) > 1


def test_split_items(spark):
    rows = [("docs", 1, 0, "word " * 600, 5), ("docs", 1, 1, None, 5), ("docs", 2, 0, "", 5), ("text", 3, 0, "y" * 1201, 5), ("text", 3, 0, "y" * 1201, 6), ("text", 4, 0, "z" * 1200, 5)]
    df = spark.createDataFrame(rows, "f string, i bigint, p int, t string, piece int")
    got = pieces.split_items(df, "f", "i", "p", "t").collect()
    assert {(r["field_name"], r["item_id"], r["item_pos"]) for r in got} == {("docs", 1, 0), ("text", 3, 0)}
    assert all(len(r["piece"]) == r["piece_end"] - r["piece_start"] <= 1200 for r in got)
    assert len({(r["item_id"], r["piece_no"]) for r in got}) == len(got)
    assert pieces.split_items(df.limit(0), "f", "i", "p", "t").count() == 0


# -- 6 ----------------------------------------------------------------------------------


def test_encode_round_trip(spark):
    import tiktoken

    own = tokens.Ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    texts = [None, "", " ", "\n\n", "hello  world", "It's  the end.\n  Next line\t\ttab ", "été 漢字 🙂‍👩 ﷺ é", "a" * 5000, "x_y __ 12³½ ¹", "  lead", "trail  ", "<|endoftext|>", "\x00\x1c ‍", "don't we'll I'M", prose(30), prose(30)]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "doc_id", "text", share=1e-3).collect()}
    coder: tiktoken.Encoding = own.coder
    for k, t in enumerate(texts):
        assert got[k] == coder.encode_ordinary(t or ""), repr(t)
        assert coder.decode(got[k]) == (t or "")
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_transducer():
    rng = random.Random(4)
    vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): tuple(rng.randint(0, 9) for _ in range(rng.randint(1, 3))) for _ in range(600)}
    lexicon = tokens.compile_lexicon(vocabulary)
    asked = [*vocabulary, "", "zz", "abcabcabcabc", *("".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(300))]
    for w, k in zip(asked, tokens.look_up(lexicon, [w.encode() for w in asked]).tolist()):
        ids = tuple(lexicon["ids"][lexicon["start"][k] : lexicon["start"][k + 1]].tolist()) if k >= 0 else None
        assert ids == vocabulary.get(w)
    # minimal: no two states accept the same rest
    states = {}
    for key, to in zip(lexicon["keys"].tolist(), lexicon["target"].tolist()):
        states.setdefault(key // 256, []).append((key % 256, to))
    seen = {(bool(lexicon["final"][s]), tuple(states.get(s, ()))) for s in range(len(lexicon["final"]))}
    assert len(seen) == len(lexicon["final"])


def test_chunks_split_alike():
    own = tokens.Ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "1", "é", ".", "_", " ", "\xa0", "'"]) for _ in range(rng.randint(0, 12)))
        assert [w for c in tokens.chunks(t) for w in own.split(c)] == own.split_any(t), repr(t)


# -- 7 ----------------------------------------------------------------------------------


def test_contained(spark):
    rng = random.Random(21)
    items = [(k, prose(8, rng)) for k in range(12)] + [(50, None), (51, ""), (52, "too short an item"), (53, "Word " * 40)]
    docs, want = [], set()
    for k in range(60):
        body = prose(5, rng)
        item = k % 12
        w = words(items[item][1])
        if k % 5 == 0:
            at = rng.randint(0, len(w) - 40)
            part = w[at : at + 40]
            if k % 10 == 0:
                part[20] = "changed"
            body += "\n" + "  ".join(part).upper() + "\n" + prose(3, rng)
            want.add((item, 100 + k))
        elif k % 5 == 1:
            body += " " + " ".join(w[5:19]) + " " + prose(2, rng)
        elif k % 5 == 2:
            body += " " + " ".join(w[0:18]) + " " + prose(2, rng) + " " + " ".join(w[30:48])
            want.add((item, 100 + k))
        docs.append((100 + k, body, "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, prose(800, rng), "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    got = [(r["item_id"], r["doc_id"]) for r in leaks.contained(d, i, "doc_id", "text", "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leaks.contained(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.contained(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_the_join_by_shuffle_gives_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(6, rng)) for k in range(9)]
    docs = [(100 + k, prose(2, rng) + " " + items[k % 9][1]) for k in range(30)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    run = lambda: {tuple(r) for r in leaks.contained(d, i, "doc_id", "text", "item_id", "text").collect()}
    whole = run()
    monkeypatch.setattr(leaks, "ITEM_WORDS", 0)
    assert run() == whole and len(whole) == 30
    monkeypatch.setattr(leaks, "FILTER_BITS", 15)  # full of shingles: lets all pass, loses none
    assert run() == whole


def test_phrases_of_many_items_keep_no_document(spark, monkeypatch):
    rng = random.Random(14)
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    common = [words(8) for _ in range(6)]
    items = [(k, " ".join(words(20) + common[k] + words(20))) for k in range(6)]
    mixed = " ".join(" ".join(words(5) + c) for c in common)  # 24 shingles, but 4 of each item
    d = spark.createDataFrame([(10, mixed), (11, mixed + " " + items[3][1]), (12, " ".join(words(60)))], "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    kept = []
    monkeypatch.setattr(leaks, "cut_lineage", lambda rows: kept.append(cut_lineage(rows)) or kept[-1])
    run = lambda: sorted(tuple(r) for r in leaks.contained(d, i, "doc_id", "text", "item_id", "text").collect())
    assert run() == [(3, 11, 48)] and [r["d"] for r in kept[1].select("d").collect()] == [11]
    monkeypatch.setattr(leaks, "ITEM_WORDS", 0)
    assert run() == [(3, 11, 48)]


def test_shared_places_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 40, 900):
        h, item = rng.integers(1, 60, n).astype(np.uint64), np.sort(rng.integers(0, 9, n))
        order = np.argsort(h, kind="stable")
        doc, own = np.sort(rng.integers(0, 30, 3 * n)), rng.integers(1, 90, 3 * n).astype(np.uint64)
        shares = lambda d, i: sum(x in set(own[doc == d].tolist()) for x in h[item == i].tolist()) >= leaks.MIN_SHARED
        got = leaks.sharing(doc, own, h[order], order, item).tolist()
        assert got == [d for d in range(30) if any(shares(d, i) for i in range(9))] and (n < 900 or 0 < len(got))


def test_word_numbers_of_blocks(monkeypatch):
    texts = ["", " A b, c_d!\x1ce ", "x", "Élan\u2003it's &amp; <b>b</b> \xad", "  \n", "a-b\x00c_ \x7f"] * 3
    for chars in (1, 30, 1_000_000):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", chars)
        ids, starts = leaks._numbers(texts, leaks.Numbers())
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [[*map(leaks.Numbers().__getitem__, leaks.words(t)), -1] for t in texts]
    assert leaks._numbers([], leaks.Numbers())[1].tolist() == [0]
    assert all(signless(chr(k) + "a") == re.sub(r"[^\w\s]+|_+", "", (chr(k) + "a").lower()) for k in range(128))


def test_changed_words_at_every_place(spark):
    """Passages of 25 to 31 words with changed words everywhere but side by side and at the ends, against the rule itself."""
    rng = random.Random(77)
    item = words(prose(20, random.Random(78)))[:120]
    docs, want = [], set()
    for k in range(240):
        n = rng.randint(25, 31)
        at = rng.randint(0, len(item) - n)
        part = list(item[at : at + n])
        bad = rng.sample(range(1, n - 1), rng.randint(0, 3))
        for x in bad:
            part[x] = f"changed{x}"
        docs.append((1000 + k, "Before it comes this. " + " ".join(part) + " And this comes after."))
        if len(bad) <= 0.1 * n and all(abs(x - y) > 1 for x in bad for y in bad if x != y):
            want.add(1000 + k)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"] for r in leaks.contained(d, i, "doc_id", "text", "item_id", "text").collect()}
    assert want <= got and len(want) > 60


def test_passages_in_any_order(spark):
    """Two passages of one item count together, the later one first too; a passage given twice counts once."""
    w = words(prose(12, random.Random(41)))[:90]
    one, two = " ".join(w[5:25]), " ".join(w[50:72])
    filler = "And something else stands between these two here."
    docs = [(1, f"{one} {filler} {two}"), (2, f"{two} {filler} {one}"), (3, f"{one} {filler} {one}"), (4, f"{two} {filler} {' '.join(w[5:18])}")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(w))], "item_id bigint, text string")
    assert {tuple(r) for r in leaks.contained(d, i, "doc_id", "text", "item_id", "text").collect()} == {(9, 1, 42), (9, 2, 42)}
    twice = list(range(15)) * 2
    assert leaks.overlap(twice, list(range(15)), [(0, 0), (15, 0)]) == 15 and leaks.overlap(twice, twice, [(0, 0), (0, 15), (15, 0), (15, 15)]) == 30


def test_tags_change_no_word(spark):
    w = words(prose(8, random.Random(31)))[:45]
    part = list(w)
    part[11], part[24], part[37] = "345", "741", "862"
    text = "Before it. " + " ".join(part[:13]) + ".<br/>\n" + " ".join(part[13:30]) + '.<br class="x">\n<b>' + " ".join(part[30:]) + "</b>.<br/>\nAnd after."
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    i = spark.createDataFrame([(2, " ".join(w))], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.contained(d, i, "doc_id", "text", "item_id", "text").collect()] == [(2, 1, 45)]
    assert leaks.words("a <b and c> if x<3 &amp; y>2, AT&T") == ["a", "b", "and", "c", "if", "x3", "y2", "att"]


def test_passages_against_brute_force():
    """Changed words alone: on every diagonal, stretches that begin and end intact, no two changed in a row."""
    rng = random.Random(17)
    for _ in range(300):
        a = list(range(rng.randint(15, 60)))
        b = [x if rng.random() > rng.choice([0.05, 0.12, 0.3]) else -2 for x in a]
        best = [0] * (len(a) + 1)
        for q in range(len(a)):
            best[q + 1] = best[q]
            for p in range(q - 13):
                bad = [k for k in range(p, q + 1) if b[k] < 0]
                if b[p] >= 0 and b[q] >= 0 and 10 * len(bad) <= q + 1 - p and all(y - x > 1 for x, y in zip(bad, bad[1:])):
                    best[q + 1] = max(best[q + 1], best[p] + q + 1 - p)
        assert leaks.overlap(a, b, [(k, k) for k in range(len(a)) if b[k] >= 0]) == best[-1]


def test_tokens_of_every_allowed_change():
    """However rare the shingles are, 25 words with two changed ones hold MIN_HITS tokens and MIN_SHARED shingles."""
    rng = random.Random(5)
    n = 25 - leaks.SHINGLE + 1
    for _ in range(300):
        rank = [(rng.randint(0, 5), rng.random()) for _ in range(n)]
        chosen = {a if rank[a] <= rank[a + 1] else a + 1 for a in range(n - 1)}
        inside = lambda at, runs: sum(any(a <= p and p + leaks.SHINGLE <= b for a, b in runs) for p in at)
        for x in range(1, 22):
            for y in range(x + 2, 24):
                runs = [(0, x), (x + 1, y), (y + 1, 25)]
                assert inside(chosen, runs) >= leaks.MIN_HITS and inside(range(n), runs) >= leaks.MIN_SHARED


# -- 8 ----------------------------------------------------------------------------------


def test_content_on_held_out_documents(spark):
    rng = random.Random(13)
    bad = {"abuse": ["You are a {0} grumf, go away and rot.", "Shut up, you {0} grumf."], "hate": ["All zorks are {0} vermin to be driven out.", "We do not let zorks in, they are {0}."], "sexual": ["Free {0} snarkle videos, all night.", "Hot {0} snarkle near you."]}
    fill = ["pathetic", "stupid", "dirty", "useless", "wild"]
    docs, labels, truth = [], [], {}
    for k in range(1200):
        t = prose(5, rng)
        if k % 6 == 0:
            kind = rng.choice(list(bad))
            s = rng.choice(bad[kind]).format(rng.choice(fill))
            s = rng.choice([s, s.upper(), s.replace("u", "*", 1)])
            t += " " + s
            truth[k] = kind
        docs.append((k, t, 0.5))
        if k < 700:
            wrong = rng.random() < 0.03
            labels.append((k, int((k in truth) != wrong), truth.get(k) if not wrong else None))
    docs += [(5000, None, 0.5), (5001, "", 0.5), (5002, " ", 0.5), (5003, "long " * 30_000, 0.5)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score double")
    y = spark.createDataFrame(labels, "doc_id bigint, flagged int, kind string")
    got = {r["doc_id"]: r["kind"] for r in content.score(d, y).collect()}
    assert len(got) == len(docs)
    held = [k for k in range(700, 1200)]
    assert sum(got[k] == truth.get(k) for k in held) >= 0.96 * len(held)
    assert got[5000] is None and got[5003] is None


def test_words_are_counted_in_all_documents(spark):
    rng = random.Random(41)
    texts = [prose(3, rng) + rng.choice(["", " It's gr*mf!", " g r u m f. And 'so'", "\nЕnd… of it"]) for _ in range(3500)] + [None, "", " "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vocabulary = {w for t in texts[:40] for w in content.Tokens().distinct(t)}
    want = Counter(w for t in texts if t for w in {w for p in content.Tokens().passages(t) for w in p} & vocabulary)
    count, total = content.document_counts(d, vocabulary)
    assert total == 3502 and count == want
    assert content.document_counts(d.limit(0), vocabulary) == (dict.fromkeys(vocabulary, 0), 0)


@pytest.mark.parametrize("n", [200, 600])
def test_fit_does_not_depend_on_size(spark, n, monkeypatch):
    """The same share of flagged documents with two telling words teaches, however many they are and in however many parts."""
    rng = random.Random(n)
    docs = [(k, prose(2, rng) + (" Grumf zorkel." if k < n else "")) for k in range(4 * n)]
    labels = [(k, int(k < n), "abuse" if k < n else None) for k in range(2 * n)]
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, flagged int, kind string")
    for chars in (2_000_000, 60_000):
        monkeypatch.setattr(content, "PART_CHARS", chars)
        telling, used, w, held = content.model(d, y)
        of = content.Words(telling).of
        assert content.scores([[of("grumf"), of("zorkel")]], content.spread((used, w)))[0, 0] > 0.5 and len(held) > n / 10


def test_cutoff():
    assert content.cutoff([], {c: 0 for c in content.CUTOFFS}) in content.CUTOFFS
    flagged = {c: 1000 if c < 0.2 else 100 for c in content.CUTOFFS}
    assert content.cutoff([0.6] * 30 + [0.25] * 2, flagged) >= 0.2


def test_telling_words_need_support():
    assert content.telling(1, 0.01) < content.telling(3, 0.1) < content.telling(30, 1)
    assert content.telling(10, 10) < 0


def test_values_of_words_are_those_of_plain_words():
    rng = random.Random(4)
    texts = [prose(5, rng) + rng.choice([" g r u m f you.", " Gr*mf, 3x l33t!", " Élan co-op it's. ", "\n\nOne-two;three 1982 … ​x"]) for _ in range(60)]
    number = {w: k for k, w in enumerate(sorted({w for t in texts for p in content.Tokens().passages(t) for w in p})[::2])}
    for of in (lambda words: [number[w] for w in words if w in number], lambda words: map(len, words)):
        own, plain = content.Tokens(of), content.Tokens()
        for t in texts:
            assert own.distinct(t) == {v for w in plain.distinct(t) for v in of([w])}
        if of([""]) != []:
            assert all(own.passages(t) == [list(of(p)) for p in plain.passages(t)] for t in texts)


def test_words_of_many_texts_at_once(monkeypatch):
    import numpy as np

    rng = random.Random(6)
    odd = [" g r u m f you.", " (Gr*mf) 3x l33t! @@aab_", " Élan co-op it's. \x1c a\u2003b ", "\n\nOne-two;three 1982 …” \u200bx", "...", "  ", None, "", "$aa -- 'book'\n\n\nball.)  " + "long " * 30 + "tail", "word " * 53]
    texts = [x and prose(2, rng) * rng.randint(0, 2) + x for x in odd * 6]
    calls, words = Counter(), content.Words({"grumf": 2.0})
    for chars in (1, 200, 1_000_000):
        monkeypatch.setattr(content, "BLOCK_CHARS", chars)
        own, plain = content.Tokens(lambda found: [words.of(w) for w in found]), content.Tokens(lambda found: [words.of(w) for w in found])
        got = [(int(t), row.tolist()) for owner, n, w in own.tables(texts) for t, row in zip(owner, np.split(w, np.cumsum(n)[:-1]))]
        assert sorted(got) == sorted((k, row) for k, t in enumerate(texts) if t for row in plain.passages(t))
        number = {w: k for k, w in enumerate(sorted({w for t in texts if t for w in content.Tokens().distinct(t)}))}
        found = [(int(t), int(v)) for doc, value in content.Tokens(lambda found: [number[w] for w in found]).held(texts) for t, v in zip(doc, value)]
        assert sorted(found) == sorted((k, number[w]) for k, t in enumerate(texts) if t for w in content.Tokens().distinct(t))
    own = content.Tokens(lambda found: [calls.update(found) or len(w) for w in found])
    assert sum(n.sum() for _, n, _ in own.tables(["word, word. (word) Woord"] * 50)) == 200 and calls["word"] == 1
    told, worth = np.array([3, 5, 9], np.uint64), np.array([0.5, 2.0, 1.0])
    rows = [[rng.randint(0, 10) for _ in range(rng.randint(0, 12))] for _ in range(50)]
    want = [sum(sorted({3: 0.5, 5: 2.0, 9: 1.0}.get(w, 0.0) for w in r)[-4:]) for r in rows]
    flat = np.array([w for r in rows for w in r], np.uint64)
    assert content.best_four(np.repeat(np.arange(50), [len(r) for r in rows]), flat, 50, told, worth).tolist() == pytest.approx(want)


def test_passages_are_shuffled_once(spark):
    rows = spark.createDataFrame([(d % 3, d % 5, d, 0.0, -1, 0.0, [d % 7 + 1, 50 + d, 50 + d, (1 << content.BITS) - 1 - d % 2]) for d in range(40)], content.PASSAGES)
    parts = content.packed(rows)
    assert parts.count() == 3
    assert content.shared_features(parts).tolist() == [*range(1, 8), (1 << content.BITS) - 2, (1 << content.BITS) - 1]
    assert "Exchange" not in parts._jdf.queryExecution().toString()  # the rounds read the parts as they lie
    for sparse in content.fit(parts, content.shared_features(parts)):
        assert set(sparse[0].tolist()) <= {*range(1, 8), (1 << content.BITS) - 2, (1 << content.BITS) - 1} and sparse[1].shape == (3, len(sparse[0]))
    none = content.packed(rows.limit(0))
    assert [len(w[0]) for w in content.fit(none, content.shared_features(none))] == [0, 0]


def test_numbers_close_together():
    import numpy as np

    for n in (0, 1, 500):
        numbers = np.random.default_rng(n).integers(0, 90, n)
        for got, want in zip(content.closely(numbers, 100), np.unique(numbers, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_content_without_verdicts(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    y = spark.createDataFrame([], "doc_id bigint, flagged int, kind string")
    assert {r["doc_id"]: r["kind"] for r in content.score(d, y).collect()} == {1: None, 2: None}
    assert content.score(d.limit(0), y).count() == 0


def test_disguises():
    t = content.Tokens()
    flat = lambda s: [w for p in t.passages(s) for w in p]
    assert flat("g r u m f!") == ["grumf"] and flat("grrrumf gr​umf gr_umf") == ["grumf"] * 3
    assert flat("grumf ае") == ["grumf", "ae"] and flat("gr*mf m0r0n") == ["gr*mf", "m*r*n"]
    v = content.Words({"grumf": 2.0, "other": 0.6})
    assert v.of("gr*mf") == v.of("grumf") and len({v.of("unseen"), v.of("unheard"), v.of("grumf"), v.of("g****")}) == 4
