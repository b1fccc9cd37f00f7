"""Golden micro-vectors, invariants over the tables, and the same results in every partitioning."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.config import Lengths, Pretraining, Rag, Specials, Trajectory
from weftline.functions import arrays as A
from weftline.functions import text as T
from weftline.operators import batching, encoder, metrics, vectors
from weftline.plans import pretraining, rag, registry, trajectory
from weftline.sources import sinks, tables

DATA = "/root/testdata/sf0.001"
SP = Specials()


def stub_encoder(width: int = 4) :
    """Vectors from a hash of position and token: a stand-in for a model."""

    def vector(pos: int, token: str) -> list[float]:
        digest = hashlib.md5(f"{pos}|{token}".encode()).digest()
        return [x / 255 for x in digest[:width]]

    return lambda: lambda rows: [[vector(p, t) for p, t in enumerate(r)] for r in rows]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else A.empty()


def toks(n, start=0):
    return arr(*[str(k) for k in range(start, start + n)])


def test_clean_text(spark):
    assert value(spark, T.clean_text(F.lit("a<MEM>b<RET>c<AE>"))) == "a< MEM >b< RET >c<AE>"
    assert value(spark, T.clean_text(F.lit("<AE>"), ("AE",))) == "< AE >"


def test_tokens_round_trip(spark):
    for text in ("", "a", "a  b ", "\n x", " "):
        assert value(spark, F.array_join(T.space_tokens(F.lit(text)), " ")) == text
    assert value(spark, T.space_tokens(F.lit(""))) == []


def test_fixed_chunks(spark):
    got = value(spark, A.fixed_chunks(toks(10), 5, 2))
    assert got == [["0", "1", "2", "3", "4"], ["3", "4", "5", "6", "7"], ["6", "7", "8", "9"], ["9"]]
    assert value(spark, A.fixed_chunks(arr(), 5)) == []
    with pytest.raises(ValueError):
        A.fixed_chunks(toks(3), 5, 5)


@pytest.mark.parametrize("n,sizes", [(10, [10]), (13, [5, 8]), (0, []), (7, [7])])
def test_random_tail_without_a_draw(spark, n, sizes):
    spans = value(spark, A.random_tail_spans(F.lit(1), F.lit(n), 10, 0.8, 42))
    assert [s["len"] for s in spans] == sizes


def test_random_tail_holds(spark):
    rows = spark.range(400).select("id", (F.col("id") * 7).cast("int").alias("n")).withColumn("s", A.random_tail_spans(F.col("id"), F.col("n"), 50, 0.8, 42)).collect()
    for r in rows:
        sizes = [s["len"] for s in r["s"]]
        assert sum(sizes) == r["n"] and all(0 < k <= 50 for k in sizes)
        assert [s["st"] for s in r["s"]] == [sum(sizes[:k]) for k in range(len(sizes))]
        if sizes:
            assert sizes[-1] >= min(r["n"], 40) and all(k >= 40 for k in sizes[:-2])


def test_random_k(spark):
    assert value(spark, A.random_k_sizes(F.lit(1), F.lit(6), F.lit(3), 2, 42)) == [2, 2, 2]
    assert value(spark, A.random_k_sizes(F.lit(1), F.lit(2), F.lit(3), 2, 42)) is None
    assert value(spark, A.random_k_sizes(F.lit(1), F.lit(7), F.lit(3), 2, 42)) is None
    rows = spark.range(60).select(A.random_k_sizes(F.col("id"), F.lit(40), F.lit(6), 9, 1).alias("s")).collect()
    assert all(len(r["s"]) == 6 and sum(r["s"]) == 40 and max(r["s"]) <= 9 and min(r["s"]) >= 1 for r in rows)
    assert len({tuple(r["s"]) for r in rows}) > 30


def test_n_mem(spark):
    assert [value(spark, A.n_mem(F.lit(n), 16)) for n in (0, 15, 16, 17, 128)] == [1, 1, 2, 2, 9]
    assert value(spark, A.with_mem(arr("a"), 16, Specials(retrieval="<R>"))) == ["a", "<MEM>", "<R>"]


def test_continuation_parts(spark):
    c = Pretraining(lengths=Lengths(compressor_max=4, decoder_max=8, rate=2))
    df = spark.createDataFrame([(k, [str(x) for x in range(n)]) for k, n in ((1, 1), (2, 10), (3, 0), (4, 40))], "doc_id bigint, tk array<string>")
    for r in pretraining.continuation_parts(df, c).collect():
        ids = [str(x) for x in range({1: 1, 2: 10, 3: 0, 4: 12}[r["doc_id"]])]
        assert r["t1"] + r["t2"] + r["t3"] == ids
        assert len(r["t1"]) <= len(r["t1"] + r["t2"]) // 2 + 1 and len(r["t3"]) >= len(ids) // 2
    one = pretraining.rows(df.where("doc_id = 1"), c, "continuation").first()
    assert one["decoder"] == ["<s>", "<MEM>", "0", "</s>"] and one["n_mem"] == 1


def steps_df(spark, lens, flags):
    rows = [(1, k, [f"{k}_{x}" for x in range(n)], n, f, -(-n // 4), (n // 4) * 3 + ((n % 4) // 2 + 1 if n % 4 else 0)) for k, (n, f) in enumerate(zip(lens, flags))]
    return spark.createDataFrame(rows, "traj_id bigint, step_no int, tk array<string>, n int, flag boolean, n_chunks int, mems int")


SMALL = Trajectory(lengths=Lengths(rate=2, compressor_max=4, decoder_max=10))


@pytest.mark.parametrize("lens,flags,strict,kept", [((1, 6, 3), (True, False, False), False, [1, 6, 0]), ((1, 7, 3), (True, False, False), False, [1, 7, 2]), ((1, 7, 3), (True, False, False), True, [1, 7, 0])])
def test_budget(spark, lens, flags, strict, kept):
    c = Trajectory(lengths=SMALL.lengths, strict_budget=strict)
    rows = trajectory.budget(steps_df(spark, lens, flags), c).orderBy("step_no").collect()
    assert [r["kept"] for r in rows] == kept


def test_force_first(spark):
    rows = trajectory.budget(trajectory.forced(steps_df(spark, (9, 3), (False, False)), SMALL), SMALL).orderBy("step_no").collect()
    assert [(r["flag"], r["kept"]) for r in rows] == [(True, 7), (False, 1)]


def test_budget_against_simulation(spark):
    """Step by step, as the rule is told: break after a compressed step beyond the budget or within a clear one."""
    rng = random.Random(6)
    for _ in range(25):
        n = rng.randint(1, 7)
        lens, flags = [rng.randint(0, 8) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
        dmax, out, length = 10, [], 0
        for size, flag in zip(lens, flags):
            length += 1
            if flag:
                m = (size // 4) * 3 + ((size % 4) // 2 + 1 if size % 4 else 0)
                length += m
                out.append(m)
                if length > dmax:
                    break
            else:
                if length + size > dmax:
                    k = len(list(range(size))[: dmax - length])
                    out.append(k)
                    length += k
                    break
                out.append(size)
                length += size
        rows = trajectory.budget(steps_df(spark, lens, flags), SMALL).orderBy("step_no").collect()
        assert [r["kept"] for r in rows] == out, (lens, flags)


def test_trajectory_rejects(spark):
    df = spark.createDataFrame([(1, [""]), (2, ["a b c"]), (3, ["", ""])], "traj_id bigint, steps array<string>")
    assert {r[0] for r in trajectory.rejects(df, Trajectory()).collect()} == {1, 3}
    row = trajectory.rows(df, Trajectory()).first()
    assert row["traj_id"] == 2 and row["decoder"] in (["\n", "<MEM>"],)


def test_padding(spark):
    df = spark.createDataFrame([(1, ["5", "6"], 0), (2, ["7"], 0)], "k bigint, ids array<string>, batch_id bigint")
    rows = {r["k"]: r for r in batching.padded(df, "ids", "0").collect()}
    assert rows[2]["padded"] == ["0", "7"] and rows[1]["mask"] == [1, 1] and rows[2]["mask"] == [0, 1]


def test_labels(spark):
    row = arr("<AE>", "<MEM>", "<MEM>", "<s>", "10", "11", "</s>")
    assert value(spark, A.mask_special(row, SP)) == ["-100"] * 4 + ["10", "11", "</s>"]
    row = arr("<s>", "10", "<MEM>", "11", "</s>")
    assert value(spark, A.mask_special(row, SP)) == ["-100", "10", "-100", "11", "</s>"]
    assert value(spark, A.mask_special(A.mask_before_mem(row, SP.mem), SP)) == ["-100"] * 3 + ["11", "</s>"]
    assert value(spark, A.mask_before_mem(arr("1", "2"), SP.mem)) == ["1", "2"]
    assert value(spark, A.mask_prefix(arr("<pad>", "a", "b", "c"), F.lit(2), "<pad>", 0)) == ["-100", "-100", "-100", "c"]
    assert value(spark, A.mask_prefix(arr("<pad>", "a", "b", "c"), F.lit(2), "<pad>", 4)) == ["<pad>", "a", "b", "c"]
    assert value(spark, A.unmask(arr("x", "y"), arr("-100", "y"), "<pad>")) == ["<pad>", "y"]


def test_normalize(spark):
    assert value(spark, T.normalize(F.lit("The  Cat's\tHat!"))) == "the cats hat"
    assert value(spark, T.normalize(F.lit("don’t"))) == "don’t"
    assert value(spark, T.normalize(F.lit(" \xa0a b　"))) == "a b"


def pairs(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ex_id bigint, prediction string, reference string")


def test_match_and_f1(spark):
    got = {r["ex_id"]: r for r in metrics.pair_scores(pairs(spark, ("Paris, France", "paris"), ("x", ""), ("a b b", "b b c"), ("A", "a"), ("", "z"))).collect()}
    assert got[0]["m"] == 1.0 and got[1]["m"] == 1.0 and got[3]["em"] == 1.0
    assert all(abs(got[2][c] - 2 / 3) < 1e-12 for c in ("f1", "precision", "recall"))
    assert got[3]["f1"] == got[4]["f1"] == got[4]["rouge_1"] == got[4]["rouge_l"] == 0.0


def test_f1_multi(spark):
    df = spark.createDataFrame([(1, "a b", ["a", "a b c d"]), (2, "a", [])], "ex_id bigint, p string, refs array<string>")
    got = {r["ex_id"]: r for r in metrics.f1_multi(df, "ex_id", "p", "refs").collect()}
    assert abs(got[1]["f1"] - 2 / 3) < 1e-12 and got[1]["precision"] == 1.0 and got[1]["recall"] == 1.0 and got[2]["f1"] == 0.0
    chars = spark.createDataFrame([(1, "a cat", "tack a"), (2, "the cat", "the cat")], "ex_id bigint, p string, r string")
    got = {r["ex_id"]: r for r in metrics.f1_multi(chars, "ex_id", "p", "r", char_refs=True).collect()}
    assert abs(got[1]["f1"] - 2 / 3) < 1e-12 and got[1]["precision"] == 0.5 and got[1]["recall"] == 1.0 and got[2]["f1"] == 0.0
    with pytest.raises(Exception, match="no characters"):
        metrics.f1_multi(spark.createDataFrame([(1, "a", "")], "ex_id bigint, p string, r string"), "ex_id", "p", "r", char_refs=True).collect()


def test_scores_against_python(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for _ in range(60)]
    got = {r["ex_id"]: r for r in metrics.pair_scores(pairs(spark, *rows)).collect()}

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for k, (p, r) in enumerate(rows):
        a, b = p.split(), r.split()
        same = sum((Counter(a) & Counter(b)).values())
        assert abs(got[k]["f1"] - (2 * same / (len(a) + len(b)) if same else 0)) < 1e-12
        n = lcs(a, b)
        assert abs(got[k]["rouge_l"] - (2 * n / (len(a) + len(b)) if n else 0)) < 1e-12
        x, y = ({tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (a, b))
        assert abs(got[k]["rouge_2"] - (2 * len(x & y) / (len(x) + len(y)) if x & y else 0)) < 1e-12


def test_prompt_parts(spark):
    assert value(spark, T.query_prefix(F.lit("Q?"), F.lit("D"))) == "Query: Q?\n Document: D"
    assert value(spark, T.doc_section(F.array(F.lit(1), F.lit(2)))) == "Document 0:<MEM>Document 1:<MEM><MEM>"
    c = Rag(user_prompt="[documents] - [question]")
    assert value(spark, T.rag_prompt(c, F.lit("[question]"), F.lit("why"))) == "why - why"  # documents first, then the question in the result


def test_rag_rows(spark):
    df = spark.createDataFrame([(1, ["a b c", ""], "q<MEM>", "yes"), (2, [], "q", None), (3, ["x " * 300] * 7, "q", "z " * 900)], "ex_id bigint, docs array<string>, query string, label string")
    c = Rag()
    rows = {r["ex_id"]: r for r in rag.rows(df, c).collect()}
    assert rows[1]["n_mems"] == [1, 1] and rows[1]["lost_mem"] == 0 and rows[1]["decoder"].count("<MEM>") == 2
    assert "yes" in [x for x in rows[1]["labels"] if x != "-100"]
    assert rows[2]["n_loss"] == 0 and rows[2]["chunks"] == []
    assert len(rows[3]["n_mems"]) == 5 and len(rows[3]["decoder"]) == c.lengths.decoder_max
    chunked = {r["ex_id"]: r for r in rag.rows(df, Rag(chunk_docs=True, n_max_chunks=2)).collect()}
    assert chunked[1]["n_mems"] == [1, 0] and len(chunked[3]["chunks"]) == 10
    dependent = rag.rows(df, Rag(query_dependent=True)).where("ex_id = 1").first()
    assert dependent["chunks"][0][:2] == ["Query:", "q<"]
    assert registry.check(rag.rows(df, c), "ex_id", 16).first()["n_mismatch"] == 0


def test_configs():
    with pytest.raises(ValueError):
        Rag(chunk_docs=True, query_dependent=True)
    with pytest.raises(ValueError):
        Specials(pad="</s>")
    with pytest.raises(ValueError):
        Pretraining(min_ratio=1.5)
    with pytest.raises(TypeError):
        Lengths(16)
    assert Rag(chunk_docs=True).may_overflow()


def test_vectors(spark):
    hidden = spark.createDataFrame([(1, 0, "<MEM>", [1.0, -1.0]), (1, 1, "x", [0.0, 0.0]), (1, 2, "<MEM>", None)], "ex_id bigint, pos int, token string, vec array<double>")
    got = vectors.mem_gather(hidden, "ex_id").orderBy("pos").collect()
    assert [(r["mem_ordinal"], r["pos"]) for r in got] == [(0, 0), (1, 2)]
    out = hidden.select("pos", vectors.connector(F.col("vec"), [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0], [[1.0, 1.0]], [0.5]).alias("y")).orderBy("pos").collect()
    assert [r["y"] for r in out] == [[1.5], [0.5], None]
    places = spark.createDataFrame([(1, 4), (1, 9)], "ex_id bigint, pos int")
    vecs = spark.createDataFrame([(1, 0, [7.0])], "ex_id bigint, mem_ordinal int, vec array<double>")
    assert {(r["pos"], r["mem_ordinal"], tuple(r["vec"] or ())) for r in vectors.scatter(places, vecs, "ex_id").collect()} == {(4, 0, (7.0,)), (9, 1, ())}
    assert value(spark, vectors.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    coded = encoder.encode(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k bigint, t array<string>"), "k", "t", stub_encoder(3))
    assert coded.count() == 2 and len(coded.first()["vec"]) == 3


def test_compress(spark):
    rows = spark.createDataFrame([(1, ["a", "<MEM>", "b", "<MEM>"]), (2, ["c"])], "k bigint, t array<string>")
    double = lambda vec: vectors.connector(vec, [[2.0, 0.0], [0.0, 2.0]], [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])
    got = encoder.compress(rows, "k", "t", stub_encoder(2), double).orderBy("pos").collect()
    want = stub_encoder(2)()([["a", "<MEM>", "b", "<MEM>"]])[0]
    assert [(r["k"], r["mem_ordinal"], r["pos"]) for r in got] == [(1, 0, 1), (1, 1, 3)]
    assert all(abs(x - 2 * y) < 1e-12 for r in got for x, y in zip(r["vec"], want[r["pos"]]))


def test_scatter_in_row(spark):
    tokens = F.array(*map(F.lit, ["<MEM>", "x", "<MEM>"]))
    got = value(spark, vectors.scatter_in_row(tokens, F.array(F.array(F.lit(7.0)))))
    assert [(r["pos"], r["mem_ordinal"], r["vec"]) for r in got] == [(0, 0, [7.0]), (2, 1, None)]


@pytest.mark.parametrize("most", [10, 1])
def test_lookup(spark, most):
    tokens = spark.createDataFrame([(k, x) for k in range(40) for x in ("a", "b", "?")], "k bigint, token string")
    vocabulary = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "token string, vec array<double>")
    got = sorted((r["k"], r["token"], tuple(r["vec"] or ())) for r in vectors.lookup(tokens, vocabulary, most=most).collect())
    assert got == sorted((k, x, v) for k in range(40) for x, v in (("a", (1.0,)), ("b", (2.0,)), ("?", ())))


def test_two_tables_meet_by_key(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "z")], "k bigint, prediction string")
    r = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "k bigint, reference string")
    assert sorted(map(tuple, metrics.matched(p, r, "k").collect())) == [(1, "a", "A"), (2, "b", "B"), (2, "c", "B")]
    assert {x["side"]: x["n"] for x in metrics.unmatched(p, r, "k").collect()} == {"prediction": 1, "reference": 1}
    means = metrics.hard_metrics(metrics.matched(p, r, "k"), "k", {"same_length": lambda a, b: (F.length(a) == F.length(b)).cast("double")}).first()
    assert means["em"] == round(2 / 3, 6) and means["same_length"] == 1.0


@pytest.mark.parametrize("most", [10, 0])
def test_first_deliveries(spark, tmp_path, most):
    rows = [(k, f"text {k}", d) for k in range(50) for d in ((3, 1, 2) if k % 10 == 0 else (5,))] + [(None, "no key", 1), (None, "no key either", 2)]
    spark.createDataFrame(rows, "k bigint, text string, loaded_at int").repartition(5).write.parquet(str(tmp_path / "t"))
    got = tables.first_deliveries(spark.read.parquet(str(tmp_path / "t")), "k", most).collect()
    keyed = [r for r in got if r["k"] is not None]
    assert sorted((r["k"], r["text"]) for r in keyed) == [(k, f"text {k}") for k in range(50)]
    assert all(r["loaded_at"] == (1 if r["k"] % 10 == 0 else 5) for r in keyed)
    assert sorted(r["text"] for r in got if r["k"] is None) == ["no key", "no key either"]


def test_row_numbers_of_sparse_and_uneven_ids(spark):
    rng = random.Random(8)
    ids = sorted({*range(300), *(rng.getrandbits(62) for _ in range(3000)), -(1 << 62), -5})
    df = spark.createDataFrame([(k,) for k in ids], "k bigint").repartition(6)
    assert {r["k"]: r["row_no"] for r in tables.by_id(df, "k", buckets=64).collect()} == {k: i for i, k in enumerate(ids)}
    sizes = tables.by_id(df, "k", buckets=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in sizes


def test_preview(spark):
    rows = spark.createDataFrame([(1, ["<pad>", "<s>", "a", "</s>"], ["-100", "-100", "a", "</s>"], "x")], "k bigint, decoder array<string>, labels array<string>, task string")
    assert tuple(sinks.preview(rows, "k", keep=("task", "other")).first()) == (1, "a", "a", "0111", "0011", "x")
    assert tuple(sinks.preview_pairs(pairs(spark, ("p", "r")), "ex_id").first()) == (0, "r", "p")


def test_registry(spark):
    with pytest.raises(KeyError):
        registry.build("nothing", spark.range(1))
    with pytest.raises(ValueError):
        registry.register("rag", lambda df: df)
    assert registry.build("pretraining", tables.texts(spark, DATA)).columns[:2] == ["doc_id", "task"]


def test_sinks(spark, tmp_path):
    rows = pretraining.rows(pretraining.with_tokens(tables.texts(spark, DATA)), Pretraining())
    sinks.write_rows(rows, str(tmp_path / "rows"), Pretraining())
    assert spark.read.parquet(str(tmp_path / "rows")).count() == tables.texts(spark, DATA).count()
    assert "compressor_max" in spark.read.text(str(tmp_path / "rows_config"), wholetext=True).first()[0]
    assert sinks.preview(rows, "doc_id").count() == 2


def test_schema_is_checked(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "pretrain_in.parquet"))
    with pytest.raises(ValueError, match="needs a column"):
        tables.read(spark, str(tmp_path), "pretrain_in")


def test_dense_index_and_split(spark):
    df = spark.range(0, 30_000, 3).withColumnRenamed("id", "k").repartition(7)
    got = {r["k"]: r["row_no"] for r in tables.by_id(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(range(0, 30_000, 3))}
    split = tables.train_test_split(df, "k")
    assert split.where("is_test").count() == 64 and split.count() == 10_000
    places = sorted(r["place"] for r in tables.shuffled(df, "k").collect())
    assert places == list(range(10_000))
    assert tables.by_id(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_same_in_every_partitioning(spark, parts):
    texts = tables.texts(spark, DATA).repartition(parts)
    rows = pretraining.rows(pretraining.with_tokens(texts), Pretraining())
    digest = rows.select(F.xxhash64("doc_id", "task", "decoder", "labels").alias("h")).agg(F.sum(F.col("h") % 1_000_003)).first()[0]
    whole = pretraining.rows(pretraining.with_tokens(tables.texts(spark, DATA).coalesce(1)), Pretraining())
    assert digest == whole.select(F.xxhash64("doc_id", "task", "decoder", "labels").alias("h")).agg(F.sum(F.col("h") % 1_000_003)).first()[0]


def test_rows_hold(spark):
    c = Pretraining()
    rows = pretraining.rows(pretraining.with_tokens(tables.texts(spark, DATA)), c)
    bad = rows.where((F.size("decoder") != F.size("labels")) | (F.size("decoder") > c.lengths.decoder_max) | (F.col("lost_mem") < 0) | F.exists("chunks", lambda x: F.size(x) > 128 + 31))
    assert bad.count() == 0
    assert rows.where(F.exists(F.arrays_zip("decoder", "labels"), lambda z: (z["labels"] != "-100") & (z["labels"] != z["decoder"]))).count() == 0
