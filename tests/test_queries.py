"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the streaming stages give those of the batch."""

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftline import catalogue  # noqa: E402
from weftline.sources import tables  # noqa: E402
from weftline.streaming import rows as streams  # noqa: E402

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, other, name):
    df = catalogue.queries()[name](spark, DATA)
    result = other.sql(catalogue.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(result.columns)
    at = [result.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["clean_text", "token_counts", "rag_rows", "hard_metrics"])
def test_no_text_is_shuffled_to_drop_repeats(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, DATA))
    assert "Python" not in plan or name == "hard_metrics"
    moved = [part.split("Input", 1)[1].split("\n")[0] for part in plan.split("\n\n") if ") Exchange" in part or ") BroadcastExchange" in part]
    assert moved and not any(column in line for line in moved for column in ("text#", "docs#", "query#", "label#", "prediction#", "reference#"))


def test_scan_prunes_columns(spark):
    plan = plan_of(catalogue.queries()["token_counts"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,text:string,_tmp_metadata_row_index:bigint>" in plan and "IsNotNull(text)" in plan
    assert "split" not in plan.split("ReadSchema", 1)[1].split("\n")[0]


def as_folder(spark, tmp_path):
    """The table as several files in a folder, as it grows in practice."""
    spark.read.parquet(f"{DATA}/pretrain_in.parquet").repartition(5).write.parquet(str(tmp_path / "pretrain_in.parquet"))
    return str(tmp_path)


def test_stream_gives_the_batch_rows(spark, tmp_path):
    folder = as_folder(spark, tmp_path)
    counted = streams.once(streams.chunk_counts(streams.stream(spark, folder, "pretrain_in"), 128, 16), "doc_id")
    q = counted.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counted").drop("loaded_at")
    want = streams.chunk_counts(tables.read(spark, folder, "pretrain_in"), 128, 16).drop("loaded_at").distinct()
    assert got.exceptAll(want).count() == 0 and got.select("doc_id").distinct().count() == want.count()


def test_each_batch(spark, tmp_path):
    folder, out = as_folder(spark, tmp_path), str(tmp_path / "out")
    from weftline.operators import batching

    source = streams.chunk_counts(streams.stream(spark, folder, "pretrain_in"), 128, 16)
    q = streams.each_batch(source, str(tmp_path / "c2"), lambda df: batching.assign(df.dropDuplicates(["doc_id"]), "doc_id", 4), out)
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/*")
    assert rows.groupBy("micro_batch", "batch_id").count().agg(F.max("count")).first()[0] <= 4 and rows.count() > 0
