"""Reading tables, and rows chosen from them: limits, splits, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import u32

SCHEMAS = {
    "pretrain_in": {"doc_id": "bigint", "text": "string"},
    "rag_in": {"ex_id": "bigint", "docs": "array<string>", "query": "string", "label": "string"},
    "traj_in": {"traj_id": "bigint", "steps": "array<string>"},
    "pairs_in": {"ex_id": "bigint", "prediction": "string", "reference": "string"},
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A Parquet table; one with a declared schema must have its columns."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for name, kind in SCHEMAS.get(table, {}).items():
        if name not in df.columns or dict(df.dtypes)[name] != kind:
            raise ValueError(f"{table} needs a column {name} of type {kind}")
    return df


#: Repeated records up to which their first places are broadcast (24 bytes each), and the parts over which a hot key is spread beyond.
MOST_REPEATED, SALTS = 2_000_000, 16


def first_deliveries(df: DataFrame, key: str, most: int = MOST_REPEATED) -> DataFrame:
    """One row for each key of a Parquet table, without moving the rows.

    Keys alone are counted, and the places of the first deliveries (by ``loaded_at`` if
    there is one) of repeated keys are broadcast: rows of these keys at other places are
    dropped where they lie. Beyond ``most`` repeated keys the same join is a salted shuffle.
    Rows without a key stay.
    """
    place = {"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    keys = df.select(F.col(key).alias("__key"), *(["loaded_at"] if "loaded_at" in df.columns else []), *(c.alias(n) for n, c in place.items()))
    order = F.struct(*keys.columns[1:])
    repeated = keys.groupBy("__key").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1 and __key is not null")
    firsts = repeated.select("__key", F.col("first.__file").alias("__first_file"), F.col("first.__row").alias("__first_row"))
    later = (F.col(key) == F.col("__key")) & ((F.col("__file") != F.col("__first_file")) | (F.col("__row") != F.col("__first_row")))
    placed = df.withColumns(place)
    if repeated.count() <= most:
        rows = placed.join(F.broadcast(firsts), later, "left_anti")
    else:
        spread = firsts.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = placed.withColumn("__salt", F.pmod("__row", F.lit(SALTS)).cast("int")).join(spread, later & (F.col("__salt") == F.col("__to")), "left_anti").drop("__salt")
    return rows.drop("__file", "__row")


def records(spark: SparkSession, sf_dir: str, table: str, where: str | None = None) -> DataFrame:
    """The declared columns of the rows wanted, a record delivered again once; no row is shuffled."""
    columns = list(SCHEMAS[table])
    df = first_deliveries(read(spark, sf_dir, table), columns[0]).select(*columns)
    return df if where is None else df.where(where)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the pretraining records; null texts are rejected here."""
    return records(spark, sf_dir, "pretrain_in", "text is not null")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, docs, query, label); rows without a query are rejected, null passages become empty ones and keep their place."""
    docs = F.coalesce(F.transform("docs", lambda d: F.coalesce(d, F.lit(""))), F.array().cast("array<string>"))
    return records(spark, sf_dir, "rag_in", "query is not null").withColumn("docs", docs)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, steps) of trajectories with steps; null steps become empty ones and keep their place."""
    steps = F.transform("steps", lambda s: F.coalesce(s, F.lit("")))
    return records(spark, sf_dir, "traj_in", "size(steps) > 0").withColumn("steps", steps)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, prediction, reference); pairs without a reference are rejected, a null prediction is an empty one."""
    return records(spark, sf_dir, "pairs_in", "reference is not null").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def dense_index(df: DataFrame, bucket: Column, *order: Column, name: str = "row_no") -> DataFrame:
    """Row numbers from 0 in a total order, without sorting all rows in one task.

    ``bucket`` must rise with the order and have a bounded number of values. Rows are
    numbered within their bucket; the buckets' offsets are a running sum over one row
    for each bucket.
    """
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__bucket", before.alias("__before"))
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    return numbered.join(offsets, "__bucket").withColumn(name, F.col("__before") + F.col("__k") - 1).drop("__bucket", "__before", "__k")


def by_id(df: DataFrame, key: str, name: str = "row_no", buckets: int = 1024) -> DataFrame:
    """Row numbers by a key of any values: the buckets are cut at its quantiles, so that each holds about as many rows.

    ``buckets`` is a power of two; more of them suit larger tables.
    """
    steps = buckets.bit_length() - 1
    cuts = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("cuts")).scalar()
    rows = df.withColumn("__cuts", cuts)

    def half(at: Column, step: Column) -> Column:
        """Binary search: the number of cuts at or below the key."""
        to = at + F.element_at(F.array(*(F.lit(buckets >> s) for s in range(1, steps + 1))), step)
        return F.when(F.get("__cuts", to - 1) <= F.col(key), to).otherwise(at)

    bucket = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), half)
    return dense_index(rows, bucket, F.col(key), name=name).drop("__cuts")


def train_test_split(df: DataFrame, key: str, seed: int = 42, most: int = 64) -> DataFrame:
    """``is_test`` marks min(``most``, n // 10) rows with the smallest draws."""
    n = min(most, df.count() // 10)
    test = df.select(key, u32(seed, F.col(key), "split").alias("__u")).orderBy("__u", key).limit(n).select(key, F.lit(True).alias("is_test"))
    return df.join(F.broadcast(test), key, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``place`` is the row's place in a random order that depends on seed and key only."""
    u = u32(seed, F.col(key), "shuffle")
    return dense_index(df.withColumn("__u", u), F.shiftright(F.col("__u"), 20), F.col("__u"), F.col(key), name="place").drop("__u")
