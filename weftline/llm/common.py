"""What the problem modules share: text forms, shared files, vote models."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_SIGNS = re.compile(r"[^\w\s]+|_+")
_ASCII_SIGNS = bytes(k for k in range(128) if _SIGNS.match(chr(k)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder for files that all executors can read.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a master on this machine
    (as in tests) takes a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write one file into the shared folder through Hadoop's file system; returns its URI."""
    uri = f"{shared_dir(spark)}/{name}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(conf).create(path, True)
    try:
        out.write(data)
    finally:
        out.close()
    return uri


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again.

    Unlike a local checkpoint this survives the loss of an executor.
    """
    path = shared_dir(df.sparkSession) + "/rows.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Buckets of keys by which rows are sorted out before they are shuffled.
BUCKETS = 1 << 20


def sorted_out(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows that may have one of the wanted keys; the others stay where they are.

    At most ``BUCKETS`` numbers are broadcast, whatever the tables. A row of a bucket
    without any wanted key passes no join by these keys.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")
    return rows.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")


#: Rows of a list of frequent words that the driver takes.
MOST_COMMON = 10_000


def bounded(df: DataFrame, most: int) -> list[Row]:
    """The rows of a small table; one with more than ``most`` rows is an error, none is dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    return rows


def fold(text: str) -> str:
    """Lower case, compatibility forms composed; the letters that formatting leaves alone."""
    text = text.lower()
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", text.replace("­", "").replace("​", "")).lower()


def signless(text: str) -> str:
    """The text folded and without signs."""
    text = fold(text)
    if text.isascii():
        return text.encode().translate(None, _ASCII_SIGNS).decode()
    return _SIGNS.sub("", text)


def words(text: str) -> list[str]:
    """What stands between white space, folded and without signs: "l'eau" and "leau" are one word, "49.5" and "495" too."""
    return signless(text).split()


def side_of(split: Column) -> Column:
    """'train', 'eval' or null for a split name in any letter case."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", "train").when(s.isin("validation", "test"), "eval")


def fit_votes(counts: list[tuple[str, float]], tables: list[np.ndarray], prior: np.ndarray, anchor: float = 0.25, rows: float = 40, rounds: int = 60, held: dict[int, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], list[np.ndarray], np.ndarray]:
    """Expectation-maximization over the distinct patterns of labelling functions' votes.

    A pattern has one digit for each function, the bin it votes; ``tables`` hold
    what is assumed of P(bin | class), (classes, bins) each. They weigh as much as ``rows``
    rows and the share ``anchor`` of all, so that a rare class keeps its meaning while the
    functions' accuracies are learned from their agreement. ``held`` gives, by function,
    P(bin | first class) where it was measured on rows known to be of that class. Returns the posterior of every
    pattern, the learned tables and the learned prior.
    """
    tables = [np.asarray(t, float) for t in tables]
    if not counts:
        return {}, tables, prior
    votes = np.array([[int(c) for c in p] for p, _ in counts])
    n = np.array([c for _, c in counts], float)
    start = [t.copy() for t in tables]
    pi, post = prior.copy(), None
    strength = rows + anchor * n.sum()
    for _ in range(rounds):
        log = np.log(pi)[None] + sum(np.log(t[:, votes[:, j]]).T for j, t in enumerate(tables))
        log -= log.max(1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(1, keepdims=True)
        if post is not None and np.abs(new - post).max() < 1e-6:
            break
        post = new
        weight = post * n[:, None]
        pi = (weight.sum(0) + 10 * prior) / (n.sum() + 10)
        for j, s in enumerate(start):
            seen = np.stack([weight[votes[:, j] == k].sum(0) for k in range(s.shape[1])], 1)
            t = seen + strength * prior[:, None] * s + 5 * s
            tables[j] = t / t.sum(1, keepdims=True)
            if held and j in held:
                tables[j][0] = held[j]
    return {p: row for (p, _), row in zip(counts, post)}, tables, pi
