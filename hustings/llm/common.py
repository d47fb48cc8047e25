"""Helpers shared by the training-data operators: durable intermediates, checked broadcasts, salted lookups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (an id and a hash, under 64 bytes a row) up to which it is broadcast after being counted.
BROADCAST_ROWS = 1_000_000

#: A word is a run of anything but ASCII white space. The same pattern works in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="spark-hustings-"))
    return "file://" + _local_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/hustings-{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete durable tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/hustings-" in path:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, durable table for broadcast when its counted rows are within ``limit``; else leave a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (one row a key) so that one hot key of ``left`` is dealt to ``salts`` tasks.

    ``spread`` is a column of ``left`` whose hash deals a key's rows out. ``right`` is repeated ``salts`` times, which Spark's
    estimate of its size leaves out; so it is merged, as a broadcast chosen by that estimate may exceed the driver's memory.
    """
    salt = fresh("salt", left, right)
    l = left.withColumn(salt, F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    r = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r.hint("merge"), [key, salt], how).drop(salt)


def weighed_lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (durable, one row a key), whose column ``rows`` tells how many rows of ``left`` have the key.

    A key with more rows than a quarter of a mean partition is hot. At most four times as many keys as there are
    partitions can be, so the table of them may be broadcast at any size of the input; each is dealt out by ``spread``
    over as many tasks as bring it down to that size, and only its row of ``right`` is repeated.
    """
    parts = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(rows)).first()[0] or 0
    share = max(1, -(-total // parts))
    salt, salts = fresh("salt", left, right), fresh("salts", left, right)
    n = F.ceil(F.col(rows) / F.lit(share)).cast("int")
    hot = right.where(F.col(rows) > share).select(*keys, n.alias(salts))
    l = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(F.col(salts) > 1, F.pmod(F.xxhash64(spread), F.col(salts)).cast("int")).otherwise(0)).drop(salts)
    r = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > share, n - 1).otherwise(0))))
    return l.join(r, [*keys, salt], how).drop(salt)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of ``tables`` has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches (which Spark bounds in bytes) in views of few rows, so that a task turns few texts to Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
