"""Incremental refresh: upserts, known ids, a budgeted queue of sources, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def refresh_window(rows: DataFrame, generated: str, overlap_days: int = 14, day: str = "roll_date") -> DataFrame:
    """Rows to read again: from ``overlap_days`` before the last run on. The filter is pushed to the scan."""
    return rows.where(F.col(day) >= F.date_sub(F.lit(generated).cast("date"), overlap_days))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns are the new table's."""
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    return kept.select(*new.columns).unionByName(new)


def newest(rows: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """The newest row of each key in one aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("s")).select(*key, *[F.col(f"s.{c}").alias(c) for c in rest])


def unseen(candidates: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that are not known yet."""
    return candidates.join(known.select(*key).distinct(), key, "left_anti")


def within_budget(sources: DataFrame, budget: int, pages: int) -> DataFrame:
    """Sources to fetch in this run: never fetched ones first, then the stalest; each may take ``pages`` requests.

    As all may take as many, the first budget // pages of them fit: a top-k, not a running sum over one task.
    """
    return sources.orderBy(F.col("last_run").asc_nulls_first(), "source").limit(budget // pages)


def work_queue(sources: DataFrame, budget: int, most: int, since: str | None = None) -> DataFrame:
    """Sources to fetch in this run with ``place`` and ``spent``, the requests made before each: never fetched ones first,
    then the stalest. ``sources``: source, last_run, pages.

    A source takes as many requests as it has pages, one at least and ``most`` at most, and is begun only while ``most``
    more fit in the budget; the first that doesn't fit ends the run. With ``since``, sources fetched from then on are
    done, so a run that was cut short goes on where it stopped. As each costs a request, no more than ``budget`` of them
    can be reached: those are a top-k, and only they are summed in order. Null pages count as one; null sources are none.
    """
    if budget < most:
        return sources.limit(0).withColumns({"place": F.lit(0), "spent": F.lit(0).cast("long")})
    due = sources.where("source is not null")
    due = due if since is None else due.where(F.col("last_run").isNull() | (F.col("last_run") < since))
    first = due.orderBy(F.col("last_run").asc_nulls_first(), "source").limit(budget)
    cost = F.least(F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)), F.lit(most))
    order = Window.orderBy(F.col("last_run").asc_nulls_first(), "source")
    told = first.withColumns({"place": F.row_number().over(order), "spent": F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return told.where(F.col("spent") + most <= budget)


def fresh(cached: DataFrame, now: str, seconds: int, stamp: str = "loaded_at") -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return cached.where((F.col(stamp) > at - F.make_interval(secs=F.lit(seconds))) & (F.col(stamp) <= at))


#: Buckets of keys in a table kept by ``upsert_stream``.
BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    """Hadoop's Path and the file system of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose manifest was written whole, in order."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    numbers = sorted(int(n.removeprefix("_current")) for n in names if n.startswith("_current"))
    return [n for n in numbers if fs.exists(_folder(spark, f"{path}/_current{n}/_SUCCESS")[0])]


def _places(spark: SparkSession, path: str, number: int) -> dict[int, str]:
    """The version that holds each bucket after a batch: at most ``BUCKETS`` entries."""
    return {int(k): v for k, v in (r[0].split("=") for r in spark.read.text(f"{path}/_current{number}").collect())}


def _rows_of(spark: SparkSession, path: str, places: dict[int, str], schema: StructType) -> DataFrame:
    found = sorted({f"{path}/{v}/bucket={b}" for b, v in places.items()})
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, number: int, path: str, key: list[str], stamp: str, buckets: int = BUCKETS, keep: int = 2) -> list[int]:
    """Merge a batch into the table at ``path``: the newest row of each key stays. Returns the buckets it rewrote.

    Keys are hashed to buckets, and only buckets that the batch touches are read and written, as version ``number``; a
    manifest then names the version of every bucket. A batch that is run again starts from the manifest before it, so it
    replaces only its own version. Versions that none of the last ``keep`` manifests names are deleted, so readers of the
    last one are safe while the next is made. Ties of ``stamp`` keep one of the rows; null keys are a key; an empty batch
    changes nothing; the table has the columns of its first batch.
    """
    spark = batch.sparkSession
    before = [n for n in _manifests(spark, path) if n < number]
    places = _places(spark, path, before[-1]) if before else {}
    at = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    rows = newest(batch, key, stamp).select(*batch.columns)
    touched = sorted(r[0] for r in rows.select(at.alias("b")).distinct().collect())
    if not touched:
        return []
    old = _rows_of(spark, path, {b: places[b] for b in touched if b in places}, batch.schema)
    merged = newest(old.unionByName(rows), key, stamp).select(*batch.columns)
    merged.withColumn("bucket", at).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
    places |= dict.fromkeys(touched, f"v{number}")
    lines = spark.createDataFrame([(f"{b}={v}",) for b, v in sorted(places.items())], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/_current{number}")
    _expire(spark, path, keep)
    return touched


def _expire(spark: SparkSession, path: str, keep: int) -> None:
    """Delete versions, and buckets of versions, that only older manifests name, and those manifests."""
    known = _manifests(spark, path)
    live = {(v, b) for n in known[-keep:] for b, v in _places(spark, path, n).items()}
    p, fs = _folder(spark, path)
    for n in known[:-keep]:
        fs.delete(_folder(spark, f"{path}/_current{n}")[0], True)
    for status in fs.listStatus(p):
        version = status.getPath().getName()
        if not version.startswith("v") or int(version[1:]) > known[-1]:
            continue
        held = [s.getPath() for s in fs.listStatus(status.getPath()) if s.getPath().getName().startswith("bucket=")]
        dead = [h for h in held if (version, int(h.getName().removeprefix("bucket="))) not in live]
        for h in [status.getPath()] if len(dead) == len(held) else dead:
            fs.delete(h, True)


def upsert_stream(stream: DataFrame, path: str, key: list[str], stamp: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep a table at ``path`` up to date from a stream, batch by batch as ``merge_batch`` does."""
    apply = lambda batch, number: merge_batch(batch, number, path, key, stamp, buckets) and None
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table kept by ``upsert_stream`` as its newest whole manifest names it; None before the first batch."""
    done = _manifests(spark, path)
    if not done:
        return None
    places = _places(spark, path, done[-1])
    schema = spark.read.parquet(f"{path}/{max(places.values(), key=lambda v: int(v[1:]))}").drop("bucket").schema
    return _rows_of(spark, path, places, schema)
