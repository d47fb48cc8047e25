"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """Rows of (doc_id, text) or (doc_id, text, source), in more than one partition; ``extra`` adds columns whose names
    the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("hash", "size", "score", "node", "key", "bucket", "ids", "path", "digest", "n", "__row", "Label", "x", "held_out", "predicted", "quality", "row", "position", "part", "deal", "failed", "shard", "slot", "range", "record", "word", "words", "spans", "item", "edge", "taken", "weight", "salt", "block", "copies"):
            df = df.withColumn(name, F.lit("x"))
    return df


def words(n: int, start: int = 0, prefix: str = "w") -> str:
    return " ".join(f"{prefix}{i}" for i in range(start, start + n))
