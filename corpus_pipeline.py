"""A training-data pipeline over ``documents``: five stages, each one of the operators of ``hustings.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last
return the columns of ``documents``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hustings.llm import classifier, mixing, ngram_join, secrets, wfst
from hustings.llm.common import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the rest keep all columns.

    Null and empty texts are scored like any other (their features are zeros), very long ones whole; a score equal to the
    threshold stays; repeated rows stay or go together; null and contradictory labels are no labels or their mean;
    without labels every document stays; an empty table stays empty; further columns, whatever their names, are kept.
    """
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) the document with the smallest id stays.

    Null and empty texts and null ids are in no group and stay; very long texts are compared whole; of rows that repeat
    an id one stays; an empty table stays empty; further columns, whatever their names, are kept.
    """
    return ngram_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are replaced in the texts, and ``n_chars`` follows; no row goes.

    Null texts stay null, empty ones empty; very long texts are scanned whole; values that overlap become one mark;
    repeated rows change alike; an empty table stays empty; further columns, whatever their names, are kept.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix of sources asks, up to three times.

    A null source is a source; null and empty texts count no words and go or stay by their hash; long ones are counted
    whole; documents of one hash (null and repeated ids) are told apart by their texts, rows equal in both go together;
    an empty table stays empty; further columns, whatever their names, are kept.
    """
    return mixing.apply_mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: a row for each row of ``docs``.

    Null and empty texts have no ids; very long ones are encoded whole; equally cheap paths are settled by the longest
    last piece; repeated rows give repeated results; an empty table gives no rows; further columns are not returned.
    """
    return wfst.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", tokenise),
]

#: No SQL expresses the classifier, the joins' signatures or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
