"""Queries of the training-data operators, each over its whole table, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, chroma, classifier, filter_audit, licenses, mixing, ngram_join, prefix_trie, secrets, sharding, spotsigs, warc, wfst
from .common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_report(warc.write_and_assemble(table(spark, sf_dir, "pages")))


def op3_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_license_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents")))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(table(spark, sf_dir, "documents"))


def spotsigs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 5: all documents whose spots are alike, through length partitions and pruned Jaccard."""
    return spotsigs.join(table(spark, sf_dir, "documents"))


def op6_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tunes = chroma.melodies(table(spark, sf_dir, "embeddings"))
    return chroma.search(tunes.withColumnRenamed("rec_id", "vec_id"), "vec_id")


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op8_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op10_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_control_case(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.formatted(chat.reconstruct(chat.events_of_turns(turns))))


def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_warc_transactions, op3_secret_guess_cost, op4_license_cosine, op5_spotsigs, op6_chroma_prints, op7_quality_gam, op8_sentencepiece_wfst, op9_ngram_join, op10_chat_events, op11_sampled_splitters, op12_filter_audit, op13_prefix_trie, spotsigs_join)}
ORACLES = {"op1_source_mixing": mixing.ORACLE, "op2_warc_transactions": warc.ORACLE, "op4_license_cosine": licenses.oracle(), "op10_chat_events": chat.ORACLE, "op11_sampled_splitters": sharding.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
