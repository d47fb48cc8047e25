"""Editorial content kept as JSON files: races, biographies, people, pairs of statements; and JSON in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CITED = "struct<text: string, sources: array<string>>"
BIO = f"slug string, name string, summary array<{CITED}>, paragraphs array<array<{CITED}>>, sources array<struct<id: string, url: string, title: string, publisher: string, kind: string, date: string>>, researchedAt string, factChecked boolean"
VERIFICATION = "raceId string, checkedAt string, claimsChecked long, corrected long, removed long, unverifiable long, notes array<string>"
PAIR = "id string, officialId string, status string, reviewedBy string, reviewedAt string, notes string, said struct<text: string, sourceUrl: string, date: string>, did struct<text: string, sourceUrl: string, date: string>"
RACE = f"""id string, state string, officeType string, district string, title string,
candidates array<struct<id: string, name: string, parties: array<string>, incumbent: boolean, positions: array<struct<issue: string, stance: string, summary: string, basis: string, sources: array<string>>>>>,
sources array<struct<id: string, url: string, title: string, publisher: string, kind: string, date: string>>"""


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each whole-file JSON document, with the file's stem as ``file``; a missing path is an empty table and
    broken documents are left out."""
    try:
        raw = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        return raw.select("*", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("file")).where("_corrupt_record is null").drop("_corrupt_record")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + ", file string")


def races(spark: SparkSession, path: str) -> DataFrame:
    return json_files(spark, path, RACE).where("id is not null")


def bio(bios: DataFrame, slug: str) -> DataFrame:
    """The biography of one person; an address that is no slug finds nothing."""
    return bios.where((F.col("slug") == slug) & F.lit(slug).rlike("^[a-z0-9-]+$"))


def positions(race_files: DataFrame) -> DataFrame:
    """race_id, cand_id, name and the fields of each position."""
    c = race_files.select(F.col("id").alias("race_id"), F.explode("candidates").alias("c"))
    return c.select("race_id", F.col("c.id").alias("cand_id"), F.col("c.name").alias("name"), F.explode("c.positions").alias("p")).select("race_id", "cand_id", "name", "p.*")


def reviewed_pairs(pairs: DataFrame, official: str | None = None) -> DataFrame:
    """Reviewed pairs without the reviewers' fields. A pair that says reviewed without saying by whom and when is a
    draft; files whose name starts with an underscore are templates."""
    status = F.when((F.col("status") == "reviewed") & (F.col("reviewedBy").isNull() | F.col("reviewedAt").isNull()), "draft").otherwise(F.col("status"))
    rows = pairs.where(~F.startswith("file", F.lit("_"))).withColumn("status", status).where("status = 'reviewed'")
    return (rows if official is None else rows.where(F.col("officialId") == official)).drop("reviewedBy", "reviewedAt", "notes")


def sitemap(static: list[str], **lists: DataFrame) -> DataFrame:
    """url of all pages: fixed ones and a folder for each table (its first column)."""
    spark = next(iter(lists.values())).sparkSession
    out = spark.range(1).select(F.explode(F.array(*map(F.lit, static))).alias("url"))
    for folder, rows in lists.items():
        out = out.unionByName(rows.select(F.concat(F.lit(f"/{folder}/"), F.url_encode(F.col(rows.columns[0]).cast("string"))).alias("url")))
    return out.distinct()


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


# Words that a neutral text leaves out, hosts that may not be cited, kinds of source.
LOADED = r"\b(common[- ]sense|extreme|radical|controversial|far-left|far-right|disgraced|hypocrit\w*|flip-flop\w*|beloved|tireless|champion of|staunch)\b"
GUIDE_LOADED = r"(?i)\b(extreme|radical|common[- ]sense|controversial|far-left|far-right|disgraced|hypocrit\w*|flip-flop\w*)\b"
BAD_HOST = r"(?i)ballotbrief|isidewith|predictionedge"
KINDS = ["official", "candidate", "news", "reference"]


def loaded(text: Column, words: str = LOADED) -> Column:
    """Whether a text holds loaded words: those of biographies as they are written, those of the guide in any case."""
    return F.coalesce(text, F.lit("")).rlike(words)


def bio_violations(bios: DataFrame) -> DataFrame:
    """slug, rule for each broken rule of a biography: counts, lengths, dates, sources and citations."""
    none = F.array().cast(f"array<{CITED}>")
    cited = F.concat(F.coalesce("summary", none), F.flatten(F.coalesce("paragraphs", F.array().cast(f"array<array<{CITED}>>"))))
    ids = F.transform(F.coalesce("sources", F.array().cast("array<struct<id: string, url: string, title: string, publisher: string, kind: string, date: string>>")), lambda s: s["id"])
    used = F.flatten(F.transform(cited, lambda c: F.coalesce(c["sources"], F.array().cast("array<string>"))))
    each = lambda test: F.forall(F.coalesce("sources", F.array().cast("array<struct<id: string, url: string, title: string, publisher: string, kind: string, date: string>>")), test)
    day = r"^\d{4}-\d{2}-\d{2}$"
    rules = {
        "slug is the file's name": F.col("slug") == F.col("file"),
        "one to three summary sentences": F.size("summary").between(1, 3),
        "at most eight paragraphs": F.coalesce(F.size("paragraphs"), F.lit(-1)).between(0, 8),
        "one to ten sentences a paragraph": F.forall(F.coalesce("paragraphs", F.array().cast(f"array<array<{CITED}>>")), lambda p: F.size(p).between(1, 10)),
        "texts of at most 900 characters": F.forall(cited, lambda c: F.length(c["text"]).between(1, 900)),
        "no loaded language": ~F.exists(cited, lambda c: loaded(c["text"])),
        "every sentence cites": F.forall(cited, lambda c: F.size(F.coalesce(c["sources"], F.array().cast("array<string>"))) > 0),
        "citations exist": F.size(F.array_except(used, ids)) == 0,
        "sources are cited": F.size(F.array_except(ids, used)) == 0,
        "whole sources": each(lambda s: s["id"].isNotNull() & s["url"].rlike("^https?://") & s["title"].isNotNull() & s["publisher"].isNotNull() & s["kind"].isin(KINDS)),
        "no banned host": each(lambda s: ~F.coalesce(s["url"], F.lit("")).rlike(BAD_HOST)),
        "encyclopedia pages have a date": each(lambda s: ~F.coalesce(s["url"], F.lit("")).rlike("(?i)wikipedia\\.org") | F.coalesce(s["date"], F.lit("")).rlike(day)),
        "research day": F.col("researchedAt").rlike(day),
    }
    from ..operators.quality import violations

    return violations(bios, "slug", rules)


def verification_totals(files: DataFrame) -> DataFrame:
    cols = ("claimsChecked", "corrected", "removed", "unverifiable")
    return files.agg(F.count(F.lit(1)).alias("races"), *[F.sum(c).alias(c) for c in cols])
