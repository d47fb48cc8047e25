"""Chamber snapshots: nested JSON files of roll calls, verbose or compact, to and from the tables of the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Schema of a snapshot file; either ``votes`` or ``codes`` (with the file's memberIndex) is set.
SCHEMA = """generatedAt string, chamber string, sourceLabel string, sessionRollCallTotal int, memberKeys map<string,string>, keyBy string,
jurisdiction string, legislativeChamber string, members array<struct<key: string, name: string, party: string, district: string>>, memberIndex array<string>,
rollCalls array<struct<id: string, bill: string, title: string, summary: string, summarySource: string, question: string, kind: string, outcome: string,
date: string, dateLabel: string, sourceUrl: string, meaning: string, topics: array<string>, rawVotes: map<string,string>, votes: map<string,string>, codes: string>>"""

# One letter for a position.
LETTERS = {"Y": "yes", "N": "no", "A": "absent", "P": "present"}


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file under ``path`` that has roll calls, with its stem as ``file``. Broken files are skipped."""
    raw = spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    named = raw.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("file"))
    return named.where("rollCalls is not null and _corrupt_record is null").drop("_corrupt_record")


def roll_calls(snapshots: DataFrame) -> DataFrame:
    """file, chamber, position in the file and the roll call's own fields but the votes."""
    rolls = snapshots.select("file", "chamber", F.posexplode("rollCalls").alias("position", "r"))
    return rolls.select("file", "chamber", "position", *[F.col(f"r.{c}").alias({"id": "roll_id", "date": "roll_date"}.get(c, c)) for c in ("id", "bill", "title", "summary", "summarySource", "question", "kind", "outcome", "date", "sourceUrl", "topics")])


def _positions(codes: Column, index: Column) -> Column:
    """Array of (member_key, choice) for a string with a letter a member; other letters are no position."""
    letter = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    pairs = F.zip_with(index, F.split(codes, ""), lambda k, c: F.struct(k.alias("member_key"), F.try_element_at(letter, c).alias("choice")))
    return F.filter(pairs, lambda p: p["choice"].isNotNull() & p["member_key"].isNotNull())


def member_votes(snapshots: DataFrame) -> DataFrame:
    """file, roll_id, member_key, choice of either encoding."""
    rolls = snapshots.select("file", "memberIndex", F.explode("rollCalls").alias("r"))
    verbose = F.transform(F.map_entries("r.votes"), lambda e: F.struct(e["key"].alias("member_key"), e["value"].alias("choice")))
    found = F.when(F.col("r.codes").isNotNull(), _positions(F.col("r.codes"), F.col("memberIndex"))).otherwise(verbose)
    return rolls.select("file", F.col("r.id").alias("roll_id"), F.explode(found).alias("v")).select("file", "roll_id", "v.*")


def decode(compact: DataFrame) -> DataFrame:
    """Positions of rows (roll_id, member_index, codes)."""
    return compact.select("roll_id", F.explode(_positions(F.col("codes"), F.col("member_index"))).alias("v")).select("roll_id", "v.*")


def encode(votes: DataFrame, group: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The compact form of positions (group, roll_id, member_key, choice): roll_id, member_index, codes.

    ``member_index`` has the members of a group (a file: a bounded roster) in numeric, then text order, and ``codes`` a
    letter for each. A repeated position of a member counts once, the first by choice.
    """
    one, many = F.lit(0).alias("__all"), [*group]
    flat = votes.select(*many, *([] if group else [one]), "roll_id", F.col("member_key").cast("string").alias("k"), "choice")
    names = many or ["__all"]
    number = F.coalesce(F.col("k").try_cast("bigint"), F.lit(2**62))
    roster = flat.select(*names, "k").distinct()
    index = roster.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "k"))), lambda s: s["k"]).alias("member_index"))
    letter = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (v, k)])
    first = flat.groupBy(*names, "roll_id", "k").agg(F.min("choice").alias("choice"))
    cast = first.groupBy(*names, "roll_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.try_element_at(letter, F.col("choice"))))).alias("m"))
    codes = F.array_join(F.transform("member_index", lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit("-"))), "")
    return cast.join(index, names).select(*group, "roll_id", "member_index", codes.alias("codes"))


def roster_of(votes: DataFrame, file: str = "file") -> DataFrame:
    """file, member_key, place and size: the members of each file in numeric, then text order, counted from 0.

    A file's roster is its own members' only, so it is bounded by what one file holds, never by all files together.
    """
    names = votes.select(file, F.col("member_key").cast("string").alias("member_key")).where("member_key is not null").distinct()
    order = W.partitionBy(file).orderBy(F.coalesce(F.col("member_key").try_cast("bigint"), F.lit(2**62)), "member_key")
    return names.select(file, "member_key", (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(W.partitionBy(file)).cast("int").alias("size"))


def encode_files(votes: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Two tables for positions (file, roll_id, member_key, choice): the rosters of ``roster_of``, and for each roll its
    ``codes`` (a letter for each member of its file, - for none) and ``runs`` (the same with lengths, as in 3Y12-1N).

    Positions look their place up in the roster of their own file; a roll's letters are laid out from its own positions,
    so rolls never meet the whole roster. A repeated position of a member counts once, the first by choice; null members
    and unknown choices are no position; a roll without any has only dashes.
    """
    roster = roster_of(votes, file)
    letter = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (v, k)])
    first = votes.groupBy(file, "roll_id", F.col("member_key").cast("string").alias("member_key")).agg(F.min("choice").alias("choice"))
    sizes = roster.where("place = 0").select(file, "size")
    placed = first.join(roster.drop("size"), [file, "member_key"], "left")
    spot = F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce(F.try_element_at(letter, F.col("choice")), F.lit("-")).alias("letter")))
    rolls = placed.groupBy(file, "roll_id").agg(F.array_sort(F.collect_list(spot)).alias("spots")).join(sizes, file, "left")
    # Each letter with the dashes before it, joined once: the string isn't copied for every position.
    before = lambda i: F.coalesce(F.get("spots", i - 1)["place"], F.lit(-1))
    laid = F.array_join(F.transform("spots", lambda s, i: F.concat(F.repeat(F.lit("-"), s["place"] - before(i) - 1), s["letter"])), "")
    codes = F.rpad(laid, F.coalesce("size", F.lit(0)), F.lit("-"))
    coded = rolls.select(file, "roll_id", codes.alias("codes"))
    runs = F.transform(F.regexp_extract_all("codes", F.lit(r"(.)\1*"), F.lit(0)), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1)))
    return roster, coded.withColumn("runs", F.array_join(runs, ""))


def decode_files(roster: DataFrame, rolls: DataFrame, form: str = "codes", file: str = "file") -> DataFrame:
    """file, roll_id, member_key, choice of rolls in the form ``codes`` or ``runs``, with the rosters of their files."""
    letter = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    if form == "codes":
        each = rolls.select(file, "roll_id", F.posexplode(F.split("codes", "")).alias("place", "letter"))
    else:
        n = lambda r: F.regexp_extract(r, "^[0-9]+", 0).cast("int")
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int,letter:string>>").alias("out"))
        step = lambda acc, r: F.struct((acc["at"] + n(r)).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), n(r).alias("n"), F.right(r, F.lit(1)).alias("letter"))).alias("out"))
        spans = F.aggregate(F.regexp_extract_all("runs", F.lit("[0-9]+[^0-9]"), F.lit(0)), begin, step, lambda acc: acc["out"])
        # Spans are a column before they are dealt out, by an outer explode: Spark puts a filter below an inner one that makes them again.
        run = rolls.select(file, "roll_id", spans.alias("spans")).select(file, "roll_id", F.explode_outer("spans").alias("s")).where("s.letter <> '-'")
        each = run.select(file, "roll_id", F.explode(F.sequence(F.col("s.at"), F.col("s.at") + F.col("s.n") - 1)).alias("place"), F.col("s.letter").alias("letter"))
    known = each.select(file, "roll_id", "place", F.try_element_at(letter, F.col("letter")).alias("choice")).where("choice is not null")
    return known.join(roster.select(file, "place", "member_key"), [file, "place"]).select(file, "roll_id", "member_key", "choice")


def add_summaries(rolls: DataFrame, notes: DataFrame) -> DataFrame:
    """Fill summaries that are missing or repeat the title from ``notes`` (note_key, note_title, note, as_of).

    ``rolls`` has juris, bill, title, summary, roll_date. The key with the title wins over the key of the bill alone;
    a note counts only if its title is the roll's, and a note on another day's version says so.
    """
    from ..functions.text import date_label, norm_title

    bill, full = F.concat_ws(":", "juris", "bill"), F.concat(F.concat_ws(":", "juris", "bill"), F.lit("|"), norm_title(F.col("title")))
    one, two = (notes.select(F.col("note_key").alias(f"__k{i}"), F.struct("note_title", "note", "as_of").alias(f"__n{i}")) for i in (1, 2))
    joined = rolls.join(one, full == F.col("__k1"), "left").join(two, bill == F.col("__k2"), "left").withColumn("__n", F.coalesce("__n1", "__n2"))
    other = F.col("__n.as_of").isNotNull() & (F.col("__n.as_of") != F.col("roll_date")) & ~F.startswith(F.col("__n.note"), F.lit("As "))
    text = F.when(other, F.concat(F.lit("On the version voted "), date_label(F.col("__n.as_of")), F.lit(": "), F.col("__n.note"))).otherwise(F.col("__n.note"))
    use = (F.col("summary").isNull() | (F.col("summary") == F.col("title"))) & (norm_title(F.col("__n.note_title")) == norm_title(F.col("title")))
    use = F.coalesce(use, F.lit(False))
    return joined.select(*[c for c in rolls.columns if c != "summary"], F.when(use, text).otherwise(F.col("summary")).alias("summary"), F.when(use, "ai").alias("summary_source"))


def merged(ingested: DataFrame, curated: DataFrame, key: Column) -> DataFrame:
    """Ingested rows and the curated rows whose key is not among theirs."""
    extra = curated.withColumn("__key", key).join(ingested.select(key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")
    return ingested.unionByName(extra, allowMissingColumns=True)


def last_file_wins(rows: DataFrame, key: list[str], file: str = "file") -> DataFrame:
    """The row of the last file for each key, in one aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(file)).alias("s")).select(*key, *[F.col(f"s.{c}").alias(c) for c in rest])


def carry_forward(new: DataFrame, old: DataFrame, key: str = "roll_id") -> DataFrame:
    """Keep a prior summary and its source where the new row has none."""
    before = old.select(key, F.col("summary").alias("__s"), F.col("summary_source").alias("__p"))
    lacking = F.col("summary").isNull()
    out = new.join(before, key, "left")
    return out.withColumns({"summary": F.coalesce("summary", "__s"), "summary_source": F.when(lacking & F.col("__s").isNotNull(), F.col("__p")).otherwise(F.col("summary_source"))}).drop("__s", "__p")


def _files(spark: SparkSession, path: str):
    """Hadoop's Path below ``path`` and the file system it is in."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return lambda name: spark._jvm.org.apache.hadoop.fs.Path(root, name), root.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_version(rows: DataFrame, path: str) -> str:
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path.rstrip('/')}/{version}")
    return version


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer of ``path`` name ``version``; one rename."""
    at, fs = _files(spark, path)
    out = fs.create(at(f"{version}.pointer"), True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(version).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(at(f"{version}.pointer")), fs.makeQualified(at("current.pointer")), options)


def publish(rows: DataFrame, path: str) -> str:
    """Write ``rows`` as a new version below ``path`` and point to it last, so readers see the old rows or the new ones,
    and a failed run leaves the old ones in place. The pointer is one small file, replaced by a rename; the version
    before it stays for readers that have begun. Returns the version's folder; ``published`` reads the current one."""
    version = _write_version(rows, path)
    _point(rows.sparkSession, path, version)
    return f"{path.rstrip('/')}/{version}"


class Refused(ValueError):
    """A publication that broke rules; ``counts`` has the number of rows for each broken rule."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("not published: " + ", ".join(f"{rule} ({n})" for rule, n in sorted(counts.items())))
        self.counts = counts


# Kinds of rolls, legal positions, provenances of a summary and hosts of the federal and New York sources.
ROLL_KINDS = ["substantive", "procedural"]
CHOICES = ["yes", "no", "absent", "present"]
PROVENANCE = ["official", "ai"]
OFFICIAL_HOST = r"(^|\.)(house\.gov|senate\.gov|nysenate\.gov|nyassembly\.gov|council\.nyc\.gov)$"


def snapshot_rules() -> dict[str, Column]:
    """What must hold for each roll call of a snapshot, by name. Rows have chamber, source_label, generated_at, key_by,
    roll_id, roll_date (text), title, bill, outcome, kind, source_url, votes (array of choices), summary, summary_source."""
    from ..functions.text import is_official_source

    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    host = F.coalesce(F.try_parse_url(F.col("source_url"), F.lit("HOST")), F.lit(""))
    federal = F.startswith(F.lower("source_url"), F.lit("https://")) & F.lower(host).rlike(OFFICIAL_HOST)
    return {
        "snapshot metadata": said("chamber") & said("source_label") & F.col("generated_at").try_cast("timestamp").isNotNull(),
        "roll-call id": said("roll_id"),
        "real date": F.col("roll_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("roll_date").try_cast("date").isNotNull(),
        "date not in the future": F.col("roll_date") <= F.substring("generated_at", 1, 10),
        "title, bill and outcome": said("title") & said("bill") & said("outcome"),
        "kind": F.col("kind").isin(ROLL_KINDS),
        "official source": F.when(F.col("key_by").eqNullSafe("openstates"), is_official_source(F.col("source_url"))).otherwise(federal),
        "legal positions": (F.size("votes") > 0) & F.forall("votes", lambda v: F.coalesce(v.isin(CHOICES), F.lit(False))),
        "summary provenance": (F.coalesce("summary", F.lit("")) == "") | F.col("summary_source").isin(PROVENANCE),
    }


REPEATED, EMPTY = "unique id", "not empty"


def snapshot_violations(rolls: DataFrame) -> DataFrame:
    """rule, file, roll_id of each broken rule; a repeated id of a file is one row, whatever the number of its rolls.

    Null fields break the rules that ask for them; null votes are none; ids that are missing are not repeated ones; an
    empty table breaks no rule here, but can't be published; further columns are not used.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in snapshot_rules().items()]))
    each = rolls.select(F.explode(broken).alias("rule"), "file", "roll_id")
    again = rolls.where("coalesce(roll_id, '') <> ''").groupBy("file", "roll_id").count().where("count > 1")
    return each.unionByName(again.select(F.lit(REPEATED).alias("rule"), "file", "roll_id"))


def publish_checked(rolls: DataFrame, path: str) -> str:
    """Publish a snapshot only if it breaks no rule: rules are counted by the write itself, repeated ids from the ids that
    it wrote, and the pointer moves only if all counts are zero; else the version goes and ``Refused`` tells the counts.

    One pass over the rows and one shuffle of their ids. A retried task may count a broken row twice, never a right one.
    """
    from pyspark.sql import Observation

    spark, watch = rolls.sparkSession, Observation()
    counted = [F.count(F.when(~F.coalesce(test, F.lit(False)), 1)).alias(name) for name, test in snapshot_rules().items()]
    version = _write_version(rolls.observe(watch, F.count(F.lit(1)).alias(EMPTY), *counted), path)
    counts = dict(watch.get)
    ids = spark.read.parquet(f"{path.rstrip('/')}/{version}").select("file", "roll_id").where("coalesce(roll_id, '') <> ''")
    counts[REPEATED] = ids.groupBy("file", "roll_id").count().where("count > 1").count()
    counts[EMPTY] = int(counts[EMPTY] == 0)
    if any(counts.values()):
        at, fs = _files(spark, path)
        fs.delete(at(version), True)
        raise Refused({rule: n for rule, n in counts.items() if n})
    _point(spark, path, version)
    return f"{path.rstrip('/')}/{version}"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that ``path`` points to."""
    version = spark.read.text(f"{path.rstrip('/')}/current.pointer", wholetext=True).first()
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version[0].strip()}")


def csv_rows(spark: SparkSession, path: str, strict: bool = False, **options: str) -> DataFrame:
    """Delimited files with a header: quoted commas, newlines and doubled quotes; short rows padded with '' (lenient)
    or dropped (strict). Options go to the reader, for instance sep, quote and nullValue of tab or pipe files."""
    read = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "DROPMALFORMED" if strict else "PERMISSIVE").options(**options)
    rows = read.csv(path)
    return rows if strict else rows.fillna("")


def delimited(lines: DataFrame, column: str, names: list[str], strict: bool = False, pad: str | None = "", **options: str) -> DataFrame:
    """The fields ``names`` of delimited lines in a column, beside the other columns; options as for ``csv_rows``. Short
    lines are padded with ``pad`` (null: not), or under ``strict`` go like all of another width."""
    odd = "_corrupt_record"
    schema = ", ".join(f"`{n}` string" for n in (*names, odd))
    parsed = F.from_csv(F.col(column), schema, {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": odd, **options})
    rows = lines.withColumn("__f", parsed)
    rows = rows.where(F.col(f"__f.{odd}").isNull()) if strict else rows
    value = lambda n: F.col(f"__f.`{n}`") if pad is None else F.coalesce(F.col(f"__f.`{n}`"), F.lit(pad))
    return rows.select(*[c for c in lines.columns if c != column], *[value(n).alias(n) for n in names])


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements ``tag`` of XML files as rows."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def senator_seats(terms: DataFrame) -> DataFrame:
    """Seat number 1 or 2 of each senator by seniority: first start, then name. ``terms``: state, member_key, name, start."""
    first = terms.groupBy("state", "member_key", "name").agg(F.min("start").alias("start"))
    return first.withColumn("seat", F.row_number().over(W.partitionBy("state").orderBy("start", "name", "member_key")))
