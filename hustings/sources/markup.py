"""Tables, lists and votes of official pages: a pull parser over markup, and the layouts of named sources on top of it.

Python only turns one page's markup into events and those into small rows; pages are dealt out by Spark, and everything
after the cells (grids, records, joins) is DataFrame work. XML is parsed by Spark itself.

Cases: null and empty bodies give no rows; very long pages are fed to the parser in pieces and their cells leave as they
close; unclosed cells, rows and tables end where markup says they must; broken attributes count as 1; rows that repeat a
key are parsed each; empty tables give no rows; further columns are not used.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are fed to the parser at once.
PIECE = 1 << 16
#: Limits that browsers put on spans; a rowspan of 0 reaches to the end of its table.
MAX_COLS, MAX_ROWS = 1000, 65534
_HIDDEN = {"script", "style", "template"}
_BREAKS = {"br", "p", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "ul", "ol", "table"}


class _Pull(HTMLParser):
    """Collects events; ``events`` takes them out after each piece."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, dict[str, str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        self.found.append(("start", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0
        self.found.append(("end", tag, {}))

    def handle_startendtag(self, tag, attrs):
        self.found += [("start", tag, {k: v or "" for k, v in attrs}), ("end", tag, {})]

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(("text", data, {}))


#: Markup that is read alike by any parser: tags whose attributes, if any, have plain values, and the text between tags.
_PLAIN = re.compile(
    r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_:][a-zA-Z0-9_:.-]*=(?:"[^"&]*"|'[^'&]*'|[a-zA-Z0-9_%.-]+(?=[ \t\n\r\f>])))*)[ \t\n\r\f]*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)>|([^<]+)"""
)
_PAIR = re.compile(r"""([a-zA-Z_:][a-zA-Z0-9_:.-]*)=(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f]+))""")
#: Elements whose content is no markup, or is left out: from there on the pull parser reads.
_RAW = _HIDDEN | {"textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


@lru_cache(4096)
def _attributes(said: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in _PAIR.findall(said)}


def events(markup: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(start, tag, attributes), (end, tag, {}) and (text, characters, {}) of a page, in order; comments, scripts and
    styles are left out and character references are characters. A text is one event, however long it is.

    Plain markup is cut by one pattern; from the first place that is not plain the pull parser reads the rest.
    """
    at = 0
    none: dict[str, str] = {}
    while found := _PLAIN.match(markup, at):
        kind = found.lastindex
        if kind == 5:
            yield "text", unescape(text) if "&" in (text := found[5]) else text, none
        elif kind == 4:
            yield "end", found[4].lower(), none
        else:
            tag = found[1].lower()
            if tag in _RAW:
                break
            yield "start", tag, _attributes(found[2]) if found[2] else none
            if found[3]:
                yield "end", tag, none
        at = found.end()
    if at < len(markup):
        yield from _pulled(markup, at)


def _pulled(markup: str, begin: int) -> Iterator[tuple[str, str, dict[str, str]]]:
    """The events from ``begin`` on, by the pull parser. A text that ends with a piece goes on in the next one."""
    parser = _Pull()
    text: list[str] = []
    for at in range(begin, len(markup) + PIECE, PIECE):
        if at < len(markup):
            parser.feed(markup[at : at + PIECE])
        else:
            parser.close()
        found, parser.found = parser.found, []
        for event in found:
            if event[0] == "text":
                text.append(event[1])
                continue
            if text:
                yield "text", "".join(text), {}
                text = []
            yield event
    if text:
        yield "text", "".join(text), {}


def _span(value: str | None, most: int) -> int:
    digits = re.match(r"\s*\+?(\d+)", value or "")
    n = int(digits[1][:9]) if digits else 1
    return min(n, most)


class _Table:
    def __init__(self, number: int, parent: int | None) -> None:
        self.number, self.parent, self.row, self.col = number, parent, -1, 0
        self.open = False
        self.below: dict[int, int] = {}
        self.taken: set[int] = set()
        self.cell: tuple | None = None
        self.text: list[str] = []

    def start_row(self) -> None:
        self.row, self.col, self.open = self.row + 1, 0, True
        self.taken = {c for c, n in self.below.items() if n > 0}
        self.below = {c: n - 1 for c, n in self.below.items() if n > 1}

    def start_cell(self, header: bool, attrs: dict[str, str]) -> None:
        if not self.open:
            self.start_row()
        while self.col in self.taken:
            self.col += 1
        cols = max(1, _span(attrs.get("colspan"), MAX_COLS))
        rows = _span(attrs.get("rowspan"), MAX_ROWS) or MAX_ROWS
        self.cell, self.text = (self.row, self.col, rows, cols, header), []
        if rows > 1:
            self.below.update(dict.fromkeys(range(self.col, self.col + cols), rows - 1))
        self.col += cols

    def end_cell(self) -> Iterator[tuple]:
        if self.cell:
            row, col, rows, cols, header = self.cell
            yield self.number, self.parent, row, col, rows, cols, header, " ".join("".join(self.text).split())
        self.cell = None


def cells(markup: str) -> Iterator[tuple]:
    """(table, parent, row, col, rowspan, colspan, header, text) of each cell as it closes. Tables are numbered as they
    open; ``parent`` is the table a nested one lies in; a cell's text leaves out the tables within it."""
    tables: list[_Table] = []
    n = 0
    for kind, what, attrs in events(markup):
        top = tables[-1] if tables else None
        if kind == "text":
            if top and top.cell:
                top.text.append(what)
            continue
        if top and top.cell and what in _BREAKS:
            top.text.append(" ")
        if kind == "start" and what == "table":
            tables.append(_Table(n, top.number if top else None))
            n += 1
        elif top and what in ("tr", "tbody", "thead", "tfoot"):
            yield from top.end_cell()
            top.open = False
            if kind == "start" and what == "tr":
                top.start_row()
        elif top and what in ("td", "th"):
            yield from top.end_cell()
            if kind == "start":
                top.start_cell(what == "th", attrs)
        elif top and kind == "end" and what == "table":
            yield from tables.pop().end_cell()
    while tables:
        yield from tables.pop().end_cell()


def parsed(bodies: DataFrame, key: str, body: str, read: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """``key`` and the ``fields`` (as in a schema) of each row that ``read`` finds in a body, in bounded batches."""
    schema = bodies.sparkSession.createDataFrame([], fields).schema
    kind = bodies.schema[key].dataType.simpleString()
    names = [key, *schema.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]
        for b in batches:
            held: list[tuple] = []
            emit = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], b.schema.field(key).type), *[pa.array([r[i + 1] for r in held], t) for i, t in enumerate(types)]], names=names)  # noqa: B023, E731
            for at in range(b.num_rows):
                k, text = b.column(key)[at].as_py(), b.column(body)[at].as_py()
                for row in read(text or ""):
                    held.append((k, *row))
                    if len(held) == 5000:
                        yield emit()
                        held = []
            if held:
                yield emit()

    return bodies.select(key, body).mapInArrow(run, f"`{key}` {kind}, {fields}")


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, parent, row, col, rowspan, colspan, header and text of each cell of all tables of all pages."""
    return parsed(pages, key, html, cells, "table int, parent int, row int, col int, rowspan int, colspan int, header boolean, text string")


def grid(found: DataFrame, key: str) -> DataFrame:
    """key, table, row, col, header, text: each cell at every place it spans, down to the table's last row."""
    last = found.groupBy(key, "table").agg(F.max("row").alias("last"))
    rows = found.join(last, [key, "table"]).withColumn("row", F.explode(F.sequence("row", F.least("last", F.col("row") + F.col("rowspan") - 1))))
    return rows.withColumn("col", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1))).select(key, "table", "row", "col", "header", "text")


def table_records(found: DataFrame, key: str) -> DataFrame:
    """key, table, row, ``record``: the rows below a table's first one as maps from that one's texts (the first column of
    a name counts)."""
    places = grid(found, key)
    names = places.where("row = 0").groupBy(key, "table", F.col("text").alias("name")).agg(F.min("col").alias("col")).where("name <> ''")
    each = places.where("row > 0").join(names, [key, "table", "col"])
    return each.groupBy(key, "table", "row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "text")))).alias("record"))


# Layouts of named sources.

HOUSE = """`vote-metadata` struct<`rollcall-num`: string, `legis-num`: string, `vote-question`: string, `vote-type`: string, `vote-result`: string, `action-date`: string, `vote-desc`: string,
  `vote-totals`: struct<`totals-by-vote`: struct<`yea-total`: string, `nay-total`: string>>>,
`vote-data` struct<`recorded-vote`: array<struct<legislator: struct<`_name-id`: string, _VALUE: string>, vote: string>>>"""


def _once(files: DataFrame, key: str, read: Column) -> DataFrame:
    """key and x, the parsed file. As the row of a generator it is made once a file: filters and fields of a plain column
    are pushed below it, where each of them would parse the file again."""
    return files.select(key, F.explode(F.array(read)).alias("x"))


def _positions(kept: DataFrame, fields: list[str], array: str, name: Column, raw: Column) -> DataFrame:
    return kept.select(*fields, F.explode(array).alias("v")).select(*fields, name.alias("name"), F.trim(raw).alias("raw")).where("name is not null and raw is not null")


def us_house_lines(files: DataFrame, key: str = "roll_id", body: str = "body") -> DataFrame:
    """Positions of ``us_house`` beside the fields of their roll call, from one reading of each file."""
    rolls = _house(files, key, body)
    return _positions(rolls, [c for c in rolls.columns if c != "of"], "of", F.col("v.legislator")["_name-id"], F.col("v.vote"))


def _house(files: DataFrame, key: str, body: str) -> DataFrame:
    x = _once(files, key, F.from_xml(body, HOUSE, {"attributePrefix": "_"}))
    m = F.col("x.vote-metadata")
    election = F.lower(m["vote-question"]).rlike("^election of the speaker") | (F.upper(m["vote-type"]) == "ELECTION")
    kept = x.where(m["rollcall-num"].isNotNull() & ~F.coalesce(election, F.lit(False)))
    totals = m["vote-totals"]["totals-by-vote"]
    return kept.select(key, m["legis-num"].alias("bill"), m["vote-question"].alias("question"), m["vote-result"].alias("result"), totals["yea-total"].try_cast("long").alias("printed_yes"), totals["nay-total"].try_cast("long").alias("printed_no"), F.col("x.vote-data.recorded-vote").alias("of"))


def us_house(files: DataFrame, key: str = "roll_id", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Roll calls (key, bill, question, result, printed_yes, printed_no) and positions (key, name, raw) of the clerk's XML.
    Elections, whose positions are candidates' names, are no roll calls; totals are those of the whole vote, not a party's."""
    return _house(files, key, body).drop("of"), us_house_lines(files, key, body).select(key, "name", "raw")


SENATE = """vote_number string, vote_date string, vote_question_text string, vote_result string, document struct<document_name: string>, count struct<yeas: string, nays: string>, members struct<member: array<struct<lis_member_id: string, vote_cast: string>>>"""


def us_senate_lines(files: DataFrame, key: str = "roll_id", body: str = "body") -> DataFrame:
    """Positions of ``us_senate`` beside the fields of their roll call, from one reading of each file."""
    rolls = _senate(files, key, body)
    return _positions(rolls, [c for c in rolls.columns if c != "of"], "of", F.col("v.lis_member_id"), F.col("v.vote_cast"))


def _senate(files: DataFrame, key: str, body: str) -> DataFrame:
    x = _once(files, key, F.from_xml(body, SENATE)).withColumn("day", F.to_date(F.try_to_timestamp(F.regexp_extract("x.vote_date", r"([A-Za-z]+ \d+, *\d{4})", 1), F.lit("MMMM d, yyyy"))))
    kept = x.where("day is not null")
    return kept.select(key, F.col("x.document.document_name").alias("bill"), F.col("x.vote_question_text").alias("question"), F.col("x.vote_result").alias("result"), F.col("day").alias("roll_date"), F.col("x.count.yeas").try_cast("long").alias("printed_yes"), F.col("x.count.nays").try_cast("long").alias("printed_no"), F.col("x.members.member").alias("of"))


def us_senate(files: DataFrame, key: str = "roll_id", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Roll calls (key, bill, question, result, roll_date, printed_yes, printed_no) and positions (key, name, raw) of a vote's
    XML. A date is written out ('June 24, 2026, 05:31 PM'); a vote without a readable one is left out."""
    return _senate(files, key, body).drop("of"), us_senate_lines(files, key, body).select(key, "name", "raw")


def _by_class(markup: str) -> Iterator[tuple[str, str, str]]:
    """(class, href, text) of each element's own text: the innermost class and the last link opened before it."""
    open_: list[tuple[str, str]] = []
    href = ""
    for kind, what, attrs in events(markup):
        if kind == "start" and what not in ("br", "img", "input", "meta", "link", "hr"):
            href = attrs.get("href", href) if what == "a" else href
            open_.append((what, attrs.get("class", open_[-1][1] if open_ else "")))
        elif kind == "end":
            while open_ and open_.pop()[0] != what:
                pass
        elif kind == "text" and what.strip():
            yield open_[-1][1] if open_ else "", href, " ".join(what.split())


def _senators(markup: str) -> Iterator[tuple]:
    """A name, its parties in parentheses, then the ordinal of the district."""
    name = party = path = None
    for cls, href, text in _by_class(markup):
        if "nys-senator--name" in cls:
            name, path, party = text, href, None
        elif "nys-senator--party" in cls and (found := re.search(r"\(([^)]*)\)", text)):
            party = found[1]
        if name and party is not None and (found := re.search(r"(\d+)(?:st|nd|rd|th) District", text)):
            yield found[1], name, party.split(",")[0].strip(), path
            name = party = None


def _assembly(markup: str) -> Iterator[tuple]:
    """A linked name, then its district in the same element."""
    name = path = None
    for cls, href, text in _by_class(markup):
        found = re.fullmatch(r"District (\d+)", text)
        if found and name:
            yield found[1], name, None, path
            name = None
        elif "mem-name" in cls and href.startswith("/mem/"):
            name, path = text, href


ROSTERS = {"ny-senate": _senators, "ny-assembly": _assembly}


def ny_roster(pages: DataFrame, source: str, key: str = "page_id", body: str = "body") -> DataFrame:
    """key, district, name, party (null where the page doesn't tell) and path of each member that a chamber's page lists."""
    return parsed(pages, key, body, ROSTERS[source], "district string, name string, party string, path string")


def _floor_votes(markup: str) -> Iterator[tuple]:
    """Captions with date and tally, each followed by pairs of mark and name, up to the next heading after the votes'."""
    said, inside, caption, mark, roll = "", False, None, None, -1
    vote: tuple = ()
    stack: list[str] = []
    for kind, what, attrs in events(markup):
        if kind == "start":
            if what == "h3":
                if inside:
                    return
                said = ""
            if inside and what == "caption":
                caption = ""
            stack.append(attrs.get("class", "")) if what == "div" else None
        elif kind == "end":
            if what == "h3":
                inside = "".join(said.split()).replace("\xa0", "").startswith("FloorVotes:")
            elif what == "caption" and caption is not None:
                day, tally = re.search(r"DATE:\s*(\d{2})/(\d{2})/(\d{4})", caption), re.search(r"YEA/NAY:\s*(\d+)\s*/\s*(\d+)", caption)
                roll, vote = (roll + 1, (f"{day[3]}-{day[1]}-{day[2]}", int(tally[1]), int(tally[2]), bool(re.search(r"Assembly\s*Vote", caption, re.I)))) if day and tally else (roll, ())
                caption = mark = None
            elif what == "div" and stack:
                stack.pop()
        else:
            said += what
            if caption is not None:
                caption += what
            elif inside and vote and stack and what.strip():
                if stack[-1] == "vote":
                    mark = what.strip()
                elif stack[-1] == "name" and mark is not None:
                    yield (roll, *vote, " ".join(what.split()), mark)
                    mark = None


def floor_votes(pages: DataFrame, key: str = "page_id", body: str = "body") -> DataFrame:
    """key, roll (from 0), roll_date, printed_yes, printed_no, assembly, name and raw of the positions of a bill's page."""
    found = parsed(pages, key, body, _floor_votes, "roll int, day string, printed_yes long, printed_no long, assembly boolean, name string, raw string")
    return found.withColumn("roll_date", F.col("day").try_cast("date")).drop("day")


def csv_lines(files: DataFrame, names: list[str], key: str = "file", body: str = "body", strict: bool = True) -> DataFrame:
    """key, line (from 1) and the texts ``names`` of a delimited file with a header, quotes, doubled quotes and quoted newlines.
    Lines of another width than the header go under ``strict`` and are padded with empty texts otherwise."""

    def read(text: str) -> Iterator[tuple]:
        rows = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
        head = next(rows, [])
        at = [head.index(n) if n in head else -1 for n in names]
        for line, row in enumerate((r for r in rows if r), 1):
            if not strict or len(row) == len(head):
                yield line, *[row[i] if 0 <= i < len(row) else "" for i in at]

    return parsed(files, key, body, read, ", ".join(["line long", *(f"`{n}` string" for n in names)]))
