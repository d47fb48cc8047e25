"""The pull parser against hand-made pages, odd markup and a plain grid; layouts of sources on faulty files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hustings.sources import markup


def found(html):
    return [(t, p, r, c, rs, cs, h, x) for t, p, r, c, rs, cs, h, x in markup.cells(html)]


def test_spans_nesting_and_references():
    html = """<table><caption>no cell</caption><tr><th rowspan=2>A &amp; B<th colspan="2">C<br>D</tr><tr><td>1<td>2<tr><td rowspan=0>x</td><td><table><tr><td>in&#x2d;ner</table>out</td>
      <td><script>var t = "<td>no</td>";</script><!-- <td> --> y&nbsp;z</td></tr><tr><td>last</table> after"""
    assert found(html) == [
        (0, None, 0, 0, 2, 1, True, "A & B"), (0, None, 0, 1, 1, 2, True, "C D"), (0, None, 1, 1, 1, 1, False, "1"), (0, None, 1, 2, 1, 1, False, "2"), (0, None, 2, 0, markup.MAX_ROWS, 1, False, "x"),
        (1, 0, 0, 0, 1, 1, False, "in-ner"), (0, None, 2, 1, 1, 1, False, "out"), (0, None, 2, 2, 1, 1, False, "y z"), (0, None, 3, 1, 1, 1, False, "last"),
    ]


def test_broken_markup_ends():
    assert found("<td>stray</td>") == [] and found("") == [] and found("<table><tr><td") == []
    assert [x[-1] for x in found("<table><td>a<td colspan=99999999999 rowspan=x>b</tr></tr><tr><table></table><td>c")] == ["a", "b", "c"]
    assert [x[5] for x in found("<table><tr><td colspan=99999999999>b<td colspan=0>c<td colspan=-3>d")] == [1000, 1, 1]
    assert [x[-1] for x in found("<table>" + "<tr><td>" * 50_000)] == [""] * 50_000


def test_grid_against_a_plain_one(spark):
    rng = random.Random(1)
    pages, want = [], set()
    for page in range(30):
        html, taken, at = "<table>", {}, {}
        rows = rng.randrange(1, 6)
        for r in range(rows):
            html += "<tr>"
            c = 0
            for _ in range(rng.randrange(4)):
                while (r, c) in taken:
                    c += 1
                cs, rs = rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4])
                name = f"{r}.{c}"
                html += f'<td colspan="{cs}" rowspan="{rs}">{name}'
                for i in range(r, r + rs):
                    for j in range(c, c + cs):
                        taken[i, j] = True
                        at.setdefault((i, j), []).append(name)
                c += cs
        last = max((int(n.split(".")[0]) for v in at.values() for n in v), default=-1)
        want |= {(page, i, j, n) for (i, j), names in at.items() for n in names if i <= last}
        pages.append((page, html))
    cells = markup.table_cells(spark.createDataFrame(pages, "page long, html string").withColumn("table", F.lit("x")), "page", "html")
    assert {(r.page, r.row, r.col, r.text) for r in markup.grid(cells, "page").collect()} == want


def test_records_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>name<th>vote<tr><td>A<td>Yes<tr><td>B<td>No</table>"), (2, None), (3, "")], "page long, html string")
    cells = markup.table_cells(pages, "page", "html")
    assert {(r.row, r.record["name"], r.record["vote"]) for r in markup.table_records(cells, "page").collect()} == {(1, "A", "Yes"), (2, "B", "No")}
    assert markup.table_cells(pages.limit(0), "page", "html").collect() == []


def test_layouts_take_odd_files(spark):
    bodies = spark.createDataFrame([(1, None), (2, ""), (3, "<x>"), (4, "<rollcall-vote><vote-metadata><rollcall-num>4</rollcall-num></vote-metadata><vote-data><recorded-vote><legislator name-id='A1'>B</legislator><vote> Yea </vote></recorded-vote><recorded-vote><legislator>C</legislator><vote>Nay</vote></recorded-vote></vote-data></rollcall-vote>")], "roll_id long, body string")
    rolls, votes = markup.us_house(bodies)
    assert [r.roll_id for r in rolls.collect()] == [4] and [tuple(r) for r in votes.collect()] == [(4, "A1", "Yea")]
    assert markup.us_senate(bodies)[0].collect() == [] and markup.floor_votes(bodies, "roll_id").collect() == [] and markup.ny_roster(bodies, "ny-assembly", "roll_id").collect() == []
    files = spark.createDataFrame([("a", '﻿id,name\r\n1,"a, ""b""\nc"\r\n2\r\n\r\n3,x\r\n'), ("b", None), ("c", "id\n9\n")], "file string, body string")
    got = lambda strict: sorted((r.file, r.line, r.name, r.id) for r in markup.csv_lines(files, ["name", "id"], strict=strict).collect())
    assert got(True) == [("a", 1, 'a, "b"\nc', "1"), ("a", 3, "x", "3"), ("c", 1, "", "9")]
    assert got(False) == [("a", 1, 'a, "b"\nc', "1"), ("a", 2, "", "2"), ("a", 3, "x", "3"), ("c", 1, "", "9")]
