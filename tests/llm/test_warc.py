from __future__ import annotations

import base64
import hashlib

from hustings.llm import warc
from hustings.llm.queries import ORACLES, QUERIES
from tests.oracle import same


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def brute(rows):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = last[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def test_round_trip_of_odd_payloads(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\n"
    rows = [(1, "http://a.example/x?y#z", "<p>é</p>"), (2, None, None), (3, "http://a.example", ""), (4, "u\r\nX: y", tricky), (5, "http://b", tricky), (6, "http://c", "x" * 200_000), (7, "http://c", "\n\r\n\x00")]
    got = warc.capture_report(warc.write_and_assemble(pages(spark, rows)))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == brute(rows)


def test_hot_payload_repeats_and_extra_columns(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"own {i}") for i in range(300)]
    from pyspark.sql import functions as F

    df = pages(spark, rows).withColumns({"id": F.lit(1), "digest": F.lit("d"), "first": F.lit(2), "payload": F.lit("p")})
    got = warc.capture_report(warc.write_and_assemble(df))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == brute(rows)
    assert got.where("record_type = 'revisit'").count() == 99


def test_repeated_rows_and_empty_table(spark):
    twice = warc.capture_report(warc.write_and_assemble(pages(spark, [(1, "u", "a"), (1, "u", "a"), (2, "u", "b")]))).collect()
    assert sorted(r.page_id for r in twice) == [1, 1, 2] and {r.record_type for r in twice} == {"response"}
    assert warc.capture_report(warc.write_and_assemble(pages(spark, []))).count() == 0


def test_every_record_has_an_id_of_its_own_and_revisits_find_theirs(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "b"), (3, "v", "a"), (3, "v", "a"), (None, "w", "b")]
    path = warc.new_path(spark, "warc")
    warc.write_archives(warc.captures(pages(spark, rows)), path)
    found = warc.read_archives(spark, path).collect()
    ids = [r.record_id for r in found]
    assert len(ids) == len(set(ids)) == 18 and {r.refers_to for r in found if r.refers_to} <= set(ids)
    assert warc.leftovers(warc.read_archives(spark, path)).count() == 0


def test_archives_are_bounded_in_bytes(spark, monkeypatch, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i:04d}" * (1 + i % 7) * 100) for i in range(200)] + [(900, "http://long", "x" * 90_000), (901, "http://longer", "y" * 300_000)]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (1000, 5000))
    warc.write_archives(warc.captures(pages(spark, rows)), str(tmp_path / "w"), "none")
    sizes = [f.stat().st_size for f in (tmp_path / "w").rglob("part-*")]
    assert sum(s > 40_000 for s in sizes) == 2 and len(sizes) > 10
    got = warc.capture_report(warc.assemble(warc.read_archives(spark, str(tmp_path / "w")))).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == brute(rows)


def test_many_repeated_payloads_are_looked_up_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    rows = [(i, f"http://h/{i}", f"text {i % 20}") for i in range(60)]
    got = warc.capture_report(warc.write_and_assemble(pages(spark, rows))).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == brute(rows)


def test_captures_nest_their_records(spark):
    caps = warc.write_and_assemble(pages(spark, [(1, "http://a.example/p", "x"), (2, "http://a.example/q", "y")])).collect()
    assert {r.response.target_uri: r.request.fields["request-line"] for r in caps} == {"http://a.example/p": "GET /p HTTP/1.1", "http://a.example/q": "GET /q HTTP/1.1"}
    assert all(r.n_requests == r.n_metadata == 1 for r in caps)


def test_agrees_with_oracle(spark):
    same(QUERIES["op2_warc_transactions"](spark, "/root/testdata/sf0.001"), ORACLES["op2_warc_transactions"], "/root/testdata/sf0.001")
