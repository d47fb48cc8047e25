"""Measures under vote in journals that are made from the given texts: marks are set between the sentences of a document
or the elements of a page, so that texts, their lengths and the number of rolls grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures
from ..sources import driver_tables as T
from . import query

#: The mark after piece i of text d, by (31 d + 17 i + i * i) % 12; {n} is d % 90 + i. Other pieces get none.
MARKS = {
    "mi": {0: "House Bill No. {n}, entitled", 1: "was read a first time", 2: "Third Reading of Bills", 3: "Roll Call No. 7", 4: "INITIATIVE PETITION  An initiation of legislation", 5: "Initiative Petition No. {n}", 6: "Senate Joint Resolution B, entitled", 7: "Roll Call No. 8", 8: "the question being on"},
    "mo": {0: "CCS for HBs {n} and 3155, entitled:", 2: "On motion of Senator X", 3: "Was read the 3rd time and passed by the following vote:", 5: "SB {n} was again taken up by Senator Y", 7: "was read the 3 rd time and finally passed by the following vote:"},
    "tx": {0: "\nSENATE CONCURRENT RESOLUTION {n}ON SECOND READING\n", 3: "Yeas 31, Nays 0", 5: "\nCOMMITTEE SUBSTITUTEHOUSE BILL {n} ON THIRD READING\n", 7: "Yeas 3, Nays 28"},
}


def journal(rows: DataFrame, key: str, text: str, cut: str, state: str) -> DataFrame:
    """key and a journal: the text's pieces, each followed by its mark."""
    said = [MARKS[state].get(k, "").partition("{n}") for k in range(12)]
    heads, tails = F.array(*[F.lit(f" {h}" if n else f" {h} " if h else " ") for h, n, _ in said]), F.array(*[F.lit(f"{t} " if n else "") for _, n, t in said])
    numbered = [k for k, (_, n, _) in enumerate(said) if n]

    def mark(i):
        slot = (31 * F.col(key) + 17 * i + i * i) % 12
        number = F.when(slot.isin(numbered), (F.col(key) % 90 + i).cast("string")).otherwise("")
        return F.coalesce(F.concat(F.get(heads, slot.cast("int")), number, F.get(tails, slot.cast("int"))), F.lit(" "))

    pieces = F.split(F.coalesce(text, F.lit("")), cut, -1)
    return rows.select(key, F.array_join(F.transform(pieces, lambda p, i: F.concat(p, mark(i))), "").alias("journal"))


# Each state's marks as rows of (slot, kind, head, tail, code): the text around the number, and the bill it names.
_KINDS = {"heading": ("entitled", "taken up", "READING\n"), "roll": ("Roll Call", "following vote", "Yeas"), "introduced": ("first time",), "resumed": ("Third Reading of", "question being"), "closed": ("On motion",), "numbered": ("Petition No",), "unnumbered": ("An initiation",)}
_CODES = {"House Bill": "HB ", "Senate Joint": "SJR B", "HBs": "HB ", "SB": "SB ", "SENATE CONCURRENT": "SCR ", "SUBSTITUTEHOUSE": "HB "}


def _rules() -> str:
    rows = []
    for state, said in MARKS.items():
        for slot, m in said.items():
            kind = next(k for k, signs in _KINDS.items() if any(s in m for s in signs))
            code = next((c for sign, c in _CODES.items() if sign in m), "") if kind == "heading" else ""
            head, n, tail = f" {m} ".partition("{n}")
            head, tail = (x.replace("\n", "' || chr(10) || '") for x in (head, tail))
            rows.append(f"('{state}', {slot}, '{kind}', '{head}', {bool(n)}, '{tail}', '{code}', {'B' != code[-1:]}, {len(m) - len(m.lstrip())})")
    return ", ".join(rows)


SQL = f"""
WITH rules(state, slot, kind, head, has_n, tail, code, takes_n, skip) AS (VALUES {_rules()}),
src AS (SELECT 'mi' AS state, doc_id AS id, string_split(coalesce(text, ''), '.') AS p FROM documents UNION ALL SELECT 'mo', doc_id, string_split(coalesce(text, ''), '.') FROM documents
  UNION ALL SELECT 'tx', page_id, string_split(coalesce(html, ''), '>') FROM pages),
piece AS (SELECT state, id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM src),
said AS (
  SELECT p.state, id, i, length(piece) AS before, kind, skip, code, takes_n, CAST(id % 90 + i AS VARCHAR) AS n,
         CASE WHEN kind IS NULL THEN ' ' WHEN has_n THEN head || CAST(id % 90 + i AS VARCHAR) || tail ELSE head END AS mark
  FROM piece p LEFT JOIN rules r ON r.state = p.state AND r.slot = (31 * id + 17 * i + i * i) % 12),
placed AS (SELECT *, sum(before + length(mark)) OVER (PARTITION BY state, id ORDER BY i) - length(mark) + 1 + coalesce(skip, 0) AS position FROM said),
marks AS (
  SELECT *, CASE kind WHEN 'heading' THEN CASE WHEN takes_n THEN code || n ELSE code END
                      WHEN 'unnumbered' THEN 'IP ' || max_by(CASE WHEN kind = 'numbered' THEN n END, CASE WHEN kind = 'numbered' THEN i END) OVER (PARTITION BY state, id ORDER BY i) END AS bill
  FROM placed WHERE kind IS NOT NULL),
rolls AS (SELECT *, row_number() OVER (PARTITION BY state, id ORDER BY i) AS nth FROM marks WHERE kind = 'roll'),
last AS (SELECT r.state, r.id, r.i, r.nth, r.position, r.mark, max(h.i) AS h FROM rolls r LEFT JOIN marks h ON h.state = r.state AND h.id = r.id AND h.i < r.i AND h.bill IS NOT NULL GROUP BY ALL),
intro AS (SELECT l.*, (SELECT min(m.i) FROM marks m WHERE m.state = l.state AND m.id = l.id AND m.kind = 'introduced' AND m.i > l.h AND m.i < l.i) AS intro FROM last l),
done AS (
  SELECT l.*, (SELECT count(*) FROM marks m WHERE m.state = l.state AND m.id = l.id AND m.kind = 'resumed' AND m.i > l.intro AND m.i < l.i) AS resumed,
         (SELECT count(*) FROM marks m WHERE m.state = l.state AND m.id = l.id AND m.kind = 'closed' AND m.i > l.h AND m.i < l.i) AS closed FROM intro l)
SELECT d.state, d.id, CAST(d.nth AS INTEGER) AS nth, CAST(d.position AS BIGINT) AS position,
       CASE WHEN (d.intro IS NULL OR d.resumed > 0) AND d.closed = 0
             AND (d.state <> 'mo' OR d.position + length(trim(d.mark)) - (m.position + CASE WHEN m.code = 'HB ' THEN length('CCS for ') ELSE 0 END) <= 6000) THEN m.bill END AS bill
FROM done d LEFT JOIN marks m ON m.state = d.state AND m.id = d.id AND m.i = d.h
"""


@query(SQL)
def measure_under_vote(spark: SparkSession, d: str) -> DataFrame:
    """The rolls of journals made from every document (two states' rules) and every page (a third's)."""
    docs, pages = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), T.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    each = lambda rows, cut, state: measures.measure_under_vote(journal(rows, "id", "text", cut, state), "id", "journal", measures.JOURNALS[state]).withColumn("state", F.lit(state))
    return each(docs, r"\.", "mi").unionByName(each(docs, r"\.", "mo")).unionByName(each(pages, ">", "tx"))
