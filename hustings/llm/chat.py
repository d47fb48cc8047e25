"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``start`` opens a message, ``delta`` appends streamed text, ``edit`` replaces
the text, ``regenerate`` throws away what was streamed so far so that the deltas that follow make a new version, and
``delete`` removes the message. Logs are partitioned by conversation and message, sorted by sequence number and
folded as a stream, so a conversation with a third of all events is dealt out over its messages and a task holds one
message at a time. Each final message is rendered to a segment; the segments of a conversation in order are its
training text, and the loss covers the bodies of the assistant's turns. Reading back takes the training texts and the
spans of the loss alone, and tells turns apart by their marks.

Control strings inside texts and roles get a backslash after their first character (one more where some are there
already), so no text can open or close a turn and the escape can be taken back exactly.

Cases: null texts and roles are empty; null conversations form a group of their own; events of a message that never
started open it with an empty role; ties in the sequence are folded in the order of kind and text; messages of equal
position are ordered by role and text; repeated rows of a conversation table stay separate turns; an empty log gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Code points in one streamed delta of ``events_of_turns``.
DELTA_CHARS = 512
#: Code points of a training text from which it goes on in another row.
PART_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and further control strings that a text may not hold unescaped."""

    open: str = "<|turn|>"
    says: str = "<|says|>"
    close: str = "<|end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    learned: str = "assistant"

    @cache
    def _pattern(self, slashes: str) -> re.Pattern:
        marks = sorted({self.open, self.says, self.close, *self.controls}, key=lambda c: (-len(c), c))
        return re.compile("|".join(f"{re.escape(c[0])}{slashes}(?={re.escape(c[1:])})" for c in marks))

    def escape(self, text: str) -> str:
        return self._pattern(r"\\*").sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._pattern(r"\\+").sub(lambda m: m[0][:-1], text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """The segment of a turn and where the loss applies in it (code points; equal if nowhere)."""
        head, body = f"{self.open}{self.escape(role)}{self.says}", self.escape(text)
        end = len(head) + len(body) if role == self.learned else len(head)
        return f"{head}{body}{self.close}\n", len(head), end

    def parse(self, segment: str) -> tuple[str, str]:
        """Role and text of a rendered segment."""
        head, _, rest = segment.removeprefix(self.open).partition(self.says)
        return self.unescape(head), self.unescape(rest.removesuffix("\n").removesuffix(self.close))


def events_of_turns(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """An event log that leads to a table of turns (conv_id, turn, role, text), latest events first.

    A hash of the turn chooses how it came about: its text was streamed in deltas; a draft was streamed, thrown away by
    a regeneration, and the text streamed after it; a draft was replaced by an edit that holds the first piece, and the
    rest streamed after that; or the text was streamed beside a second message that was deleted. ``turns`` should be
    read from files: its rows are numbered as they are read, and lost tasks must number them again alike.
    """
    text = F.coalesce("text", F.lit(""))
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("position"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    named = named.withColumns({"message": F.monotonically_increasing_id() * 2, "way": F.pmod(F.xxhash64("conv_id", "position", "role", F.length("text")), F.lit(4))})
    pieces = F.ceil(F.length("text") / delta_chars).cast("int")
    event = lambda kind, role, said: F.struct(F.lit(kind).alias("event"), role.cast("string").alias("role"), said.cast("string").alias("text"))
    delta = lambda k: event("delta", F.lit(None), F.substring(F.col("text"), (k - 1) * delta_chars + 1, F.lit(delta_chars)))
    deltas = lambda first: F.when(pieces >= first, F.transform(F.sequence(F.lit(first), pieces), delta)).otherwise(F.array().cast("array<struct<event:string,role:string,text:string>>"))
    start, draft = event("start", F.col("role"), F.lit("")), event("delta", F.lit(None), F.concat(F.lit("Draft: "), F.reverse(F.substring("text", 1, 64))))
    edited = F.concat(F.array(start, draft, event("edit", F.lit(None), F.substring(F.col("text"), 1, delta_chars))), deltas(2))
    made = F.when(F.col("way") == 1, F.concat(F.array(start, draft, event("regenerate", F.lit(None), F.lit(None))), deltas(1))).when(F.col("way") == 2, edited).otherwise(F.concat(F.array(start), deltas(1)))
    own = F.struct(F.col("message"), made.alias("events"))
    twin = F.struct((F.col("message") + 1).alias("message"), F.array(start, draft, event("delete", F.lit(None), F.lit(None))).alias("events"))
    each = named.select("conv_id", "position", F.explode(F.when(F.col("way") == 3, F.array(own, twin)).otherwise(F.array(own))).alias("m"))
    late_first = F.reverse(F.transform("m.events", lambda e, k: F.struct(k.cast("long").alias("seq"), e["event"].alias("event"), e["role"].alias("role"), e["text"].alias("text"))))
    return each.select("conv_id", "position", "m.message", F.explode(late_first).alias("e")).select("conv_id", "position", "message", "e.seq", "e.event", "e.role", "e.text")


SEGMENTS = "conv_id long, position long, message long, role string, text string, segment string, loss_start long, loss_end long"
_KEYS = ("conv_id", "position", "message")


def fold_message(events: Iterator[tuple[str, str | None, str | None]]) -> tuple[str, str] | None:
    """Role and final text of one message's events (kind, role, text) in order; None if it was deleted."""
    role, parts, alive = "", [], True
    for kind, who, text in events:
        if who:
            role = who
        if kind == "delta":
            parts.append(text or "")
        elif kind in ("start", "edit"):
            parts = [text or ""]
        elif kind == "regenerate":
            parts = [text or ""]
        elif kind == "delete":
            alive = False
    return (role, "".join(parts)) if alive else None


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of equal keys in a sorted stream of batches, each with its rows as a lazy iterator."""
    from itertools import groupby

    def rows() -> Iterator[tuple[tuple, tuple]]:
        for b in slices(batches):
            k = [b.column(c).to_pylist() for c in keys]
            r = [b.column(c).to_pylist() for c in rest]
            yield from zip(zip(*k), zip(*r))

    for key, found in groupby(rows(), key=lambda x: x[0]):
        yield key, (x[1] for x in found)


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000, most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and of characters, one row at least."""
    out: list[tuple] = []
    chars = 0
    for r in rows:
        out.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(out) == most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def reconstruct(events: DataFrame, template: Template = Template()) -> DataFrame:
    """The final messages of a log (conv_id, position, message, seq, event, role, text) with their rendered segments."""
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("message", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, found in _groups(batches, _KEYS, ("event", "role", "text")):
                if (final := fold_message(found)) is not None:
                    yield (*key, *final, *template.render(*final))

        yield from _emit(rows(), schema)

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.select(*_KEYS, "seq", "event", "role", "text").repartition(n, *_KEYS)
    return dealt.sortWithinPartitions(*_KEYS, "seq", "event", "text").drop("seq").mapInArrow(run, SEGMENTS)


FORMATTED = "conv_id long, part long, at long, formatted string, loss array<struct<start: long, end: long>>"


def formatted(segments: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The training text of each conversation and the spans (start, end; code points of the whole text) under the loss.

    One row a conversation, unless its text is longer than ``part_chars``: then parts of that length follow one
    another, cut anywhere; ``at`` is where a part starts, and a span stands with the part that it starts in. The rows of
    a conversation are in one partition, in order; a task holds one part and one segment at a time.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("formatted", pa.string()), ("loss", span)])

    def parts(conv: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        held, spans, part, at, end = "", [], 0, 0, 0
        for segment, start, to in found:
            if to > start:
                spans.append((end + start, end + to))
            end += len(segment)
            held += segment
            while len(held) > part_chars:
                cut = at + part_chars
                yield (*conv, part, at, held[:part_chars], [{"start": a, "end": b} for a, b in spans if a < cut])
                held, spans, part, at = held[part_chars:], [x for x in spans if x[0] >= cut], part + 1, cut
        yield (*conv, part, at, held, [{"start": a, "end": b} for a, b in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit((row for conv, found in _groups(batches, ("conv_id",), ("segment", "loss_start", "loss_end")) for row in parts(conv, found)), schema)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.select("conv_id", "position", "role", "segment", "loss_start", "loss_end").repartition(n, "conv_id")
    return dealt.sortWithinPartitions("conv_id", "position", "role", "segment").select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, FORMATTED)


def read_turns(parts: Iterator[tuple[str, list[dict]]], template: Template = Template()) -> Iterator[tuple[str, str, str, int]]:
    """Role, text, text under the loss and length of each turn of a conversation's training text, given its parts in
    order with their spans. Turns are told apart by their marks alone; a text that isn't a run of turns is an error."""
    held, at, spans = "", 0, []
    end = template.close + "\n"
    for text, loss in parts:
        held += text
        spans += [(x["start"], x["end"]) for x in loss or ()]
        done = 0
        while (to := held.find(end, done)) >= 0:
            turn = held[done : to + len(end)]
            if not turn.startswith(template.open):
                raise ValueError(f"a turn begins with {turn[:20]!r}")
            lost = [turn[a - at - done : b - at - done] for a, b in spans if a < at + to + len(end)]
            spans = spans[len(lost) :]
            yield (*template.parse(turn), "".join(map(template.unescape, lost)), len(turn))
            done = to + len(end)
        held, at = held[done:], at + done
    if held or spans:
        raise ValueError(f"the text ends within a turn: {held[:20]!r}")


def read_back(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, from the rows of ``formatted`` alone. Hashing is a stream: memory holds one part
    and one turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def fold(found: Iterator[tuple]) -> tuple:
        turns, loss, n, chars, lost = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for role, text, learned, length in read_turns(found, template):
            turns.update(f"{role}\n{text}\n".encode())
            loss.update(learned.encode())
            n, chars, lost = n + 1, chars + length, lost + len(learned)
        return n, turns.hexdigest(), lost, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(((*conv, *fold(found)) for conv, found in _groups(batches, ("conv_id",), ("formatted", "loss"))), schema)

    return texts.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_case(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7: two turns whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(rows)


#: The same digests in DuckDB. A turn's frame has 24 characters; each control string in a text or role gets one more.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
d AS (SELECT *, len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p)) AS controls
  FROM c, (SELECT '<\\*\|turn\|>|<\\*\|says\|>|<\\*\|end\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>' AS p))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(role) + length(text) + controls + 24) AS BIGINT) AS formatted_chars
FROM d GROUP BY conv_id
"""
