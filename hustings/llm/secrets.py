"""Secret scanning: fixed patterns, and guess-cost dynamic programming over values in credential contexts.

A value that follows a credential word (``pwd = ...``, ``"auth": "..."``) is cut into words, dates, repeats,
keyboard walks and brute-force characters so that the sum of log10 guesses is least over all ways to cut it. A value
that costs at least ``MIN_LOG10`` is a secret even where no fixed pattern names it, or one names only a part of it,
unless it only refers to a secret kept elsewhere (a variable, a call). Every value is costed, and its cost reported.
Words are those of a ranked vocabulary, whose path is a parameter. The time is in proportion to the value: words and
dates are bounded in length, and of the starts of a run only those are kept that can still win.

Cases: a null text is empty and has no spans; texts are scanned whole, however long; spans are code points with
exclusive ends; repeated rows give repeated results; an empty table gives no rows; further columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate
from math import inf, log10
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

KINDS = ("assign", "access", "hex", "guess")
#: Guesses (log10) from which a context value counts as a secret.
MIN_LOG10 = 9.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A name may have further parts: prefixes and suffixes joined by _ or -, or by a change of case. Only letters and
# digits bar a short word (compass, author); the words of ASSIGN may end any name. A quoted value ends at its quote.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass|pwd|auth|credentials?|bearer|"""
    r"""(?:access|private|secret|encryption|signing|master|account|client|session|shared|storage|service|deploy|app|ssh|hmac|aes|jwt)[_-]?key))"""
    r"""(?:[0-9]++|(?-i:(?<=[a-z])(?=[A-Z])[A-Za-z0-9]++)|s)?(?![A-Za-z0-9])(?:[_-]++[A-Za-z0-9]++)*+["']?[\x20\t]*+(?:[:=]|\bis\b)[\x20\t]*+"""
    r"""(?:"((?:[^"\\\r\n]|\\.){6,}+)"|'((?:[^'\\\r\n]|\\.){6,}+)'|["']?([^\s"'|]{6,}))""",
    re.A | re.I,
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "auth", "credential", "key", "bearer")

# Frequent words of passwords, most frequent first.
WORDS = """password qwerty dragon monkey letmein login welcome admin master hello shadow sunshine princess football
baseball superman batman trust iloveyou love secret access flower summer winter spring autumn hunter killer pepper
ginger cookie cheese banana orange purple silver golden diamond freedom whatever charlie michael jordan jessica
daniel thomas robert andrew joshua george maggie buster soccer hockey ranger harley tigger computer internet
server system user root test guest demo sample default example changeme temp token pass word key data base home
work office money power magic star angel black white green blue red hot cool cat dog fish bird house horse correct
battery staple the and with from this that your mine open close start stop yes""".split()  # fmt: skip
#: Shortest word of the dictionary.
SHORTEST = 3
LEET = str.maketrans("013457@$!", "oieastasi")
# Rows of a keyboard, then the alphabet and the digits as further walks.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
LINES = [x for row in ROWS for x in (row, row[::-1])]
_YEAR, _MONTH, _DAY, _GAP = "(?:19|20)[0-9][0-9]", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "[-/._]?"
#: Patterns of dates with their guesses: year first, year last in both orders of day and month, and a year alone.
DATES = [(re.compile(p), n) for p, n in ((_YEAR + _GAP + _MONTH + _GAP + _DAY, 366 * 150), (_DAY + _GAP + _MONTH + _GAP + _YEAR, 366 * 150), (_MONTH + _GAP + _DAY + _GAP + _YEAR, 366 * 150), (_YEAR, 150))]
#: Signs that brute force tries for a letter without case.
CASELESS = 3000
#: log10 of the places where a repeat or a walk may start.
RUN = log10(40)
#: Each further segment doubles the guesses: the attacker must also guess where it starts.
SEGMENT = log10(2)


def _near(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    if p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return True
    return a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1


@dataclass(frozen=True)
class Dictionary:
    """log10 of each word's rank, the first letters that words have, and the length of the longest word."""

    ranks: dict[str, float]
    starts: frozenset[str]
    longest: int

    @classmethod
    def of(cls, words: Iterable[str]) -> Dictionary:
        ranks: dict[str, float] = {}
        for w in words:
            if len(w) >= SHORTEST and w not in ranks:
                ranks[w] = log10(len(ranks) + 2)
        return cls(ranks, frozenset(w[:SHORTEST] for w in ranks), max(map(len, ranks), default=0))


def vocabulary_words(path: str) -> Iterator[str]:
    """Whole words in the order of their frequency, from a file of base64 tokens and ranks: the tokens that a space opens."""
    for line in Path(path).read_bytes().splitlines():
        token = base64.b64decode(line.split()[0])
        if token[:1] == b" " and token[1:].isalpha():
            yield token[1:].decode().lower()


@cache
def dictionary(path: str | None = None) -> Dictionary:
    """The frequent words of passwords, then the words of a ranked vocabulary, by default a public one of 50,000 tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Dictionary.of([*WORDS, *vocabulary_words(path)])


class _Runs:
    """Segments (i, j) inside maximal runs whose cost is a level of i, plus log10(j - i), plus a level of j.

    A start that is behind an earlier one stays behind: the logarithms draw closer. So a start is dropped as soon as an
    earlier one is as good, and what is left to compare at each place is a handful.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []

    def best(self, j: int, start: int | None, level: float) -> tuple[float, int]:
        """The least level plus logarithm at j, and its start; first the run takes in ``start``, or begins anew (None)."""
        if start is None:
            self.starts = []
        else:
            while self.starts and self.starts[-1][1] >= level:
                self.starts.pop()
            self.starts.append((start, level))
        found, kept = (inf, -1), []
        for i, at in self.starts:
            if (now := at + log10(j - i)) < found[0]:
                found = now, i
                kept.append((i, at))
        self.starts = kept
        return found


def alphabet(v: str) -> float:
    """log10 of the number of characters that brute force must try at each place. Letters without case are those of
    scripts with thousands of common signs."""
    n = 26 * any(c.islower() for c in v) + 26 * any(c.isupper() for c in v) + 10 * any(c.isdigit() for c in v) + 33 * any(not c.isalnum() for c in v)
    n += CASELESS * any(c.isalpha() and not (c.islower() or c.isupper()) for c in v)
    return log10(16 if all(c in "0123456789abcdef" for c in v) else max(n, 10))


def guess_cost(value: str, words: Dictionary | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 guesses and the segments (start, end, kind) that give it: the minimum over all segmentations."""
    words = words or dictionary()
    low, n = value.lower(), len(value)
    if len(low) != n:  # a character whose lower case is longer
        low = "".join(c.lower()[0] for c in value)
    plain = low.translate(LEET)
    brute = alphabet(value)
    best, back = [0.0] + [inf] * n, [(0, "")] * (n + 1)
    runs = {"repeat": _Runs(), "walk": _Runs()}
    turns = [0] * (n + 1)  # changes of step up to a place
    for k in range(1, n - 1):
        turns[k + 1] = turns[k] + (ord(low[k]) - ord(low[k - 1]) != ord(low[k + 1]) - ord(low[k]))
    joined = {"repeat": lambda k: low[k - 1] == low[k], "walk": lambda k: _near(low[k - 1], low[k])}

    def offer(j: int, i: int, total: float, kind: str) -> None:
        if total < best[j]:
            best[j], back[j] = total, (i, kind)

    for i in range(n + 1):
        # What ends here: runs of three characters at least, whose starts are known by now.
        for kind, run in runs.items():
            if i >= 2 and not joined[kind](i - 1):
                run.best(i, None, 0.0)
            elif i >= 3 and joined[kind](i - 2):
                s = i - 3
                turned = kind == "walk"
                level, at = run.best(i, s, best[s] + (SEGMENT if s else 0) - turned * turns[s + 1] * log10(3))
                offer(i, at, level + RUN + turned * turns[i - 1] * log10(3), kind)
        if i == n:
            break
        here = best[i] + (SEGMENT if i else 0)
        offer(i + 1, i, best[i] + brute, "brute")
        if low[i : i + SHORTEST] in words.starts or plain[i : i + SHORTEST] in words.starts:
            for j in range(i + SHORTEST, min(n, i + words.longest) + 1):
                cost = words.ranks.get(low[i:j])
                if cost is None and (cost := words.ranks.get(plain[i:j])) is not None:
                    cost += SEGMENT
                if cost is not None:
                    offer(j, i, here + cost + SEGMENT * (value[i:j] != low[i:j]), "word")
        if value[i].isdigit():
            for pattern, guesses in DATES:
                if m := pattern.match(value, i):
                    offer(m.end(), i, here + log10(guesses), "date")
        for row in LINES:  # a walk along one row has no turns
            j = i
            while j < n and low[i : j + 1] in row:
                j += 1
                if j - i >= 3:
                    offer(j, i, here + RUN + log10(j - i), "walk")
    out: list[tuple[int, int, str]] = []
    j = n
    while j:
        i, kind = back[j]
        if out and kind == "brute" == out[-1][2]:
            out[-1] = (i, out[-1][1], kind)
        else:
            out.append((i, j, kind))
        j = i
    return best[n], out[::-1]


# What stands for a value that is elsewhere: a variable of a shell, a template's or a host's, or a place to fill in.
TEMPLATE = re.compile(r"\$\{?[A-Za-z_]|\$\(|%[A-Za-z_][A-Za-z0-9_]*%$|\{\{|\{%|<[A-Za-z_ -]+>$", re.A)
# Code that fetches it: a call or an index, complete or cut off at a quote.
FETCH = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\(|\[)", re.A)
_PARTS = re.compile(r"[_.]|(?<=[a-z])(?=[A-Z])")


def is_reference(value: str, quoted: bool, words: Dictionary) -> bool:
    """Whether a value names where the secret is and isn't one: a template, or unquoted a call, an index, or a name that
    joins words of the dictionary with points, underscores or changes of case."""
    if TEMPLATE.match(value):
        return True
    if quoted or FETCH.match(value):
        return not quoted
    parts = _PARTS.split(value.rstrip(";,)"))
    return len(parts) > 1 and all(len(p) < SHORTEST and p.isalpha() or p.lower() in words.ranks for p in parts)


def context_values(text: str, words: Dictionary | None = None) -> list[tuple[int, int, bool, float, list[tuple[int, int, str]]]]:
    """Every value in a credential context: start, end, whether it is a reference, its least log10 guesses and the
    segments that give them."""
    if not any(w in text.lower() for w in CONTEXT_WORDS):
        return []
    words, found = words or dictionary(), []
    for m in CONTEXT.finditer(text):
        s, e = m.span(m.lastindex)
        found.append((s, e, is_reference(text[s:e], m.lastindex < 3, words), *guess_cost(text[s:e], words)))
    return found


def _scanned(text: str, min_log10: float, words: Dictionary | None) -> tuple[list[tuple[int, int, str, int, int]], list[tuple]]:
    """The spans of a text, and its costed values."""
    low = text.lower()
    found = [(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    values = context_values(text, words)
    # The furthest end of the base values that start at or before a place tells whether one of them covers a value.
    covered = sorted((s, e) for *_, s, e in found)
    starts, ends = [s for s, _ in covered], list(accumulate((e for _, e in covered), max))
    for s, e, reference, cost, _ in values:
        k = bisect_right(starts, s)
        if not reference and cost >= min_log10 and not (k and ends[k - 1] >= e):
            found.append((s, e, "guess", s, e))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1])), values


def find_spans(text: str, min_log10: float = MIN_LOG10, words: Dictionary | None = None) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the value), by start, then by the order of ``KINDS``. A value that costs enough,
    refers to no other place and isn't wholly inside a base span is a span of kind guess."""
    return _scanned(text, min_log10, words)[0]


def join_spans(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind, *_ in spans)


def join_costs(values: list[tuple]) -> str:
    """start:end:log10 guesses:kinds of the segments, for each costed value."""
    return ",".join(f"{s}:{e}:{cost:.2f}:{'+'.join(k for *_, k in parts)}" for s, e, _, cost, parts in values)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_costed long, costs string"


def scan(docs: DataFrame, min_log10: float = MIN_LOG10, vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts, digest of the base spans, all spans, and the least cost
    and segmentation of every value in a credential context, those inside base spans included. ``vocabulary`` is the path of a ranked vocabulary; its words go to the tasks as a broadcast as large as that file."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                spans, values = _scanned(text or "", min_log10, shared.value)
                base = [x for x in spans if x[2] != "guess"]
                n = [sum(x[2] == k for x in spans) for k in KINDS]
                rows.append((*n[:3], hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans), n[3], len(values), join_costs(values)))
            cols = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_costed", "costs"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCAN_SCHEMA)


def redact_text(text: str, min_log10: float = MIN_LOG10, words: Dictionary | None = None, mark: str = "[SECRET]") -> str:
    """The text with the value of each span replaced; values that overlap become one mark."""
    out, at = [], 0
    for s, e in sorted((s, e) for *_, s, e in find_spans(text, min_log10, words)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, min_log10: float = MIN_LOG10, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with secret values replaced in ``text`` and ``n_chars`` counted anew where a text changed."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch.column("text").to_pylist()
            new = [t and redact_text(t, min_log10, shared.value) for t in old]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                counts = [c if a is b or a == b else len(b) for a, b, c in zip(old, new, batch.column(k).to_pylist())]
                batch = batch.set_column(k, "n_chars", pa.array(counts, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
