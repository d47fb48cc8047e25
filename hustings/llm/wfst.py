"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compilation turns a model into machines of states and arcs, held in arrays: the normaliser (rewrite rules, leftmost
and longest first; white space; dummy prefix and mark), the lexicon (arcs over characters; a path from the start to a
final state outputs a piece and weighs minus its score) and byte fallback for characters that are no piece. Encoding
composes them with the input, whose states are its places: all places of a window of texts at once follow the arcs
of the lexicon, which gives the arcs of the composition. Its tropical-semiring shortest path is the result: weights
add along a path, the least wins; of equal paths the one whose last piece is longest wins.

No arc crosses a cut of the composition (the end of a text, most starts of words), so the parts between cuts are
solved side by side, and a window is settled up to its last cut: memory is bounded by the window for texts of any
length that have cuts, and in proportion to the longest part without one.

The default model was trained as byte-pair encoding, whose scores are ranks of merges. The shortest path by these
scores is exact and reversible, but the ids are not those that merging gives; unigram models agree with the library.

Cases: null and empty texts give no ids and decode to an empty text; very long texts are solved window by window;
ties go to the longest last piece; repeated rows give repeated results; an empty table gives no rows; further columns
of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stands after each text; no symbol of any machine.
END = np.uint32(0x110000)
#: Code points that are composed at once, and steps up to which the parts of a window are solved side by side.
WINDOW, MANY_STEPS = 1 << 17, 1000
NOTHING = -2


def default_model() -> str:
    """The public 32,000-piece model of the installed tokenizer files; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _proto(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message (variants 0, 1, 2 and 5)."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """Rewrite rules of a compiled character map: a double-array trie over UTF-8, then replacement texts."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    texts = blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules: dict[str, str] = {}
    todo = [(offset(units[0]), b"")]
    while todo:
        base, key = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at < len(units) and units[at] & 0x800000FF == c:
                unit, word = units[at], key + bytes([c])
                child = at ^ offset(unit)
                if unit >> 8 & 1:
                    value = units[child] & 0x7FFFFFFF
                    rules[word.decode("utf-8", "ignore")] = texts[value : texts.index(b"\0", value)].decode()
                todo.append((child, word))
    return rules


class Machine:
    """A weighted transducer compiled to arrays: a deterministic automaton over code points whose final states carry a
    weight and an output number. Its arcs lie in one double array: the arc of state s for symbol c ends in state
    ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, words: Iterable[tuple[str, float, int]]):
        children: list[dict[int, int]] = [{}]
        weight, output = [np.inf], [-1]
        symbols: dict[int, int] = {}
        for word, w, out in words:
            node = 0
            for c in map(ord, word):
                c = symbols.setdefault(c, len(symbols) + 1)
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    weight.append(np.inf)
                    output.append(-1)
                node = children[node][c]
            if w < weight[node]:
                weight[node], output[node] = w, out
        self.symbol_of = np.zeros(0x110001, np.int32)
        self.symbol_of[list(symbols)] = list(symbols.values())
        # States with many arcs are placed first; each takes the first base at which all its arcs find free places.
        used, first, look = np.zeros(2 * len(children) + 8192, bool), 1, 4096
        used[0] = True
        arcs = {k: np.array(sorted(c)) for k, c in enumerate(children) if c}
        bases: dict[int, int] = {}
        for k in sorted(arcs, key=lambda k: (-len(arcs[k]), k)):
            c = arcs[k]
            while used[first]:
                first += 1
            at, fits = max(first, int(c[0])), np.zeros(0, int)
            while not len(fits):
                if len(used) < at + look + len(symbols) + 1:
                    used = np.concatenate([used, np.zeros(len(used) + look + len(symbols), bool)])
                free = at + np.flatnonzero(~used[at : at + look])
                fits = free[~used[(free - c[0])[:, None] + c].any(1)]
                at += look
            bases[k] = int(fits[0] - c[0])
            used[bases[k] + c] = True
        place = np.zeros(len(children), np.int64)
        for k in arcs:
            for sym, child in children[k].items():
                place[child] = bases[k] + sym
        base = np.zeros(max([0, *bases.values()]) + len(symbols) + 1, np.int32)
        check = np.full(len(base), -1, np.int32)
        for k, b in bases.items():
            base[place[k]] = b
            check[b + arcs[k]] = place[k]
        self.base, self.check = base, check
        self.weight, self.output = np.full(len(base), np.inf), np.full(len(base), -1, np.int32)
        self.weight[place], self.output[place] = weight, output
        self.final, self.inner = np.isfinite(self.weight), np.zeros(len(base), bool)
        self.inner[place[list(arcs)]] = True

    def paths(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Compose with a chain of code points: for each length, the places at which a path of so many arcs begins that
        ends in a final state, and that state."""
        symbols = self.symbol_of[codes]
        at, state, length = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32), 0
        while len(at):
            to = self.base[state] + symbols[at + length]
            kept = np.flatnonzero(self.check[to] == state)
            at, state, length = at[kept], to[kept], length + 1
            done = np.flatnonzero(self.final[state])
            yield length, at[done], state[done]
            on = np.flatnonzero(self.inner[state] & (at < len(codes) - length))
            at, state = at[on], state[on]


@dataclass
class Transducer:
    """The normaliser, the pieces and byte fallback, compiled, and their composition with inputs."""

    pieces: list[tuple[str, float, int]]
    rules: dict[str, str] = field(default_factory=dict)
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unknown_id: int = 0

    def __post_init__(self) -> None:
        self.byte_ids = np.full(256, -1, np.int32)
        self.texts: list[bytes] = []
        known = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            self.texts.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.encode())
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif kind in (NORMAL, USER) and piece:
                # A user-defined piece costs less than any path over the same characters.
                known.append((piece, -score if kind == NORMAL else 0.1 - 0.1 * len(piece), i))
        self.lexicon = Machine(known)
        self.longest = max((len(p) for p, *_ in known), default=1)
        self.fallback = 10.0 + max([0.0, *(w for (_, w, i) in known if self.pieces[i][2] == NORMAL)])
        self.fall_back_to_bytes = bool((self.byte_ids >= 0).all())
        self.rewrites = [np.array([*map(ord, v)], np.uint32) for v in self.rules.values()]
        self.normaliser = Machine((k, 0.0, n) for n, k in enumerate(self.rules)) if self.rules else None

    def _rewritten(self, codes: np.ndarray) -> np.ndarray:
        """The normaliser's rules, leftmost and longest first, composed with the chain ``codes`` window by window: a window
        sees as many codes beyond its end as the longest rule has, and ends where no rule's match goes on."""
        ahead = max(map(len, self.rules))
        size = max(WINDOW, ahead)  # so that a window holds one match at least
        out, at = [], 0
        while at < len(codes):
            done, part = self._rewritten_window(codes[at : at + size + ahead], size)
            out.append(part)
            at += done
        return np.concatenate(out) if out else codes

    def _rewritten_window(self, codes: np.ndarray, most: int) -> tuple[int, np.ndarray]:
        """How many of the first ``most`` codes are rewritten, all but those of a match that goes on beyond, and to what."""
        length, rule = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int32)
        for n, at, state in self.normaliser.paths(codes):
            length[at], rule[at] = n, self.normaliser.output[state]
        inside, free = np.zeros(len(codes), bool), 0
        for p in np.flatnonzero(length > 1).tolist():
            if p >= free:
                free = p + int(length[p])
                inside[p + 1 : free] = True
        done = len(codes)
        if done > most:
            done = int(np.flatnonzero(~inside[: most + 1])[-1])
            codes, length, rule, inside = codes[:done], length[:done], rule[:done], inside[:done]
        at = np.flatnonzero((length > 0) & ~inside)
        size = np.ones(len(codes), np.int64)
        size[inside] = 0
        size[at] = np.array([len(x) for x in self.rewrites])[rule[at]]
        out = np.repeat(codes, size)
        ends = size.cumsum()
        long = at[size[at] > 0]
        if len(long):
            places = np.concatenate([np.arange(ends[p] - size[p], ends[p]) for p in long.tolist()])
            out[places] = np.concatenate([self.rewrites[r] for r in rule[long].tolist()])
        return done, out

    def normalised(self, texts: list[str]) -> np.ndarray:
        """The code points of the normalised texts, ``END`` after each. Rules first, then the machine of two states for
        white space (a run of spaces is one, none at the ends), the dummy prefix and the mark."""
        codes = _joined(texts)
        if self.normaliser:
            codes = self._rewritten(codes)
        blank = np.uint32(32)
        if self.squeeze:
            before = np.concatenate([[END], codes[:-1]])
            codes = codes[(codes != blank) | ((before != blank) & (before != END))]
            after = np.concatenate([codes[1:], [END]])
            codes = codes[(codes != blank) | (after != END)]
        if self.dummy_prefix:
            first = np.concatenate([[True], codes[:-1] == END]) if len(codes) else np.zeros(0, bool)
            codes = np.insert(codes, np.flatnonzero(first & (codes != END)), blank)
        if self.escape:
            codes[codes == blank] = ord(MARK)
        return codes

    def normalise(self, text: str) -> str:
        return self.normalised([text])[:-1].tobytes().decode("utf-32-le", "surrogatepass")

    def _shortest(self, codes: np.ndarray, last: bool) -> tuple[int, np.ndarray, np.ndarray]:
        """Compose the lexicon with ``codes`` and take the shortest path: how far it is settled, the places at which its
        pieces start, and the pieces (-1: fallback).

        No arc crosses a cut, so the parts between cuts are solved side by side: step by step through their places,
        the arcs that end there. Unless ``last``, places that arcs of later codes may cross are left to the next call.
        """
        n = len(codes)
        found = list(self.lexicon.paths(codes))
        whole = np.zeros(n, bool)
        if found:
            whole[found[0][1]] = True
        alone = np.flatnonzero(~whole).astype(np.int32)
        found.append((1, alone, np.full(len(alone), -1, np.int32)))
        crossed = np.zeros(n + 1, np.int32)
        for length, at, _ in found:
            if length > 1:
                crossed[at + 1] += 1
                crossed[at + length] -= 1
        cut = crossed.cumsum() == 0
        to = n if last else int(np.flatnonzero(cut[: max(1, n - self.longest + 1)])[-1])
        if not to:
            return 0, alone[:0], alone[:0]
        origin = np.maximum.accumulate(np.where(cut[:to], np.arange(to), 0)).astype(np.int32)
        found = [(length, at[kept], state[kept]) for length, at, state in found for kept in [at < to]]
        widest = max(length for length, *_ in found)
        start = np.concatenate([at for _, at, _ in found])
        state = np.concatenate([x for *_, x in found])
        length = np.repeat(np.array([x for x, *_ in found], np.int32), [len(at) for _, at, _ in found])
        weight = np.where(state < 0, self.fallback, self.lexicon.weight[state])
        step = start + length - origin[start]
        cost, back = np.full(to + 1, np.inf), np.full(to + 1, -1, np.int32)
        cost[np.flatnonzero(cut[: to + 1])] = 0.0
        reached = np.full(to + 1, np.inf)
        # Arcs in the order of the step at which they end; of one step the longest first, so each group ends in different places.
        key = step.astype(np.int64) * (widest + 1) + (widest - length)
        narrow = np.flatnonzero(step <= MANY_STEPS)
        order = narrow[np.argsort(key[narrow].astype(np.uint16 if (MANY_STEPS + 1) * (widest + 1) < 1 << 16 else np.uint32), kind="stable")]
        sorted_key = key[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(sorted_key)) + 1, [len(order)]]) if len(order) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            arcs = order[a:b]
            s = start[arcs]
            e = s + length[arcs[0]]
            total = np.where(cut[s], 0.0, reached[s]) + weight[arcs]
            less = np.flatnonzero(total < reached[e])
            e = e[less]
            reached[e], back[e] = total[less], arcs[less]
        far = np.flatnonzero(step > MANY_STEPS)
        if len(far):  # few parts are so long: their arcs one by one
            far = far[np.lexsort((-length[far], start[far] + length[far]))]
            for k, s, e, w in zip(far.tolist(), start[far].tolist(), (start[far] + length[far]).tolist(), weight[far].tolist()):
                total = (0.0 if cut[s] else reached[s]) + w
                if total < reached[e]:
                    reached[e], back[e] = total, k
        piece_at = np.full(to, NOTHING, np.int32)
        here = np.flatnonzero(cut[: to + 1])[1:]
        while len(here):
            arcs = back[here]
            s = start[arcs]
            piece_at[s] = np.where(state[arcs] < 0, -1, self.lexicon.output[state[arcs]])
            here = s[~cut[s]]
        at = np.flatnonzero(piece_at != NOTHING)
        return to, at, piece_at[at]

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        codes = self.normalised(texts)
        ids, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        owner = np.concatenate([[0], (codes == END).cumsum()[:-1]]) if len(codes) else np.zeros(0, np.int64)
        at, size = 0, WINDOW
        while at < len(codes):
            part = codes[at : at + size]
            to, places, pieces = self._shortest(part, at + size >= len(codes))
            if not to:
                size *= 2
                continue
            kept = part[places] != END
            places, pieces = places[kept], pieces[kept]
            if self.fall_back_to_bytes:
                # The arcs of byte fallback: a character that is no piece gives the pieces of its bytes.
                lone = np.flatnonzero(pieces < 0)
                kinds, which = np.unique(part[places[lone]], return_inverse=True)
                spelled = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in kinds.tolist()]
                times = np.ones(len(places), np.int64)
                times[lone] = np.array([len(x) for x in spelled], np.int64)[which] if len(lone) else 0
                places, out = np.repeat(places, times), np.repeat(pieces, times)
                if len(lone):
                    out[out < 0] = np.concatenate([spelled[k] for k in which.tolist()])
                pieces = out
            ids.append(np.where(pieces < 0, np.int32(self.unknown_id), pieces).astype(np.int32))
            owners.append(owner[at + places])
            at, size = at + to, WINDOW
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        if not self.fall_back_to_bytes and len(ids):  # one unknown stands for a run of them
            kept = np.concatenate([[True], (ids[1:] != self.unknown_id) | (ids[:-1] != self.unknown_id) | (owners[1:] != owners[:-1])])
            ids, owners = ids[kept], owners[kept]
        return ids, np.bincount(owners, minlength=len(texts)).astype(np.int32)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        ids, counts = self.encode_arrays(texts)
        return [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])] if texts else []

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _joined(texts: list[str]) -> np.ndarray:
    """The code points of all texts with ``END`` after each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.insert(flat, np.cumsum([len(t) for t in texts]), END) if texts else flat.copy()


def load(model: bytes) -> Transducer:
    """Compile a serialised model."""
    pieces, spec = [], {}
    for number, value in _proto(model):
        if number == 1:
            p = dict(_proto(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 3:
            spec = dict(_proto(value))
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Transducer(pieces, charsmap_rules(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), unknown)


@cache
def compiled(path: str) -> Transducer:
    """The transducer of a model file, compiled once in the driver."""
    return load(Path(path).read_bytes())


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (the ids decode to the very text) for each row of ``docs``. The compiled
    transducer goes to the executors as a broadcast, whose size is that of the model alone (a few megabytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled(model_path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = shared.value
        for batch in slices(batches, 100):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, counts = fst.encode_arrays(texts)
            ends = np.concatenate([[0], counts.cumsum()])
            flat = ids.tolist()
            same = [fst.decode(flat[a:b]) == t for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(counts), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(compiled(model_path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = shared.value
        for batch in slices(batches):
            texts = [fst.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
