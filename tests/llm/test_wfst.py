from __future__ import annotations

import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hustings.llm import wfst
from hustings.llm.queries import QUERIES

from .helpers import documents, words


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model(pieces: list[tuple[str, float]], byte_fallback: bool, squeeze: bool = False) -> bytes:
    """A serialised unigram model with the given pieces: not trained, written down."""
    all_pieces = [("<unk>", 0.0, wfst.UNKNOWN), ("<s>", 0.0, wfst.CONTROL), ("</s>", 0.0, wfst.CONTROL)]
    if byte_fallback:
        all_pieces += [(f"<0x{b:02X}>", 0.0, wfst.BYTE) for b in range(256)]
    all_pieces += [(p, s, wfst.NORMAL) for p, s in pieces]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in all_pieces)
    out += _field(2, _field(3, 1) + (_field(35, 1) if byte_fallback else b""))
    return out + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, int(squeeze)) + _field(5, 1))


PIECES = [("▁", -3.0), ("a", -2.5), ("b", -2.75), ("c", -4.0), ("ab", -3.5), ("abc", -5.0), ("▁a", -2.0), ("▁ab", -4.5), ("bc", -3.25), ("ca", -6.0), ("aa", -3.0), ("é", -5.5), ("▁the", -1.5), ("th", -3.0), ("he", -3.125), ("t", -4.0), ("e", -4.25), ("h", -4.5)]
TEXT = st.text("abc  théx\n😀", max_size=30)


@pytest.mark.parametrize("fallback", [False, True])
def test_shortest_path_is_the_librarys(fallback):
    data = model(PIECES, fallback)
    fst, sp = wfst.load(data), sentencepiece.SentencePieceProcessor(model_proto=data)

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def check(text):
        assert fst.encode(text) == sp.encode(text)

    check()


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", max_size=10))
def test_no_segmentation_is_cheaper(text):
    fst = wfst.load(model(PIECES, True))
    whole = fst.normalise(text)
    cost = {p: -s for p, s in PIECES}

    def least(s: str) -> float:
        return 0.0 if not s else min([cost[s[:k]] + least(s[k:]) for k in range(1, len(s) + 1) if s[:k] in cost])

    got = sum(cost[fst.texts[i].decode()] for i in fst.encode(text))
    assert got == pytest.approx(least(whole))


def plain_path(fst: wfst.Transducer, text: str) -> list[int]:
    """The shortest path of one text by a plain table over its places, from the model's pieces alone."""
    score = {p: (-w, i) for i, (p, w, k) in enumerate(fst.pieces) if k == wfst.NORMAL}
    s, longest = fst.normalise(text), max(map(len, score))
    cost, back = [0.0] + [float("inf")] * len(s), [(0, -1)] * (len(s) + 1)
    for i in range(len(s)):
        for n in range(1, min(longest, len(s) - i) + 1):
            w, piece = score.get(s[i : i + n], (fst.fallback if n == 1 else float("inf"), -1))
            if cost[i] + w < cost[i + n]:
                cost[i + n], back[i + n] = cost[i] + w, (i, piece)
    out, at = [], len(s)
    while at:
        i, piece = back[at]
        out[:0] = [piece] if piece >= 0 else fst.byte_ids[list(s[i:at].encode())].tolist()
        at = i
    return out


def test_the_querys_model_on_its_table_against_a_plain_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op8_sentencepiece_wfst"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:120]:
        assert got[r.doc_id].ids == plain_path(_public(), r.text or "") and got[r.doc_id].round_trip


@settings(max_examples=100, deadline=None)
@given(st.text("the cat ▁é😀\n12", max_size=40))
def test_the_public_model_against_a_plain_table(text):
    assert _public().encode(text) == plain_path(_public(), text)


def test_windows_and_long_parts_change_nothing(monkeypatch):
    fst = wfst.load(model(PIECES, True))
    texts = ["ab c thé the" * 9, "", "a" * 3000 + "bc" * 700, "cab" * 50, "😀x" * 80, " "]
    want = [fst.encode(t) for t in texts]
    assert want == [plain_path(fst, t) for t in texts] == fst.encode_all(texts)
    for window, steps in ((16, 1000), (40, 5), (1 << 19, 3)):
        monkeypatch.setattr(wfst, "WINDOW", window)
        monkeypatch.setattr(wfst, "MANY_STEPS", steps)
        assert fst.encode_all(texts) == want


def test_rules_rewrite_leftmost_and_longest():
    pieces = [("<unk>", 0.0, wfst.UNKNOWN)] + [(c, -1.0, wfst.NORMAL) for c in "▁abcfixyz"]
    rules = {"ﬁ": "fi", "xy": "a", "xyz": "bc", "yz": "c", "q": "", "\t": " "}
    fst = wfst.Transducer(pieces, rules)
    for text, want in (("ﬁxyz", "▁fibc"), ("xyyz", "▁ac"), ("qq", ""), ("xyxyz q x", "▁abc▁x"), ("\t a\t\tb ", "▁a▁b")):
        assert fst.normalise(text) == want and "".join(pieces[i][0] for i in fst.encode(text)) == want


def test_a_megabyte_without_spaces_is_encoded():
    text = "abcdefghijkl" * 90_000
    assert _public().decode(_public().encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_exact_round_trip(text):
    fst = _public()
    assert fst.decode(fst.encode(text)) == text and _library().decode(fst.encode(text)) == text


_cache: dict = {}


def _public() -> wfst.Transducer:
    return wfst.compiled(wfst.default_model())


def _library() -> sentencepiece.SentencePieceProcessor:
    if "sp" not in _cache:
        _cache["sp"] = sentencepiece.SentencePieceProcessor(model_file=wfst.default_model())
    return _cache["sp"]


def test_tables(spark):
    texts = [(1, None), (2, ""), (3, "the cat\n\nsat  down"), (3, "the cat\n\nsat  down"), (4, words(20_000)), (5, "a" * 5000 + "😀" * 200), (6, "</s><s><unk>▁ ▁")]
    rows = wfst.encode(documents(spark, texts, extra=True)).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows if r.doc_id != 6) and all(r.n_tokens == len(r.ids) for r in rows)
    back = wfst.decode(wfst.encode(documents(spark, texts)))
    assert {r.doc_id: r.text for r in back.collect() if r.doc_id != 6} == {d: t or "" for d, t in texts if d != 6}
    assert wfst.encode(documents(spark, [])).count() == 0
    assert {r.doc_id: r.ids for r in rows}[4] == _public().encode(texts[4][1]) and min(i for r in rows for i in r.ids) > 2


def test_normaliser_windows_agree_with_whole_texts(monkeypatch):
    """Rules whose matches start before, at and after every end of a window."""
    import random

    rules = {"a": "1", "ab": "22", "abc": "", "bcd": "long one", "  ": " ", "é": "e", "cdab": "X"}
    machine = wfst.Transducer([("x", -1.0, wfst.NORMAL)], rules)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(60))) for _ in range(60)] + ["abcd" * 50, "", "é"]
    whole = [machine.normalise(t) for t in texts]
    for window in (1, 2, 3, 7):
        monkeypatch.setattr(wfst, "WINDOW", window)
        assert [machine.normalise(t) for t in texts] == whole
        assert machine.normalised(texts).tolist() == [c for t in texts for c in machine.normalised([t]).tolist()]
