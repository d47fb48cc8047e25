from __future__ import annotations

import hashlib
import math
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from hustings.llm import secrets
from hustings.llm.queries import QUERIES

from .helpers import documents

BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The contract's patterns as they stand, failing matches dropped."""
    found = [(m.start(), list(BASE).index(k), m.end(), k) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m)]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def segment_costs(value: str, a: int, b: int) -> list[float]:
    """What the span (a, b) costs as one segment of each kind that it can be, from the definitions alone."""
    words, low = secrets.dictionary(), value.lower()
    part, n, out = low[a:b], b - a, []
    plain = part.translate(secrets.LEET)
    if part in words.ranks:
        out.append(words.ranks[part] + secrets.SEGMENT * (part != value[a:b]))
    elif plain in words.ranks:
        out.append(words.ranks[plain] + secrets.SEGMENT + secrets.SEGMENT * (part != value[a:b]))
    out += [math.log10(guesses) for pattern, guesses in secrets.DATES if pattern.fullmatch(value[a:b])]
    if n >= 3 and len(set(part)) == 1:
        out.append(math.log10(40) + math.log10(n))
    if n >= 3 and all(map(secrets._near, part, part[1:])):
        steps = [ord(y) - ord(x) for x, y in zip(part, part[1:])]
        flat = any(part in row or part in row[::-1] for row in secrets.ROWS)
        out.append(math.log10(40) + math.log10(n) + (0 if flat else math.log10(3) * sum(x != y for x, y in zip(steps, steps[1:]))))
    return out


def least_cost(value: str) -> float:
    """The cheapest segmentation, trying every span of every kind at every place."""
    brute = secrets.alphabet(value)
    best = [0.0]
    for b in range(1, len(value) + 1):
        best.append(min([best[b - 1] + brute, *(best[a] + c + (secrets.SEGMENT if a else 0) for a in range(b) for c in segment_costs(value, a, b))]))
    return best[-1]


def test_every_document_matches_the_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op3_secret_guess_cost"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in base) for x in BASE)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("guess") and x] == [x for x in joined.split(",") if x]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "api_key", " ", ":", "=", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "é", "x" * 9, "token", "\n"]), max_size=14))
def test_patterns_on_any_text(parts):
    text = "".join(parts)
    assert [(s, e, k) for s, e, k, *_ in secrets.find_spans(text) if k != "guess"] == base_spans(text)


def test_guess_costs_order_values():
    weak = ["password", "qwerty123", "aaaaaaaa", "2024-01-31", "dragon1999", "Summer2024"]
    strong = ["x9$Lq2!vT8#z", "kJ8sd02LqPz7", "7f3e9a1c5b2d8e4f"]
    assert max(secrets.guess_cost(v)[0] for v in weak) < secrets.MIN_LOG10 < min(secrets.guess_cost(v)[0] for v in strong)
    assert [k for *_, k in secrets.guess_cost("qwerty2024-01-31aaaa")[1]] == ["word", "date", "repeat"]


PARTS = ["password", "pass", "d", "dd", "dddddd", "qwertyuiop", "poiuy", "qaz", "asdfdsa", "2024", "01", "31", "-", "1999", "123", "321", "aaa", "P@ss", "x9$", "zz", "Dragon", "tr0ub4dor", "é"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=6).map("".join), st.text("abqwesd129-0$Q", max_size=16)))
def test_segmentation_is_the_cheapest_of_all(value):
    cost, parts = secrets.guess_cost(value)
    assert abs(cost - least_cost(value)) < 1e-9
    assert [b for _, b, _ in parts[:-1]] == [a for a, *_ in parts[1:]] and (not value or (parts[0][0], parts[-1][1]) == (0, len(value)))


def test_runs_give_up_characters_to_words():
    assert abs(secrets.guess_cost("password" + "d" * 14)[0] - (math.log10(2) * 2 + math.log10(40) + math.log10(14))) < 1e-9


def test_long_values_and_many_contexts_take_time_in_proportion():
    secrets.dictionary()
    for text in ("password=" + "ab1" * 60_000 + "!", "pwd: " + "a" * 200_000, "token = abcdefgh1;" * 30_000):
        began = time.process_time()
        secrets.find_spans(text)
        assert time.process_time() - began < 20


def test_context_values_become_spans():
    text = "pwd is x9$Lq2!vT8#z and auth: password"
    assert [k for _, _, k, *_ in secrets.find_spans(text)] == ["guess"]
    assert secrets.redact_text(text) == "pwd is [SECRET] and auth: password"


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "password=" + "a" * 100_000), (3, "password=" + "a" * 100_000), (4, "token: short")]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows, extra=True)).collect()}
    assert got[1].spans == got[2].spans == got[4].spans == "" and got[3].n_assign == 1 and secrets.scan(documents(spark, rows)).count() == 5
    assert secrets.scan(documents(spark, [])).count() == 0
    done = secrets.redact(documents(spark, rows, extra=True))
    assert {r.doc_id: (r.text, r.n_chars) for r in done.collect()}[3] == ("password=[SECRET]", 17) and done.columns[-1] == "copies"


def test_names_with_prefixes_and_suffixes_open_a_context():
    value = "x9$Lq2!vT8#z"
    for name in ("AWS_SECRET_ACCESS_KEY", "secret_key", "db_pwd", "encryption_key", "DB_PASSWORD", "auth_token_v2", "dbPassword", "PGPASSWORD", "clientSecret1", "x-auth"):
        for text in (f"{name}={value}", f'"{name}": "{value}"', f"{name} = '{value}' # note"):
            assert secrets.redact_text(text) == text.replace(value, "[SECRET]"), text
    assert secrets.redact_text('client_secret="p@ss-w0rd!x"') == 'client_secret="[SECRET]"'
    assert secrets.redact_text("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == "AWS_SECRET_ACCESS_KEY=[SECRET]"
    for text in ("compass: x9$Lq2!vT8#z", "author: x9$Lq2!vT8#z", "password_hint: welcome"):
        assert secrets.find_spans(text) == []


def test_quoted_values_and_letters_are_priced_whole():
    assert secrets.redact_text('passphrase: "correct horse battery staple" # ours') == 'passphrase: "[SECRET]" # ours'
    assert secrets.redact_text("pwd = 'a \\' quoted b' x") == "pwd = '[SECRET]' x"
    assert secrets.redact_text("pwd: qzkvwmtrbh") == "pwd: [SECRET]"
    assert secrets.redact_text('pwd: "x9$Lq2!vT8#z') == 'pwd: "[SECRET]'  # no closing quote


def test_a_value_beyond_its_base_span_is_costed_whole():
    text = "password = Tr0ub4dor&3-horse; token=abcdefgh1234"
    assert [(k, text[s:e]) for *_, k, s, e in secrets.find_spans(text)] == [("assign", "Tr0ub4dor"), ("guess", "Tr0ub4dor&3-horse;"), ("assign", "abcdefgh1234")]
    assert secrets.redact_text(text) == "password = [SECRET] token=[SECRET]"
    assert secrets.redact_text('"password": "Tr0ub4dor&3 horse", x') == '"password": "[SECRET]", x'


REFERENCES = ["${DB_PASSWORD}", "$SECRET_TOKEN", "$(pass show db)", "%DB_PASSWORD%", "{{ vault.password }}", "<your-password>", "os.environ['DB_PASSWORD']", "getToken(user.session)", "process.env.API_KEY", "config.get(\"password\")", "the_user_password_from_config", "settings.database.password;", "secrets[name]", "requestTokenFromServer"]


def test_references_are_no_secrets():
    for value in REFERENCES:
        for name in ("pwd", "auth", "db_pass"):
            assert [k for _, _, k, *_ in secrets.find_spans(f"{name} = {value}")] == [], value
    assert secrets.redact_text("pwd = x9$Lq2!vT(8#z") == "pwd = [SECRET]" and secrets.redact_text('pwd = "getToken_but_in_quotes"') == 'pwd = "[SECRET]"'


def test_letters_without_case_are_priced_as_many():
    assert secrets.guess_cost("密码口令安全")[0] > 6 * 3 and secrets.guess_cost("qzkvwm")[0] == 6 * math.log10(26)


def test_precision_and_recall_on_planted_values():
    """Four hundred values in contexts that no base pattern reads: random ones and passphrases against words, dates, walks
    and references."""
    import random
    import string

    rng = random.Random(7)
    common = [w for w in secrets.dictionary().ranks if w.isalpha() and len(w) > 3][:3000]
    pool = string.ascii_letters + string.digits + "!$%&*+-/"
    good = ["".join(rng.choice(pool) for _ in range(rng.randrange(10, 40))) for _ in range(120)] + ['"' + " ".join(rng.choice(common) for _ in range(5)) + '"' for _ in range(80)]
    weak = lambda: rng.choice([rng.choice(common[:200]) + str(rng.randrange(1950, 2026)), rng.choice(["qwertyuiop", "asdfghjkl", "1234567890", "zxcvbnm1"]), f"{rng.randrange(1950, 2026)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}", rng.choice("abcxyz1") * rng.randrange(8, 30), rng.choice(common[:500])])
    bad = [weak() for _ in range(150)] + [rng.choice(REFERENCES) for _ in range(50)]
    found = lambda v: bool(secrets.find_spans(f"Some text, then\nauth: {v}\nand more"))
    hits, false = sum(map(found, good)), sum(map(found, bad))
    assert hits / len(good) >= 0.97 and hits / (hits + false) >= 0.97


def test_every_context_value_is_costed(spark):
    rows = [(1, "password=dragon1999 and token: x9$Lq2!vT8#z"), (2, "nothing"), (3, None)]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    assert got[1].n_costed == 2 and got[1].n_assign == 1 and [c.split(":")[3] for c in got[1].costs.split(",")] == ["word+date", "brute"]
    start, end, cost, _ = got[1].costs.split(",")[0].split(":")
    assert rows[0][1][int(start) : int(end)] == "dragon1999" and abs(float(cost) - secrets.guess_cost("dragon1999")[0]) < 0.01
    assert (got[2].n_costed, got[2].costs, got[3].n_costed) == (0, "", 0)
