from __future__ import annotations

import math
import re
from collections import Counter

from hustings.llm import licenses
from hustings.llm.queries import ORACLES, QUERIES
from tests.oracle import same


def files(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("digest", "k", "part", "term", "dir", "licence", "share", "from_dir")})


def brute(rows, threshold=licenses.THRESHOLD):
    """Every line and every text against every template with plain dictionaries."""
    tok = lambda t: [x for x in re.split(r"[^a-z0-9\u0080-\U0010FFFF]+", (t or "").lower()) if x]
    df = Counter(t for _, _, text in rows for t in set(tok(text)))
    idf = {t: math.log((len(rows) + 1) / (df[t] + 1)) + 1 for _, x in licenses.TEMPLATES for t in tok(x)}
    vec = lambda c: {t: n * idf.get(t, 1.0) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    units = [(name, vec(Counter(tok(x)))) for name, x in licenses.TEMPLATES]
    own = {}
    for d, p, text in rows:
        best = None
        for k, part in [(-1, text or ""), *enumerate((text or "").split("\n"))]:
            v = vec(Counter(tok(part)))
            for name, u in units if v else []:
                s = round(sum(x * u.get(t, 0) for t, x in v.items()) / norm(v) / norm(u), 6)
                if s >= threshold:
                    best = min(best or (0, "~", 0, 0), (-s, name, k, len(tok(part))))
        own[d] = (best[1], -best[0], best[3] / max(1, len(tok(text))) >= licenses.FILE_SHARE) if best else (None, None, False)
    parent = lambda p: (p or "").rpartition("/")[0]
    dirs = {}
    for d, p, _ in rows:
        if own[d][2]:
            dirs[parent(p)] = min(dirs.get(parent(p), (1,)), (-own[d][1], own[d][0], p))
    out = []
    for d, p, _ in rows:
        at, found = parent(p), None
        while found is None:
            if at in dirs:
                found = (at, dirs[at][1])
            elif not at:
                break
            at = parent(at)
        out.append((d, *own[d], own[d][0] or (found and found[1]), found[0] if found and not own[d][0] else None))
    return sorted(out, key=str)


MIT = dict(licenses.TEMPLATES[::-1])["MIT"]
ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.py", "print(1)\nnothing here"),
    (3, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0.\n"),
    (4, "a/b/c/d/y.py", "code " * 3000),
    (5, "z/y.py", "code\n" + "word " * 50 + "\n# Licensed under CC BY-NC 4.0."),
    (6, None, None),
    (7, "README", ""),
    (8, "a/b/c/d/z.py", MIT + "\n" + "more words of its own " * 30),
    (9, "q/both", "Released under the MIT License.\nReleased under the MIT License."),
    (10, "q/w/e", "the license of this text is not told, the rest is prose"),
    (11, "a/LICENSE2", "All rights reserved."),
    (12, "ü/ä/é.txt", "Wörter ß and words"),
]


def scan(spark, rows):
    return licenses.scan(files(spark, rows))


def test_agrees_with_brute_force(spark):
    got = scan(spark, ROWS + [(12, "ü/ä/é.txt", "Wörter ß and words")])
    names = ("doc_id", "licence", "similarity", "licence_file", "effective_licence", "from_dir")
    want = brute(ROWS + [(12, "ü/ä/é.txt", "Wörter ß and words")])
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want
    by = {w[0]: w for w in want}
    assert by[2][4] in ("MIT", "All-Rights-Reserved") and by[2][5] == "a" and by[4][4:] == ("Apache-2.0", "a/b/c") and by[5][1] == "CC-BY-NC-4.0" and not by[5][3] and by[10][1] is None and by[10][4:] == ("MIT", "q")


def test_empty(spark):
    assert scan(spark, []).count() == 0


def test_cues_keep_every_match():
    """A passage without a cue is below the threshold whatever else it holds."""
    docs = [(i, None, t) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    df = Counter(t for _, _, x in docs for t in licenses.terms_of(x))
    idf, vectors = licenses.weigh(licenses.TEMPLATES, len(docs), df)
    chosen = set(licenses.cues(vectors, idf, licenses.THRESHOLD))
    for k in {v[0] for v in vectors}:
        assert math.sqrt(sum(w * w for n, _, t, w in vectors if n == k and t not in chosen)) < licenses.THRESHOLD


def test_agrees_with_oracle(spark):
    same(QUERIES["op4_license_cosine"](spark, "/root/testdata/sf0.001"), ORACLES["op4_license_cosine"], "/root/testdata/sf0.001")


def test_plan_has_no_python(spark):
    plan = QUERIES["op4_license_cosine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wrapped_notices_atop_long_files_are_found(spark):
    """Comment blocks, wrapped at 72 columns, above 300 lines of code."""
    import textwrap

    code = "\n".join(f"    value_{i} = compute(alpha_{i}, beta_{i})" for i in range(300))
    notices = [(k, name, text) for k, (name, text) in enumerate(licenses.TEMPLATES) if len(text) > 150]
    rows = [(k, f"src/{k}.py", f"# {name} file\n#\n" + "\n#\n".join(textwrap.fill(x, 72, initial_indent="# ", subsequent_indent="# ") for x in (text[: len(text) // 2 + text[len(text) // 2 :].index(" ")], text[len(text) // 2 + text[len(text) // 2 :].index(" ") :])) + "\n" + code) for k, name, text in notices]
    got = {r.doc_id: r for r in scan(spark, rows + [(99, "src/x.py", code)]).collect()}
    assert {k: got[k].licence for k, _, _ in notices} == {k: name for k, name, _ in notices} and len(notices) >= 5
    assert all(got[k].similarity > 0.9 and not got[k].licence_file for k, _, _ in notices) and got[99].licence is None


def test_any_large_passage_makes_a_licence_file(spark):
    """A short line that matches better than the whole text leaves the file a licence file."""
    bsd = max((x for name, x in licenses.TEMPLATES if name == "BSD-3-Clause"), key=len)
    rows = [(1, "b/LICENSE", "Copyright 2020 A. Uthor\nAll rights reserved.\n" + bsd), (2, "b/c/x.py", "print(1)"), (3, "m/LICENSE", "Released under the MIT License.\n" + MIT.replace(" sell ", " vend ")), (4, "m/x.py", "print(2)"), (5, "n/x.py", "All rights reserved.\n" + "code " * 50), (6, "n/y.py", "print(3)")]
    got = {r.doc_id: r for r in scan(spark, rows).collect()}
    assert got[1].licence == "All-Rights-Reserved" and [got[k].licence_file for k in (1, 3, 5)] == [True, True, False]
    assert (got[2].effective_licence, got[2].from_dir) == ("BSD-3-Clause", "b") and (got[4].effective_licence, got[4].from_dir) == ("MIT", "m") and got[6].effective_licence is None


def test_long_lines_beside_a_wrapped_notice(spark):
    """Lines of half a megabyte, each with a cue, end the runs before them and are not copied into them."""
    import textwrap
    import time

    long = ["MIT License " + " ".join(f"term{j}x{i}" for i in range(40_000)) for j in range(40)]
    notice = textwrap.fill(MIT, 72)
    rows = [(1, "a/x.py", "\n".join([*long[:20], notice, *long[20:]])), (2, "b/x.py", "\n".join(long)), (3, "c/x.py", "\n".join(" ".join([MIT] * 300) for _ in range(10)))]
    begun = time.time()
    got = {r.doc_id: r for r in scan(spark, rows).collect()}
    assert got[1].licence == "MIT" and got[1].similarity > 0.9 and not got[1].licence_file
    assert got[2].licence is None and got[3].licence == "MIT" and got[3].licence_file
    assert time.time() - begun < 120


def test_hot_digests_beyond_the_broadcast(spark):
    rows = [(k, f"d{k % 3}/{k}.py", "Released under the MIT License.") for k in range(200)] + [(500 + k, f"e/{k}.py", f"All rights reserved.\n{k}") for k in range(5)] + [(900, None, None)]
    some = lambda limit: sorted((tuple(r) for r in licenses.scan(files(spark, rows), limit=limit).collect()), key=str)
    assert some(0) == some(1000) and len(some(0)) == len(rows)
