"""Events of pages: plain markup beside the standard parser, texts across its pieces, and the time of long pages."""

from __future__ import annotations

import random
import time

from hustings.sources import markup


def pulled(page: str) -> list[tuple]:
    """Events of the standard parser over the whole page, adjacent texts as one."""
    parser = markup._Pull()
    parser.feed(page)
    parser.close()
    out: list[tuple] = []
    for kind, what, attrs in parser.found:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + what, {})
        else:
            out.append((kind, what, attrs))
    return out


def joined(events) -> list[tuple]:
    out: list[tuple] = []
    for kind, what, attrs in events:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + what, {})
        else:
            out.append((kind, what, attrs))
    return out


def test_texts_are_whole_wherever_a_page_is_cut():
    page = "<!-- x -->" + "".join(f"<p>Ann &amp; Member number {i} of the house</p>" for i in range(9000))
    assert len(page) > 4 * markup.PIECE
    texts = [what for kind, what, _ in markup.events(page) if kind == "text"]
    assert texts == [f"Ann & Member number {i} of the house" for i in range(9000)]


def test_plain_markup_is_read_as_the_parser_reads_it():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<DIV Class='a b'>", "</Div>", "<td colspan=3>", "<td colspan=3/>", "<br/>", "<br />", "<a href=\"x?a&amp;b\">", "<a href='/x' id=\"\">", "&amp;", "&nbsp", "a < b", " Ann ", "<!-- c -->", "<!doctype html>", "<script>if (a<b) '<p>'</script>",
             "<style>p{}</style>", "<template>t</template>", "<title>a<b></title>", "<x-y>", "<a b>", "<a b = c>", "</p >", "<", "<3", "&#39;", "<textarea><p></textarea>", "\n", "<a b=c d=e>", "<p/a>", "<?x?>", "</>"]
    for n in (4, 8):
        for _ in range(3000):
            page = "".join(rng.choice(parts) for _ in range(n))
            assert joined(markup.events(page)) == pulled(page), page


def test_long_floor_votes_are_read_in_time():
    names = "".join(f"<div class='vote-name'><div class='vote'>Y</div><div class='name'>M. O&#39;Neil-{i}</div></div>\n" for i in range(100000))
    page = f"<h3>Floor&nbspVotes:</h3><table><caption><span>Senate Vote DATE:</span><span>03/01/2026</span> YEA/NAY: 5/0</caption></table>{names}"
    begun = time.time()
    got = [r[5] for r in markup._floor_votes(page)]
    assert time.time() - begun < 4
    assert got == [f"M. O'Neil-{i}" for i in range(100000)]
