"""Main texts of pages: markup, names, templates of sites, odd rows."""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tagsim.llm.html_text import extract_text, op13_html_text, with_contexts
from tagsim.llm.page_tree import Page
from tests.helpers import SMALL

SCHEMA = "page_id long, url string, html string"


def text_of(markup: str) -> str:
    return "\n".join(Page(markup).article()[0])


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("", ""),
        ("no markup  at\nall", "no markup at all"),
        ("<p>one<p>two <b>bold</b>ly<br>on</p>tail", "one\ntwo boldly on\ntail"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("a &amp; b &lt;i&gt; &eacute;&#233;&#x4e2d; &copy 1 &am &nbsp; x", "a & b <i> éé中 © 1 &am x"),
        ("<title>no</title><style>p{}</style><script>var t='<p>';</script><p>yes</p><script>if (a</b/) {}", "yes"),
        ("<p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p>x</p><!-- open <p>no", "1 < 2 and 3 > 2\nx"),
        ("<!--><p>x</p><!-- --!><p>y</p>", "x\ny"),
        ("<p title='a > b' data-x=\"</p>\">ok</p>", "ok"),
        ("<p class=\"a>cut off", "cut off"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "one\ntwo\nin\nthree"),
        ("<table><tr><td>a<td>b<tr><th>c</th><th>d</th></table>", "a b\nc d"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
        ("<b><p>x</b>y</p>z", "xy\nz"),
        ("<head><meta charset=utf-8><title>t</title><div>body begins</div>", "body begins"),
        ("<nav>menu<article><p>the article", "the article"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>x</p><footer>by</footer></article>", "Title\nx"),
        ("<form><main><p>x</p><input><button>Go</button></main></form>", "x"),
        ("<div class='page no-sidebar'><p>x</p></div><div class='rightSidebar'>s</div><div id=cookieNotice>c</div><div class=adSlot>a</div>", "x"),
        ("<article><p>x</p></article><section id='comments'><article class=comment>c</article></section>", "x"),
        ("<div class='entry-header'><h1>t</h1></div><p>x</p><div class='site-header'>no</div>", "t\nx"),
        ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p role=alert>no</p><p>yes</p>", "yes"),
        ("<p>x <span class=ad>buy</span> y <a class='share-link' href=/>share</a></p>", "x y"),
        ("<pre><span class='comment'># c</span> code</pre>", "# c code"),
        ("<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p>See <a href=4>this</a>.</p>", "See this."),
        ("<main><h1>t</h1><article><p>x</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></article><aside>s</aside></main><div>no</div>", "t\nx\na\nb\nc"),
        ("<svg><text>no</text></svg><noscript><p>no</p></noscript><iframe>no</iframe><p>yes", "yes"),
    ],
)
def test_markup(markup, text):
    assert text_of(markup) == text


def test_broken_and_deep_markup_ends():
    deep = "<div>" * 20_000 + "x" + "</div>" * 10_000 + "<p>y"
    assert text_of(deep) == "x\ny"
    assert text_of("<b>" * 50_000 + "x</i></b><p>y") == "x\ny"
    assert text_of("<a " * 50_000) == "" and text_of("<a \"" * 20_000 + ">x") == "x"
    assert text_of("</p>" * 50_000 + "x &amp" * 1000).startswith("x &x &")
    long = "word " * 400_000
    assert text_of(f"<article><p>{long}</p></article>") == long.strip()


def test_elements_know_their_blocks_and_contexts():
    blocks, elements, inside = Page("<div><p>short</p><p>a longer one</p></div><p>the longest block of all</p>").article()
    assert blocks == ["short", "a longer one", "the longest block of all"] and not inside
    assert sorted(e[1:] for e in elements) == [(0, 1), (0, 2), (1, 2), (2, 3)]
    again = Page("<p>x</p><div class=x><p>short</p> <p>a <b>longer</b> one</p></div>").article()
    assert {e[0] for e in elements} & {e[0] for e in again[1] if e[2] - e[1] == 2}
    page, own = with_contexts(blocks, elements)
    by = {e[1:3]: e[3] for e in own}
    assert by[0, 1] == by[0, 2] == by[1, 2] == page and by[2, 3] not in (page, 0)
    assert with_contexts(["x"], [(5, 0, 1)])[1] == [(5, 0, 1, 0)]


def prose(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(n))


def site(draw: random.Random, host: str, n: int, inside: bool):
    """(url, html, text) of n pages with a subscription box, a legal block and a section's note as divs without names."""
    for i in range(n):
        paragraphs = [prose(draw, draw.randint(3, 60)) for _ in range(draw.randint(1, 6))]
        box = "<div><h4>Stay informed</h4><p>Sign up here and never miss a story again, each morning in your mail</p></div>"
        note = f"<div>Section note</div>" if i % 5 else ""
        body = f"<h1>{i} title</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs[:1]) + box + "".join(f"<p>{p}</p>" for p in paragraphs[1:]) + note
        body = f"<article>{body}</article>" if inside else f"<div>{body}</div>"
        yield f"https://{host}/{i}", f"<html><body><div>Company name</div>{body}<div>Imprint</div></body></html>", "\n".join([f"{i} title", *paragraphs])


def test_templates_of_a_site_go_and_copies_stay(spark):
    draw = random.Random(5)
    rows = [*site(draw, "plain.example.org", 40, False), *site(draw, "tagged.example.org", 40, True)]
    # exact and near copies of one article are most of a host's pages
    copied = [prose(draw, 50) for _ in range(4)]
    for i in range(60):
        own = copied if i % 3 == 0 else [*copied[:2], prose(draw, 30), copied[3]] if i % 3 == 1 else [prose(draw, 40)]
        rows.append((f"http://copies.example.org/{i}", "<div>" + "".join(f"<p>{p}</p>" for p in own) + "</div>", "\n".join(own)))
    # a passage that a third of the texts share, in articles
    for i in range(60):
        own = [prose(draw, 40), *(["Released under a licence"] if i % 3 == 0 else [])]
        rows.append((f"http://shared.example.org/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in own) + "</article>", "\n".join(own)))
    # hosts of two pages have no template
    rows += [(f"http://two.example.org/{i}", f"<div><p>{i} own</p><p>same</p></div>", f"{i} own\nsame") for i in range(2)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], SCHEMA)
    for n in (1, 6):
        got = {r["page_id"]: r for r in extract_text(df.repartition(n)).collect()}
        assert [got[i]["text"] for i in range(len(rows))] == [t for _, _, t in rows]
        assert [got[i]["n_chars"] for i in range(len(rows))] == [len(t) for _, _, t in rows]
        assert got[0]["n_template"] == 4 and got[1]["n_template"] == 5 and got[41]["n_template"] == 3


def test_templates_are_those_of_a_plain_count(spark, monkeypatch):
    """Counts per host against dictionaries, with templates joined as tables."""
    import tagsim.llm.html_text as module

    draw = random.Random(9)
    parts = [prose(draw, k % 7 + 1) for k in range(12)]
    rows = [(i, f"x://h{draw.randint(0, 3)}/{i}", "".join(f"<{t}><p>{draw.choice(parts)}</p>{prose(draw, 1)}</{t}>" for t in draw.choices(["div", "section", "article"], k=draw.randint(0, 5)))) for i in range(150)]
    contexts, hosts, read = defaultdict(set), defaultdict(set), {}
    for i, u, h in rows:
        host, (blocks, elements, inside) = u[4:6], Page(h).article()
        context, own = with_contexts(blocks, elements) if blocks else (None, [])
        read[i] = host, blocks, own, inside
        if blocks:
            hosts[host].add(context)
        for x, _, _, c in own:
            contexts[host, x].add(c)
    want, n_gone = {}, 0
    for i, (host, blocks, own, inside) in read.items():
        least, share = (5, 0.8) if inside else (3, 0.5)
        gone = {b for x, low, high, _ in own for b in range(low, high) if len(contexts[host, x]) >= max(least, share * len(hosts[host]))}
        n_gone += len(gone)
        want[i] = "\n".join(b for k, b in enumerate(blocks) if k not in gone)
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (200_000, 0):
        monkeypatch.setattr(module, "MAX_TEMPLATES", most)
        monkeypatch.setattr(module, "HELD", 100 if most else 8 << 20)
        assert {r["page_id"]: r["text"] for r in extract_text(df).collect()} == want
    assert n_gone > 0


def test_odd_rows(spark):
    page = "<p>a</p>"
    rows = [(1, None, page)] * 3 + [(2, "no host", page), (3, "x://h/1", None), (4, "x://h/2", ""), (None, "x://h/3", page), (5, "x://h/4", "<nav>n</nav>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("html", "url", "page_id", "'x' AS text", "1 AS host", "2 AS hash", "'b' AS blocks", "3 AS row_key")
    got = sorted(map(tuple, extract_text(df).collect()), key=repr)
    want = [(1, None, "a", 1, 0)] * 3 + [(2, "no host", "a", 1, 0), (3, "x://h/1", "", 0, 0), (4, "x://h/2", "", 0, 0), (None, "x://h/3", "a", 1, 0), (5, "x://h/4", "", 0, 0)]
    assert got == sorted(want, key=repr)
    empty = extract_text(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars", "n_template"]


def test_query_returns_the_articles_of_the_test_pages(spark):
    """Their articles hold headings, paragraphs, line breaks and bold text only."""
    want = {}
    for i, url, page in duckdb.sql(f"SELECT page_id, url, html FROM '{SMALL}/pages.parquet'").fetchall():
        article = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want[i] = (url, "\n".join(b for b in blocks if b))
    got = {r["page_id"]: (r["url"], r["text"]) for r in op13_html_text(spark, SMALL).collect()}
    assert got == want
