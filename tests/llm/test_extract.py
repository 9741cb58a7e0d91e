"""Main text extraction on layouts whose article is known."""
import html
import math
import random
import re
import time

import pytest

from canopy.llm import extract
from canopy.llm.extract import Page, content_nodes, main_text
from llm_tables import SF001

P = ["The first paragraph of the article has quite a few words in it, as articles do.",
     "A second paragraph follows; it is no shorter than the first and ends properly.",
     "Finally, a third paragraph closes the piece with a few more words of text."]
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(8)) + "</ul>"
BODY = "".join(f"<p>{p}</p>" for p in P)


@pytest.mark.parametrize("page", [
    f"<html><body><nav>{LINKS}</nav><article><h1>Head</h1>{BODY}</article><footer>&copy; 2020 all rights</footer></body></html>",
    f"<body><div class='menu'>{LINKS}</div><div id=main><h1>Head</h1>{BODY}</div><div class=\"sidebar\"><p>Buy our things now, they are cheap.</p></div>",
    f"<div><header>Site name</header><main><article><header><h1>Head</h1></header>{BODY}</article></main><aside>{BODY}</aside></div>",
    f"<article><h1>Head</h1><script>var x = '</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> -->{BODY}<form><p>Your name please</p><input></form></article>",
    f"<body><div class='cookie-notice'>We use cookies to make this a better site for you.</div><article><h1>Head</h1>{BODY}"
    f"</article><section id='comments'><p>Great article, thanks for it, I read it all!</p></section></body>",
    f"<BODY><ARTICLE><H1>Head</H1>{BODY.replace('<p>', '<P><B>').replace('</p>', '<BR>')}</ARTICLE></BODY>",
    f"<body><article><h1>Head{BODY}",  # nothing is closed
])
def test_article_is_found(page):
    assert extract.main_text(page) == "\n".join(["Head", *P])


MENU, AD = f"<nav>{LINKS}</nav>", "<div class='ad'><p>Buy our things now.</p></div>"


@pytest.mark.parametrize("page", [
    *(f"<body>{MENU}<div class='{c}'><h1>Head</h1>{BODY}{AD}</div><footer>end</footer></body>"
      for c in ("content has-sidebar", "content-sidebar-wrap", "post no-comments", "content", "sidebar")),
    f"<body><div data-id='menu' title='x class=ad'><h1>Head</h1>{BODY}</div></body>",
    f"<body><form id=all action='/'>{MENU}<div><h1>Head</h1>{BODY}</div>{AD}<input></form></body>",
    f"<body><form><article><h1>Head</h1>{BODY}</article><div class='related'>{BODY}{BODY}</div></form></body>",
    f"<body>{MENU}<div class='ad'>Buy our things now.<article><h1>Head</h1>{BODY}</article></body>",
    f"<body>{MENU}<div class='ad'>Buy our things now.<div id='text'><h1>Head</h1>{BODY}</div></body>",
    f"<head><meta charset=utf-8><body><h1>Head</h1>{BODY}</body>",
    f"<body><article><h1>Head</h1>{BODY}</article><section id='comments'>{BODY * 5}</section></body>",
    f"<body><article><h1>Head</h1>{BODY}<div class='sidebar-left'><p>Buy now.</p></div></article></body>",
])
def test_article_in_or_beside_what_looks_like_noise(page):
    assert extract.main_text(page) == "\n".join(["Head", *P])


@pytest.mark.parametrize("page", [
    *(f"<body>{MENU}<div><{t} width=1>{{}}<p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div></body>" for t in ("svg", "math", "object", "template")),
    *(f"<body><article><p>{P[0]}</p><{t} width=1>{{}}<p>{P[1]}</p><p>{P[2]}</p></article></body>" for t in ("svg", "math", "object", "template")),
    f"<body><article><p>{P[0]}<svg><g><path d=''/><text>{{}}</p><div>{P[1]}</div><p>{P[2]}</p></article></body>",
    f"<body><article><p>{P[0]}</p><svg><title>a</title><desc><p>no</p></desc><text>no</text></svg><p>{P[1]}</p><object><p>no</p></object>"
    f"<template><p>no</p></template><p>{P[2]}</p></article></body>",
])
def test_svg_math_object_template_are_elements(page):
    assert extract.main_text(page.replace("{}", "")) == "\n".join(P)


def test_text_of_math_is_kept():
    page = f"<article><p>So <math><mrow><mi>e</mi><mo>=</mo><msup><mi>m</mi><mn>2</mn></msup></mrow></math> holds.</p>{BODY}</article>"
    assert extract.main_text(page) == "\n".join(["So e=m2 holds.", *P])


def test_layout_names_in_several_parts():
    page = f"<body><div class='no-comments'><p>{P[0]}</p></div><div class='has-sidebar'><p>{P[1]}</p></div><div id='content-menu'><p>{P[2]}</p></div></body>"
    assert extract.main_text(page) == "\n".join(P)


def test_references_and_white_space():
    page = "<article><p>Fish &amp; chips&nbsp;&nbsp;at \n\t noon &#8212; &lt;b&gt; &eacute;t&#xe9; &unknown; </p><p> <b>so</b> it<i>al</i>ic<br>is </p><p> </p></article>"
    assert extract.main_text(page) == "Fish & chips at noon — <b> été &unknown;\nso italic is"


def test_parts_of_an_article_in_sections():
    parts = "".join(f"<section><h2>Part {i}</h2>{BODY}</section>" for i in range(3))
    want = "\n".join(x for i in range(3) for x in [f"Part {i}", *P])
    assert extract.main_text(f"<body><nav>{LINKS}</nav><div><div>{parts}</div></div><footer>end</footer></body>") == want


def test_odd_pages():
    for page in [None, "", " ", "<", "<<<>>>", "</p></div>", "<p", "<a href='x", "<!-- never closed", "<script>never closed", "<br><br/>", "\x00<p>\x00", "<nav>only</nav>"]:
        assert isinstance(extract.main_text(page), str)
    assert extract.main_text("just text") == "just text"
    assert extract.main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert extract.main_text(deep) == "deep"
    long = "<article>" + "<p>words of a very long page</p>" * 20_000 + "</article>"
    assert extract.main_text(long) == "\n".join(["words of a very long page"] * 20_000)


def test_query_gives_the_articles(spark):
    import __spark_entry__ as E
    got = {r.page_id: r for r in E.queries()["op8_html_extract"](spark, SF001).collect()}
    for r in spark.read.parquet(f"{SF001}/pages.parquet").collect():
        inner = re.sub("</?b>", "", re.search("(?s)<article>(.*?)</article>", r.html)[1])
        lines = [" ".join(html.unescape(x).split()) for x in re.split("<[^>]*>", inner)]
        want = "\n".join(x for x in lines if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_awkward_rows(spark):
    rows = [(1, "u", "<p>x</p>", "a"), (1, "u", "<p>x</p>", "a"), (None, None, None, None), (2, None, "", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("source", ["<div>x" * 200_000, "<p><b>" * 150_000, "<script " * 125_000 + "text", '<a "' * 250_000 + ">", "<a<b" * 250_000,
                                    "<a x=\"'>" * 120_000])
def test_deep_and_broken_pages_take_one_pass(source):
    began = time.perf_counter()
    main_text(source)
    assert time.perf_counter() - began < 5


def plain_content(page):
    """content_nodes straight from the formula: every subtree walked anew."""
    kids = {i: [] for i in range(len(page.name))}
    for i, p in enumerate(page.parent[1:], 1):
        kids[p].append(i)

    def below(i):
        return [i, *(x for k in kids[i] for x in below(k))]

    own_c, own_lc = list(page.chars), list(page.link_chars)

    def counts(i):
        nodes = below(i)
        return (sum(own_c[k] for k in nodes), len(nodes) - 1, sum(own_lc[k] for k in nodes), sum(page.name[k] == "a" for k in nodes[1:]))

    body = page.name.index("body") if "body" in page.name else 0
    cb, _, lcb, _ = counts(body)

    def value(i):
        c, t, lc, lt = counts(i)
        if not c:
            return 0.0
        t1, lc1, lt1, plain = max(t, 1), max(lc, 1), max(lt, 1), max(c - lc, 1)
        base = math.log(math.log(c / plain * lc + lcb / max(cb, 1) * c + math.e))
        ratio = c / lc1 * t1 / lt1
        return c / t1 * math.log(max(ratio, 1.0)) / max(base, 1e-3) if base > 1e-3 else c / t1 * math.log(max(ratio, math.e))

    everything = below(0)
    if not counts(0)[0]:
        return set()
    total = {i: sum(value(k) for k in kids[i]) for i in everything}

    def best(i):
        # the largest sum, of equal ones the node itself, else that which comes first in the page
        return max(below(i), key=lambda k: (total[k], k == i, -k))

    path, at = [best(0)], best(0)
    while at > 0:
        at = page.parent[at]
        path.append(at)
    least = min(value(i) for i in path)
    return {best(i) for i in everything if counts(i)[0] and value(i) >= least}


def test_densities_against_the_formula():
    rng = random.Random(8)
    parts = ["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<section>", "</section>", "<ul><li>", "</ul>", "some words of text. " * 3, "short ", "<b>bold</b>"]
    for _ in range(300):
        source = "<body>" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert content_nodes(Page(source)) == plain_content(Page(source)), source
