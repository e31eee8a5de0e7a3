import re
import time
from html import escape

import pytest
from frames import CLASHING

from aislelens.llm import html_text, queries

SF = "/root/testdata/sf0.01"
PROSE = ["The first paragraph has <b>some</b> words &amp; a <a href='/x'>link</a> in\n  it, and goes on for a while.", "A second one follows, with more to read about the matter at hand."]


def page(body, head="<title>T</title><script>var a = '<p>no</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


WANTED = "The first paragraph has some words & a link in it, and goes on for a while.\n\n" + PROSE[1]
FURNITURE = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Other things to see</a></li></ul></nav>", "<header><h2>Site name and its motto</h2></header>",
    "<div class='cookie-notice'>We use cookies to make this site better for all of you.</div>", "<aside><p>Something quite different beside it.</p></aside>",
    "<div class=ad>Buy this product now, it is better than all others.</div>", "<form><p>Write your name here please</p><input name=a></form>",
    "<div id='comments'><p>First! This is what a reader said about the text above.</p></div>", "<footer>&copy; somebody, all rights reserved</footer>",
    "<noscript>Please turn on scripts</noscript>", "<!-- a comment <p>of the author</p> -->", "<div style='display: none'>hidden words</div>",
]


def test_article_without_furniture():
    before, after = "".join(FURNITURE[:5]), "".join(FURNITURE[5:])
    for main in (f"<article>{paragraphs(PROSE)}</article>", f"<div><div class='text'>{paragraphs(PROSE)}</div></div>", f"<main><section>{paragraphs(PROSE)}</section></main>"):
        assert html_text.main_text(page(before + main + after)) == WANTED


def test_headings_lists_and_open_tags_stay_in_order():
    body = "<article><h1>Title &eacute;</h1><p>One<p>Two<br>lines<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n f</pre>tail</article>"
    assert html_text.main_text(page(body)) == "Title é\n\nOne\n\nTwo lines\n\na\n\nb\n\nc d\n\ne f\n\ntail"


def test_a_title_beside_the_densest_container():
    before, after = "".join(FURNITURE[:5]), "".join(FURNITURE[5:])
    prose = [*PROSE, "A third one ends the matter, as far as there is more to say about it today."]
    wanted = "\n\n".join(["Title", "A lead in a few words.", WANTED, prose[2]])
    inner, lead = f"<div>{paragraphs(prose)}</div>", "<h1>Title</h1><p>A lead in a few words.</p>"
    for main in (f"<article>{lead}{inner}</article>", f"<main>{lead}{inner}</main>", f"<div>{lead}{inner}</div>", f"{lead}{inner}",
                 f"<main>{lead}<article>{inner}</article></main>", f"<div>{lead}<article>{inner}</article></div>",
                 f"<article><div>{lead}</div><div><div>{inner}</div></div></article>"):
        assert html_text.main_text(page(before + main + after)) == wanted


def test_long_and_short_sections():
    long, short = paragraphs(["word " * 39 + "words"] * 9), paragraphs(["other " * 33 + "ends"])
    for outer in ("article", "main", "div"):
        text = html_text.main_text(f"<body><{outer}><section>{long}</section><section>{short}</section></{outer}></body>")
        assert text.count("words") == 9 and text.count("ends") == 1
    assert html_text.main_text(f"<body><section>{long}</section><section>{short}</section></body>").count("ends") == 1


def test_unmarked_furniture_beside_the_text():
    links = "<ul>" + "<li><a href='/x'>Something else to see</a></li>" * 5 + "</ul>"
    bare = f"<div>{links}</div><article><h1>Title</h1>{paragraphs(PROSE * 3)}</article><p>Made by us</p>"
    assert html_text.main_text(f"<body>{bare}</body>") == "\n\n".join(["Title", *[WANTED] * 3])


MARKS = [
    "style='overflow:hidden'", "class='overflow-hidden'", "aria-hidden='false'", "data-id='search-1'", "class='content with-sidebar'", "id='header-and-content'",
    "class='side-by-side'", "hidden=until-found", "data-x='a hidden thing' title='class=ad'", "class='no-comments'", "data-style='display:none'",
]


def test_marks_of_other_things_drop_nothing():
    for mark in MARKS:
        assert html_text.main_text(page(f"<div {mark}>{paragraphs(PROSE)}</div>")) == WANTED
        assert html_text.main_text(page(f"<article><div {mark}><p>{PROSE[0]}</p></div><p>{PROSE[1]}</p></article>")) == WANTED
    link = PROSE[0].replace("'/x'", "'/the-hidden-truth?id=search class=ad'")
    assert html_text.main_text(page(f"<article>{paragraphs([link, PROSE[1]])}</article>")) == WANTED
    assert html_text.main_text(page(f"<article><h2 id=comments>Comments</h2>{paragraphs(PROSE)}</article>")) == "Comments\n\n" + WANTED


def test_furniture_around_the_page_is_the_page():
    before, after = "".join(FURNITURE[:5]), "".join(FURNITURE[5:])
    for tag in ("form action='/x'", "div class=sidebar", "div id=search", "div aria-hidden=true", "div class='page-header'", "header"):
        for main in (f"<article>{paragraphs(PROSE * 4)}</article>", f"<div>{paragraphs(PROSE * 4)}</div>", f"<main><form>{paragraphs(PROSE * 4)}</form></main>"):
            body = f"<{tag}>{before}{main}{after}</{tag.split()[0]}>"
            assert html_text.main_text(page(body)) == "\n\n".join([WANTED] * 4)
            assert html_text.main_text(page(f"<form>{body}</form>")) == "\n\n".join([WANTED] * 4)


    body = f"<article><h1>Title</h1><form>{paragraphs(PROSE)}</form></article><div class=sidebar><p>Short words.</p></div>"
    assert html_text.main_text(page(body)) == "Title\n\n" + WANTED


def test_marked_furniture_goes():
    main = f"<div>{paragraphs(PROSE)}</div>"
    reply = "<article class=comment><p>A reader says a lot about the text above, and more than that.</p></article>" * 9
    for mark in ("hidden", "hidden=hidden", "HIDDEN", "style='color:red; Display : none'", "aria-hidden=true", "class='cookieNotice'", "class='x sidebar-left'",
                 "class='related-posts'", "role=navigation", "id=site-footer", "class='search-box'"):
        assert html_text.main_text(page(f"<div {mark}><p>Words of another kind.</p></div>{main}")) == WANTED
    for mark in ("id=comments", "class='ad'", "hidden", "style='display:none'"):
        assert html_text.main_text(page(f"{main}<div {mark}>{paragraphs(PROSE * 9)}</div>")) == WANTED
    assert html_text.main_text(page(f"{main}<div id=comments>{reply}</div>")) == WANTED


def test_awkward_pages():
    main = html_text.main_text
    assert main(None) == main("") == main("<p>") == main("<script>x") == main("<!-- x") == main("<html><body></body></html>") == ""
    assert main("plain &lt;text&gt; only") == "plain <text> only"
    assert main("<p>cut <b>off <a href='x") == "cut off"
    assert main("<p>a < b and c > d</p>") == "a < b and c > d"
    assert main("<p title='a > b'>x</p>") == "x"
    deep = "<div>" * 5_000 + "deep words" + "</div>" * 5_000
    assert main(deep) == "deep words"
    many = page(f"<article>{paragraphs(['word ' * 30] * 3_000)}</article>")
    assert main(many).count("\n\n") == 2_999


@pytest.mark.parametrize("unit", ["<div>", "<div class=a>", "<p>", "<li>", "<ul><li>", "<b>", "<table><tr><td>", "</p>", "<div></span>", "<article>", "<a href=x>", "<x '>", '<a b="', "<p class=a>x</q>"])
def test_time_grows_with_the_page(unit):
    """A megabyte of tags that are never closed, or never opened."""
    start = time.process_time()
    assert html_text.main_text(page(unit * (1_000_000 // len(unit)) + f"<article>{paragraphs(PROSE)}</article>")) is not None
    assert time.process_time() - start < 30


ENTRY = "<{0} class='x'><span class='author'>Kim</span><{1}>Well said, I thought the same when I read it.</{1}></{0}>"


@pytest.mark.parametrize("name", ["section id=discussion", "div class=reactions", "div class=b7", "ul", "section"])
@pytest.mark.parametrize("entry", [ENTRY.format("div", "p"), ENTRY.format("li", "span"), "<div><p>Rubbish, all of it.</p><p><time>12:30</time></p></div>", "<article><cite>Lou</cite><p>No, it is not so.</p></article>"])
def test_comments_without_a_listed_name(name, entry):
    thread, prose = f"<{name}><h3>What you said</h3>{entry * 3}</{name.split()[0]}>", paragraphs(PROSE * 6)
    wanted = "\n\n".join(["Title", *[WANTED] * 6])
    for body in (f"<article><h1>Title</h1>{prose}{thread}</article>", f"<div><h1>Title</h1>{prose}{thread}</div>", f"<main><h1>Title</h1>{prose}<div>{thread}</div></main>"):
        assert html_text.main_text(page(body)) == wanted


def test_signed_parts_of_an_article_stay():
    live = "".join(f"<section class=x><h2>At {i}</h2><time>{i}:00</time><p>{PROSE[1]}</p></section>" for i in range(4))
    assert html_text.main_text(page(f"<article><h1>Title</h1>{paragraphs(PROSE * 9)}{live}</article>")).count("At ") == 4
    section = f"<section id=discussion><h2>Discussion</h2>{paragraphs(PROSE)}</section>"
    assert "Discussion" in html_text.main_text(page(f"<article><h1>Title</h1>{paragraphs(PROSE * 3)}{section}</article>"))
    quotes = "".join(f"<blockquote><p>{PROSE[1]}</p><cite>A. Writer</cite></blockquote>" for _ in range(3))
    assert html_text.main_text(page(f"<article><h1>Title</h1><p>Three quotes.</p>{quotes}</article>")).count("A. Writer") == 3
    byline = "<p class=byline>By <span class=author>Kim</span></p>"
    assert "By Kim" in html_text.main_text(page(f"<article><h1>Title</h1>{byline}{paragraphs(PROSE)}</article>"))


def test_all_pages_give_their_article(spark):
    """The articles of the given pages hold only headings, paragraphs, bold text and line breaks."""
    rows = queries.op10_html_text(spark, SF).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        article = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("</?b>|<br>", " ", article))
        texts = [re.sub(r"\s+", " ", html_text.unescape(b)).strip() for b in blocks]
        assert r.text == "\n\n".join(t for t in texts if t) and r.n_chars == len(r.text)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", page(paragraphs(PROSE)), "x"), (1, "u", None, "x"), (None, None, escape("<p>"), "x")], "page_id bigint, url string, html string, text string")
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, "<p>", 3), (1, "", 0), (1, WANTED, len(WANTED))]
    assert html_text.extract(pages.limit(0)).count() == 0
    for name in CLASHING.split(", "):
        if name != "a.b":
            pages = pages.selectExpr("*", f"'x' as `{name}`")
    assert html_text.extract(pages).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(pages).count() == 3
