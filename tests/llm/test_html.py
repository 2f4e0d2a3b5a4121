"""Operator 10: pages with known main text, the matching, odd pages."""

import html
import re

import pytest

from episodeflow.llm import dom
from episodeflow.llm.wrapper_extract import extract, induce, main_text, read, _skeleton

SHELL = "<html><body><div class='top'>My site {n}</div><div id='menu'><a href='/{n}'>m{n}</a></div><div class='content'>{body}</div><div class='side'>Latest {n}</div></body></html>"


@pytest.mark.parametrize("page, text", [
    ("<article><h1>T</h1><p>a &amp; b<br>c</p><p>d&nbsp;e \n f</p></article>", "T\n\na & b c\n\nd e f"),
    ("<nav>x</nav><article><header><h1>T</h1></header><p>one<aside>no</aside></p><form>q</form><div class='ad box'>buy</div><p>two</p></article><footer>z</footer>", "T\n\none\n\ntwo"),
    ("<main><p>one<section id=comments><p>said</section></main>", "one"),
    ("<main class='has-sidebar'><p>one<p>two <b>three</b><li>x<li>y</main>", "one\n\ntwo three\n\nx\n\ny"),
    ("<body><script>var t='</p><p>no'</script><style>p{}</style><p title='a>b'>hey</body>", "hey"),
    ("<!-- <p>no</p> --><p>yes<!DOCTYPE html>", "yes"),
    ("a < b and c > d", "a < b and c > d"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<div class='content-sidebar-wrap'><article><p>one</p></article><div class='sidebar'>no</div></div>", "one"),
    ("<div class='has-sidebar'><p>one</p><div class='ad-box'>no</div></div>", "one"),
    ("<form id='aspnetForm'><div id='menu'>m</div><article><p>one</p></article></form>", "one"),
    ("<div><form id='aspnetForm'><p>All of the text of this page.</p></form><p>x</p></div>", "All of the text of this page.\n\nx"),
    ("<article><h2 id='search'>On search</h2><p class='social-history'>a</p><section class='related-work'><p>b</p></section><p>x <math><mi>y</mi></math></p></article>", "On search\n\na\n\nb\n\nx y"),
    ("<article><div class='post-header'><h1>T</h1></div><p>a</p><div class='related'>no</div></article>", "T\n\na"),
    ("<div><article>" + "<div>" * 210 + "in" + "</div>" * 210 + "<p>after</p></article></div>", "in\n\nafter"),
    ("<article>" + "<div>" * 400 + "<p>a</p><p>b <b>c</b></p><nav>no</nav>d" + "</div>" * 400 + "<p>e</p></article>", "a\n\nb c\n\nd\n\ne"),
    ("<aside><article>teaser</article></aside><div><p>The text of the page.</p></div>", "The text of the page."),
    ("<div>", ""), ("", ""), ("<p>unclosed <b>bold", "unclosed bold"),
])
def test_single_pages(page, text):
    assert extract(page, None) == text


def test_template_and_slots_of_same_host_pages():
    """Without an article element: the slot that varies most is content, constant nodes in it are template."""
    pages = [dom.parse(SHELL.format(n=n, body=f"<h1>Title {n}</h1><div class='hint'>Read on our site</div>" + "".join(f"<p>Text {n} {k} and more words here.</p>" for k in range(n + 1))))
             for n in range(5)]
    wrapper = _skeleton(induce(pages))
    assert read(pages[3], wrapper)[:2] == ["Title 3", "Text 3 0 and more words here."]
    assert len(read(pages[3], wrapper)) == 5


def test_an_article_keeps_lines_that_all_pages_share():
    pages = [dom.parse(f"<body><nav>n</nav><article><p>Shared line.</p><p>Own {n}</p></article></body>") for n in range(6)]
    assert read(pages[2], _skeleton(induce(pages))) == ["Shared line.", "Own 2"]


def test_a_page_unlike_its_host_gets_its_own_wrapper():
    wrapper = _skeleton(induce([dom.parse(SHELL.format(n=n, body=f"<p>{n}</p>")) for n in range(3)]))
    assert extract("<body><section><article><p>other</p></article></section></body>", wrapper) == "other"


def test_a_page_without_the_constant_last_line_keeps_its_last_paragraph():
    pages = ["<body><div><h1>On {n}</h1><p>First of {n} with words.</p><p>Second of {n}.</p>{end}</div></body>".format(n=n, end="" if n == "fox" else "<p>All rights reserved.</p>")
             for n in ("ant", "bee", "cat", "dog", "elk", "fox")]
    wrapper = _skeleton(induce([dom.parse(p) for p in pages[:5]]))
    assert extract(pages[5], wrapper) == "On fox\n\nFirst of fox with words.\n\nSecond of fox."
    assert extract(pages[0], wrapper) == "On ant\n\nFirst of ant with words.\n\nSecond of ant."


def test_simple_tree_matching():
    a, b = dom.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), dom.parse("<div><ul><li>y</li><li>z</li></ul><p>3</p></div>")
    size, pairs = dom.tree_match(a, b)
    assert size == 5 and len(pairs) == 1  # root, div, ul, li, p


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        truth[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == truth and all(r.n_chars == len(r.text) for r in got)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    rows = [(1, None, None), (2, "not a url", "<p>x</p>"), (None, "http://h/1", "<p>y</p>"), (3, "http://h/2", ""), (3, "http://h/2", ""), (4, "http://h/3", deep),
            (5, "http://big/", "<p>" + "word " * 200_000), (6, "http://big/", "<a '" * 2000)]
    df = spark.createDataFrame([(*r, "t", 1, "h", "w") for r in rows], "page_id long, url string, html string, text string, n_chars long, host string, wrapper string")
    got = main_text(df).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[1, None] == "" and by[2, "not a url"] == "x" and by[None, "http://h/1"] == "y" and by[3, "http://h/2"] == "" and by[4, "http://h/3"] == "core"
    assert len(by[5, "http://big/"]) == 200_000 * 5 - 1
    assert main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("n_pages", [1, 3, 6])
def test_title_lead_and_second_block_outside_the_main_block_stay(n_pages):
    body = "".join(f"<p>Sentence {k} of the page with many words in it.</p>" for k in range(12))
    names = ["ant", "bee", "cat", "dog", "elk", "fox"][:n_pages]
    page = "<html><head><title>no</title></head><body>Own text {n}<h1>On {n} 7</h1><div class='lead'>All about the {n}.</div><div class='content'>{b}<p>The {n}.</p></div><div class='more'><p>More of the {n}.</p></div><div class='ad'>buy</div></body></html>"
    sources = [page.format(n=n, b=body) for n in names]
    wrapper = _skeleton(induce([dom.parse(s) for s in sources]))
    for n, source in zip(names, sources):
        text = extract(source, wrapper).split("\n\n")
        assert text[:3] == [f"Own text {n}", f"On {n} 7", f"All about the {n}."] and text[-2:] == [f"The {n}.", f"More of the {n}."]
    extra = sources[0].replace("<div class='more'>", "<section><p>No example has this.</p></section><div class='more'>")
    assert "No example has this." in extract(extra, wrapper)


def plain_page(n, top="", end="", words=6):
    """Without an article or any class name."""
    own = "".join(f"<p>Sentence {chr(97 + n % 26)}{chr(97 + n // 26)} {w} of this page only.</p>" for w in "abcdef"[:words])
    return f"<html><body><div><p>Read more on our site.</p><p>Printed version</p></div><div>{top}{own}{end}</div></body></html>"


def test_template_is_counted_on_all_pages_of_a_host(spark):
    """Most pages of the host hold a line, few hold another; which pages serve as examples decides neither."""
    most, few = "<p>Sign up for our letter today.</p>", "<p>From our archive of the year.</p>"
    rows = [(n, "http://one/x", plain_page(n, most if n % 3 else "", few if n % 4 == 0 else "")) for n in range(40)]
    rows += [(100 + n, "http://two/x", plain_page(n, most if n < 3 else "")) for n in range(3)]  # too few pages to tell
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df.repartition(7)).collect()}
    own = lambda n: [f"Sentence {chr(97 + n % 26)}{chr(97 + n // 26)} {w} of this page only." for w in "abcdef"]
    for n in range(40):
        assert got[n].split("\n\n") == own(n) + (["From our archive of the year."] if n % 4 == 0 else [])
    for n in range(3):
        assert got[100 + n].split("\n\n") == ["Read more on our site.", "Printed version", "Sign up for our letter today."] + own(n)


def test_copies_of_a_page_are_one_page_and_no_template(spark):
    rows = [(n, "http://h/", plain_page(0)) for n in range(30)] + [(30 + n, "http://h/", plain_page(1 + n)) for n in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n].startswith("Sentence aa a") and got[n].count("\n\n") == 5 for n in range(30)) and "our site" not in got[33]


def test_a_page_of_template_lines_only_keeps_them(spark):
    rows = [(n, "http://h/", plain_page(n, words=n % 7)) for n in range(14)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[7] == "Read more on our site.\n\nPrinted version" and got[1] == "Sentence ba a of this page only."
