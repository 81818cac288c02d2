"""HTML extraction: cases, its definition, linear time."""

import random
import re
import time

import pytest

from rowatlas.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1><a href=x>Home</a></header><nav><ul><li><a href=a>A</a></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div><main><article><header><h1>Title &amp; more</h1></header><p>First  paragraph,
 with <b>bold</b> and <a href=q>link</a>.<p>Second&nbsp;one &#233;&eacute;<br>after a break.<ul><li>item one<li>item two</ul>
<form><input><button>Send</button></form><aside>Related: <a href=z>z</a></aside><blockquote>Quoted</blockquote></article></main>
<section id="comments"><article class="comment"><p>Nice post, I agree with all of it and more words here to be dense.</p></article></section>
<aside class="sidebar">Side</aside><footer>&copy; me</footer></body></html>"""


def test_html_article():
    want = ["Title & more", "First paragraph, with bold and link.", "Second one éé after a break.", "item one", "item two", "Quoted"]
    assert html_text.main_text(PAGE).split("\n") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a</p><p>b", "a\nb"), ("<div><p>x</b>y</div>", "xy"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<p>a<!-- cut", "a"), ("<p>a <b", "a"),
        ("<script>if (a<b) x</script><p>t</p>", "t"), ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"), ("<body></body>", ""),
        ("<body><div class='content'><h2>H</h2><p>Some longer text that is the main part of the page.</p><p>And more of the text.</p></div><div class='menu'><a href=1>x</a></div></body>", "H\nSome longer text that is the main part of the page.\nAnd more of the text."),
        ("<div id=header><h1>Site</h1></div><div class=post><div class=post-header><h1>Own title</h1></div><p>The text of the post, long enough to be the core.</p></div><div class='site-disclaimer'>Legal</div>", "Own title\nThe text of the post, long enough to be the core."),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<textarea>t</textarea><p>u", "u"), ("<p hidden>h</p><p style='display:none'>i</p><p>j</p>", "j"),
    ],
)
def test_html_cases(page, want):
    assert html_text.main_text(page) == want


LONG = "The text of the article is long enough to be the core of the page, with many words."


@pytest.mark.parametrize("names", ["class='has-sidebar'", "class=no-sidebar", "class=nav-fixed", "class=modal-open", "id=page-menu", "role=navigation"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_wrappers_with_names_of_other_things(names, tag):
    page = f"<div id=page {names}><header>Site</header><div class=menu><a href=a>A</a></div><{tag}><h1>T</h1><p>{LONG}</p></{tag}><div id=comments><p>Short talk.</p></div><div class=sidebar>Side</div></div>"
    assert html_text.main_text(page) == f"T\n{LONG}"


def test_html_names_inside_an_article():
    page = f"""<article><h1>T</h1><p>{LONG}</p><section id="discussion"><h2 id="related-work">R</h2><p>{LONG}</p></section><h2 id="privacy">P</h2><p class="notice">N note</p><p class="legal">L note</p>
<div class="share">Share me</div><div class="ad">Buy now</div><p class="related"><a href=x>More</a></p><section id="comments"><p>{LONG}</p></section></article>"""
    assert html_text.main_text(page).split("\n") == ["T", LONG, "R", LONG, "P", "N note", "L note"]


def test_html_text_beside_the_article():
    beside = f"<main><h1>T</h1><p>Lead. {LONG}</p><article>{f'<p>{LONG}</p>' * 4}</article><article><p>{LONG}</p><p>{LONG}  <b>A</b></p></article></main>"
    assert html_text.main_text(beside).split("\n") == ["T", f"Lead. {LONG}", *[LONG] * 4, LONG, f"{LONG} A"]
    bare = f"<body>bare <b>bold</b> text<br>and more<div><p>{LONG}</p><p>{LONG}</p></div>tail <a href=x>link</a> text<div class=menu><a href=a>A</a></div></body>"
    assert html_text.main_text(bare).split("\n") == ["bare bold text and more", LONG, LONG, "tail link text"]


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ('<p title="the hidden valley">one</p>', "one"), ("<p data-state='hidden gem'>two</p>", "two"), ('<div class="discussion"><p>of results</p></div>', "of results"),
        ('<section class="legal-history"><p>of law</p></section>', "of law"), ("<p>f <math><mi>x</mi><mo>=</mo></math> g</p>", "f x= g"), ("<ul><li><a href=1>A</a><li><a href=2>B</a><li><a href=3>C</a></ul>", "A\nB\nC"),
        ("<p it's>odd</p>", "odd"), ("<p class=x/y>odd</p>", "odd"), ("<div role=navigation>menu</div>", ""), ("<p aria-hidden=true>icon</p>", ""), ("<script>a</script x", ""), ("<p a='b", ""),
    ],
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_drops_nothing_else(tag, part, want):
    page = f"<body><ul class=menu><li><a href=a>A</a></ul><{tag}><h1>T</h1><p>{LONG}</p><p>{LONG}</p>{part}"
    end = "" if part.endswith(("x", "b")) else f"<p>{LONG}</p></{tag}><ul><li><a href=a>A</a><li><a href=a>A</a><li><a href=a>A</a></ul>"
    assert html_text.main_text(page + end).split("\n") == [x for x in ["T", LONG, LONG, *want.split("\n"), LONG if end else ""] if x]


def test_html_pages_without_an_article_tag(spark):
    """The sums and the threshold find the text of the table's pages, whether their container is called an article or not."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = 0
    for r in rows:
        top = html_text.parse(r.html)
        html_text.drop_named(top)
        nodes = html_text._order(top)
        html_text._weigh(nodes)
        found = html_text.choose(nodes)
        assert found.core.tag == "article" and found.threshold > 0
        same += html_text.main_text(r.html) == html_text.main_text(re.sub("<(/?)article>", r"<\1div>", r.html))
    assert len(rows) == 250 and same == 250


def slow_choice(page):
    """The core and the threshold of a page without links, from the definition: every count anew from all descendants."""
    top = html_text.parse(page)
    below = lambda n: [c for c in n.children if not isinstance(c, str)]
    chars = lambda n: sum(len(re.sub(r"\s", "", c)) if isinstance(c, str) else chars(c) for c in n.children)
    tags = lambda n: sum(1 + tags(c) for c in below(n))
    density = lambda n: chars(n) / max(1, tags(n))

    def total(n):
        runs, said = [], []
        for c in [*n.children, None]:
            if isinstance(c, str):
                said.append(re.sub(r"\s", "", c))
            else:
                runs.append(len("".join(said)))
                said = []
        return sum(map(density, below(n))) + sum(runs)

    every, path = [top], []
    for n in every:
        every.extend(below(n))
    core = n = max(every, key=lambda n: (total(n), -every.index(n)))
    while n is not None:
        path.append(density(n))
        n = n.parent
    return top, total(core), min(path)


def test_html_choice_is_its_definition():
    rng = random.Random(8)
    for _ in range(300):
        page, open_ = "", []
        for _ in range(rng.randrange(2, 40)):
            if open_ and rng.random() < 0.4:
                page += f"</{open_.pop()}>"
            elif rng.random() < 0.5:
                open_.append(rng.choice(["div", "section", "td", "center"]))
                page += f"<{open_[-1]}>"
            else:
                page += "x" * rng.randrange(1, 60) + rng.choice(["", " ", " y "])
        top, best, least = slow_choice(page)
        nodes = html_text._order(top)
        html_text._weigh(nodes)
        found = html_text.choose(nodes)
        assert abs(found.core.sum - best) < 1e-9 and abs(found.threshold - least) < 1e-9


@pytest.mark.parametrize("page", ["<div>" * 50_000, "<div>" * 25_000 + "</span>" * 25_000, "<header>" * 50_000, "<div>" + "<b>" * 25_000 + "<p></p>" * 25_000, "<a '" * 50_000 + ">", "<script>" + "</script " * 50_000, "<span><table><tr><td>" + "<div>" * 25_000 + "</span>" * 25_000, "<ul><li>" * 25_000, "<" * 100_000, "<div class=comment>" * 50_000])
def test_html_is_linear(page):
    spent = []
    for p in (page[: len(page) // 2], page):
        began = time.process_time()
        html_text.main_text(p + "x")
        spent.append(time.process_time() - began)
    assert spent[1] < 4 and spent[1] < 3 * spent[0] + 0.3


def test_html_deep_and_broken_pages(spark):
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 2000
    assert html_text.main_text(deep) == "deep text"
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "x & y", "<", ">", "&amp;", "<a href='", "'>", "<table>", "<td>", "</table>", "<li>", "<script>", "</script>", "<!--", "-->"]
    for _ in range(400):
        html_text.main_text("".join(rng.choice(bits) for _ in range(60)))
    rows = spark.createDataFrame([(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_text.extract(rows).collect())) == sorted(["Row(page_id=1, url='u', text='a', n_chars=1)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])
    assert html_text.extract(rows.limit(0)).count() == 0
