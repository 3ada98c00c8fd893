import re

import pytest

from tapeline.llm import htmltext as h

LONG = "Words that fill a paragraph of an article, so that it is much denser than any menu. " * 4
LONG = LONG.strip()


def test_article_among_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div><!-- note -->
    <article><h1>A title</h1><p><b>First&nbsp;&amp; <i>fore</i>most<br><p>{LONG}</p><div class="share-buttons">Share</div><ul><li>one<li>two</ul></article>
    <aside>More</aside><div id="comments"><p>{LONG} I agree.</p></div><form><p>Name</p></form><footer>&copy; x</footer></body></html>"""
    assert h.extract(page) == f"A title\nFirst & foremost\n{LONG}\none\ntwo"


def test_divisions_without_an_article():
    links = "".join(f'<li><a href="/{i}">A menu entry {i}</a></li>' for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>Title</h2><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div></div><div><a href='/x'>previous</a> <a href='/y'>next</a></div></body>"
    assert h.extract(page) == f"Title\n{LONG}\nShort.\n{LONG}"


def test_names_of_wrappers_and_of_comments():
    comments = "".join(f'<article class="comment-{i}"><p>{LONG} Comment {i}.</p></article>' for i in range(30))
    page = f"""<body><div class="site-header"><p>{LONG}</p></div><div class="content with-sidebar"><main><header class="post-header"><h1>T</h1></header><p>{LONG}</p></main></div>
    <section><ol class="commentlist">{comments}</ol></section><div class="cookieNotice"><p>{LONG}</p></div></body>"""
    assert h.extract(page) == f"T\n{LONG}"


def test_sections_beside_the_best_one():
    page = f"<body><div class='page'><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div></div></body>"
    assert h.extract(page).count(LONG) == 4


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<p>a<p>b", "a\nb"), ("<article><p>cut off &am", "cut off &am"), ("<div", ""), ("<article><p>x &#233; &lt;b&gt; &hellip;</p>", "x é <b> …"), ("<article>a\n\t b<br>c</article>", "a b c"), ("<nav>only a menu</nav>", "")])
def test_odd_pages(page, text):
    assert h.extract(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert h.extract(deep) == "x"
    body = "<p>word</p>" * 20_000
    assert h.extract(f"<article>{body}</article>").count("word") == 20_000


def test_pages_against_a_plain_reading(spark):
    """On the given pages the article is what stands in <article>; all its blocks but nothing else come out."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = h.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    import html

    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_columns_and_rows_stay(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "old"), (1, "u", "<p>a", "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = h.main_text(df).toPandas()
    assert list(out.columns) == ["page_id", "url", "text", "n_chars"] and sorted(out.text) == ["", "a", "a"]
    assert h.main_text(df.limit(0)).count() == 0


SIGN_IN = '<div class="login"><label>Name</label><input><select><option>one</select><button>Go</button></div>'


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body><form id='aspnetForm'><div><label>Find</label><input></div><div class='page'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>{SIGN_IN}</form></body>", f"T\n{LONG}\n{LONG}"),
        (f"<body><form><div><p>{LONG}</p><p>{LONG}</p></div>{SIGN_IN}</form></body>", f"{LONG}\n{LONG}"),
        (f"<body><form><article><h1>T</h1><p>{LONG}</p><button>Go</button></article></form></body>", f"T\n{LONG}"),
        (f"<body><div class='col with-sidebar'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
        (f"<body><h1>T</h1><div class='content no-sidebar'><p>{LONG}</p><p>{LONG}</p></div><div id='comments'><p>{LONG * 20}</p></div></body>", f"T\n{LONG}\n{LONG}"),
        (f"<body><div class='overlay'><form><p>{LONG}</p><p>{LONG}</p></form></div></body>", f"{LONG}\n{LONG}"),
        (f"<body><object data='a.swf'><div><p>{LONG}</p></div></object></body>", LONG),
    ],
)
def test_what_holds_the_text_stays(page, text):
    assert h.extract(page) == text


@pytest.mark.parametrize("aside", [f"<form><p>{LONG}</p></form>", f"<div class='sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"<aside><p>{LONG}</p><p>{LONG}</p></aside>", f"<div id='comments'><p>{LONG * 20}</p></div>", f"<div class='cookie-notice'><p>{LONG}</p></div>"])
def test_what_has_less_of_the_text_or_is_comments_goes(aside):
    assert h.extract(f"<body><div class='story'><p>{LONG}</p><p>{LONG}</p></div>{aside}</body>") == f"{LONG}\n{LONG}"
    assert h.extract(f"<body><main><p>Short.</p></main>{aside}</body>") == "Short."


def test_a_quote_that_is_never_closed():
    assert h.extract('<p>first para is here<p class="x>second') == "first para is here\nsecond"
    assert h.extract("<article><p title='it>one</p><p>two</p></article>") == "one\ntwo"


NEUTRAL = f"""<body><div class="a1"><div class="b1">{"".join(f'<div><a href="/{i}">Place {i} to go</a></div>' for i in range(12))}</div>
    <div class="b2"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class="b3">{"".join(f'<div><span>user{i}</span> <a href="/u{i}">reply</a> <p>Yes.</p></div>' for i in range(15))}</div></div></body>"""


def test_density_decides_where_names_say_nothing(monkeypatch):
    """Neither an article nor a telling name: menus and comments are told by their tags and links alone."""
    assert h.extract(NEUTRAL) == f"{LONG}\n{LONG}\n{LONG}"
    monkeypatch.setattr(h, "_density", lambda chars, tags, link_chars, links, body: float(chars > 0))
    assert h.extract(NEUTRAL) != f"{LONG}\n{LONG}\n{LONG}"


def test_density_chooses_among_articles():
    teasers = "".join(f"<article><h3><a href='/{i}'>Teaser {i}</a></h3><p>A line.</p></article>" for i in range(9))
    assert h.extract(f"<body><div>{teasers}</div><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article></body>") == f"T\n{LONG}\n{LONG}"
