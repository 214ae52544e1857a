"""Page shapes of real sites: cards, omitted end tags, furniture words in page names, forms around pages, broken nesting."""

import pytest

from quarry.llm import html_main

ONE = "Body one is a long paragraph of text, with many words in it. " * 4
TWO = "Body two goes on and on & on, as such texts do. " * 4
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{ONE.strip()}\n\n{TWO.strip()}"

SHAPES = {
    "cards after the body": f'<div class="content">{BODY}</div><article><h3>Teaser one</h3></article><article><h3>Teaser two</h3></article>',
    "cards before the body": f'<article>Teaser</article><div class="content">{BODY}</div>',
    "page with-sidebar": f'<div class="page with-sidebar"><div class="post">{BODY}</div><div class="sidebar">side</div></div>',
    "wrapper named after a header": f'<div class="header-image-wrapper post">{BODY}</div>',
    "page in a form": f'<body><form action="x"><div>{BODY}</div><input type="submit" value="Go"></form></body>',
    "comments in articles": f'<nav><a>Home</a></nav><div>{BODY}</div><section class="comments"><article>I like it</article></section>',
    "sidebar never closed": f'<div class="sidebar">side<article>{BODY}</article>',
    "advert ends with its parent": f'<article><div><p class="ad">Buy now</div>{BODY}</article>',
    "advert without an end tag": f'<article><p class="ad">Buy now{BODY}</article>',
    "stray end tags": f"</div></p></article>{BODY}</section>",
    "formatting across blocks": f"<article><b><p>{ONE}</b></p><p>{TWO}</p></article>",
    "long comments": f'<article>{BODY}</article><div class="comments">{"A reader says very much. " * 60}</div>',
    "no markup of its own": BODY,
    "table layout": f'<table><tr><td class="menu">Home<td>{BODY}</table>',
}


@pytest.mark.parametrize("shape", SHAPES)
def test_body_of_a_page(shape):
    assert html_main.main_text(SHAPES[shape]) == TEXT


def test_lists_and_definitions():
    page = '<article><ul><li class="share">Tweet<li>First<li>Second<ul><li>Inner</ul></ul><dl><dt>Term<dd class="ad">Advert<dt>Other<dd>Meaning</dl></article>'
    assert html_main.main_text(page) == "First\n\nSecond\n\nInner\n\nTerm\n\nOther\n\nMeaning"


def test_deep_and_long_pages():
    assert html_main.main_text("<div>" * 20_000 + BODY) == TEXT
    many = "<article>" + "".join(f"<p>paragraph {i}" for i in range(50_000)) + "</article>"
    assert html_main.main_text(many).count("\n\n") == 49_999


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (3, "u", f"<p>{ONE}", "z"), (3, "u", f"<p>{ONE}", "z")], "page_id int, url string, html string, text string")
    got = html_main.extract(pages)
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == [(1, "", 0), (2, "", 0), (3, ONE.strip(), len(ONE.strip())), (3, ONE.strip(), len(ONE.strip()))]
    assert html_main.extract(pages.limit(0)).collect() == []
