"""Marked wrappers around the article, and elements whose end tags are left out."""

import pytest

from stowlens.llm import html_text

ARTICLE = "<h1>Title of it</h1><p>" + "many words of the article " * 20 + "<p>" + "and its second block of words " * 20
SIDE = "<div class=sidebar><p>Links and more</p></div>"


def text(page):
    tokens = html_text.tokens_of(page)
    return html_text.text_of(tokens, html_text.best_run(tokens, html_text.fit([])))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content-sidebar-wrap'><main>{ARTICLE}</main>{SIDE}</div></body>",
        f"<body><div id='content' class='has-sidebar'>{ARTICLE}{SIDE}</div></body>",
        f"<body><div class='has-sidebar'><article>{ARTICLE}</article></div>{SIDE}</body>",
        f"<body><p class='notice'>Read this<div>{ARTICLE}</div></body>",
        f"<body><ul><li class='share'>Share it<li>Home</ul><div>{ARTICLE}</div></body>",
        f"<body><div><form action=x><input name=q></div><div>{ARTICLE}</div></body>",
        f"<body><form action=x><input name=q><div>{ARTICLE}</div></body>",
        f"<body><form id=page><div>{ARTICLE}</div></form></body>",
        f"<body><table><tr><td class=ad>Buy<td>Now<tr><td>Here</table><div>{ARTICLE}</div></body>",
    ],
)
def test_the_article_is_not_lost(page):
    got = text(page)
    assert ("many words of the article " * 20).strip() in got and ("and its second block of words " * 20).strip() in got
    assert "Links" not in got and "Read this" not in got and "Share" not in got and "Buy" not in got


def test_what_is_not_the_article_is_still_skipped():
    comment = "<section class=comments><article class=comment><p>" + "great post " * 500 + "</article></section>"
    got = text(f"<body><main>{ARTICLE}</main>{comment}<aside><p>aside words</aside><nav>menu words</nav></body>")
    assert "many words" in got and "great post" not in got and "aside" not in got and "menu" not in got
    assert text(f"<body><p class=notice>one<div>{ARTICLE}</div><div class=ad><p>buy<p>now</div></body>").count("buy") == 0


def test_a_labelled_page_in_a_marked_wrapper_is_labelled():
    tokens = html_text.tokens_of(f"<body><div class='content-sidebar-wrap'><main>{ARTICLE}</main></div></body>")
    assert html_text.labelled_run(tokens) is not None
