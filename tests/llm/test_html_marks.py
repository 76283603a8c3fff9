"""Marks, nesting, pages without an article, and hostile pages."""

import time

import pytest

from stowlens.llm import html_text

PROSE = "The real article goes on for some time and says a number of things that matter to the reader of it."
PAGE = f"<html><body><nav><a href=x>Home</a></nav><div class=ad>Buy now</div><article><h1>T</h1><p>{PROSE}</p></article><footer>Imprint</footer></body></html>"
WEIGHTS = html_text.fit([PAGE])


def text_of(page, weights=WEIGHTS):
    tokens = html_text.tokens_of(page, weights)
    return html_text.text_of(tokens, html_text.best_run(tokens, weights))


@pytest.mark.parametrize("weights", [WEIGHTS, html_text.fit([])], ids=["fitted", "unfitted"])
@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content no-sidebar'><p>{PROSE}</p></div></body>",
        f"<body><nav><a>Home</a></nav><div id=main-search-page><p>{PROSE}</p></div></body>",
        f"<body><div class='has-sidebar with-comments'><p>{PROSE}</p></div><div class=sidebar>Other things</div></body>",
        f"<body><article><div class='related-work'><p>{PROSE}</p></div></article></body>",
        f"<body><article><p>{PROSE}</p><div class='share'><a>one</a><a>two</a></div></article></body>",
        f"<body><article><p>{PROSE}</p><div class='related'><ul><li><a>Another story of the day</a><li><a>And one more of them</a></ul></div></article></body>",
        f"<body><article><p>{PROSE}</p></article><section class=comments><p>{PROSE} {PROSE}</p></section></body>",
        f"<body><p>{PROSE}</p><footer>Imprint</footer></body>",
        PROSE,
    ],
)
def test_marks(page, weights):
    assert text_of(page, weights) == PROSE


def test_an_article_within_an_article_is_part_of_it():
    assert text_of(f"<body><article><p>{PROSE}</p><article><p>Inner.</p></article><p>{PROSE} Last.</p></article><div>Other</div></body>").split("\n") == [PROSE, "Inner.", PROSE + " Last."]


def test_first_of_equal_runs():
    assert text_of("<body><article><p>one two</p></article><article><p>six ten</p></article></body>") == "one two"


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, "</ " * 300_000, "<a '" * 300_000, "<!-- " * 300_000, "<script <" * 200_000, "<div>" * 100_000 + "x", "<p><table><td>" + "<b>" * 100_000 + "<div>" * 100_000, "<p>w " * 200_000, "<li class=related>w <a>" * 60_000, "<" * 500_000],
    ids=["tags", "ends", "quotes", "comments", "scripts", "depth", "siblings", "paragraphs", "marks", "angles"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    text_of(page)
    assert time.process_time() - began < 8


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x", "y", 3), (1, "u", PAGE, "x", "y", 3), (2, None, "", None, None, None)], "page_id long, url string, html string, text string, run_start string, n_chars int")
    out = html_text.extract(df, html_text.fit_table(df)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, "T\n" + PROSE, len(PROSE) + 2)] * 2 + [(2, "", 0)]
