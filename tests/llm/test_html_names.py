"""Names of elements count by what the element holds; reading a page takes linear time."""

import time

import pytest

from partlake.llm import html_extract

TEXT = [f"This is paragraph {i} of the story, with enough words to be prose." for i in range(3)]
ART = "".join(f"<p>{t}</p>" for t in TEXT)
MENU = "<div class='sidebar'><a href=/>Home</a> <a href=/x>News</a></div>"
FOOT = "<div class='footer'>Copyright someone.</div>"
COMMENTS = "<div class='comments'><p>I read this twice and liked every single word of it.</p></div>"


@pytest.fixture(scope="module")
def weights():
    return html_extract.fit_weights([])


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='single has-sidebar'><div id='content'>{ART}</div>{MENU}{FOOT}</body>",
        f"<body><div class='content-sidebar-wrap'><div class='post'>{ART}</div>{MENU}</div>{FOOT}</body>",
        f"<html class='no-js cookies'><body><div class='text'>{ART}</div>{FOOT}</body></html>",
        f"<body><main><div class='promo-story'>{ART}</div></main>{FOOT}</body>",
        f"<body><article><div class='ad-hoc-methods'>{ART}</div>{COMMENTS}</article></body>",
        f"<body><article><section id='comment-on-the-law'>{ART}</section></article>{FOOT}</body>",
        f"<body><article><div class='dialog'>{ART}</div></article>{MENU}</body>",
        f"<body class='page-with-menu'><main>{ART}{COMMENTS}</main></body>",
    ],
)
def test_names_of_whole_pages(weights, page):
    assert html_extract.main_text(page, weights).split("\n") == TEXT


@pytest.mark.parametrize(
    "part",
    [
        COMMENTS,
        COMMENTS.replace("comments", "comment-body"),
        "<div id='cookie-notice'><p>We use cookies on this site for a great many good reasons.</p></div>",
        "<div class='advert'><p>Buy this now, as it is the greatest offer of the whole year.</p></div>",
        "<div class='ad-slot-link'><a href=x>Buy this now, as it is the greatest offer of the year.</a></div>",
        "<div hidden><p>A text that nobody who opens this page will ever see or read.</p></div>",
        "<div class='related'><p>Another story that people who liked this one may like as well.</p></div>",
    ],
)
def test_bad_names_inside_an_article(weights, part):
    for page in (f"<article><h1>Title</h1>{ART}{part}</article>", f"<main><h1>Title</h1>{ART}{part}</main>", f"<article><h1>Title</h1>{ART}</article>{part * 20}"):
        assert html_extract.main_text(page, weights).split("\n") == ["Title", *TEXT]


def test_open_links_before_formatting_take_linear_time():
    began = time.perf_counter()
    n = 8_000
    assert html_extract.page_blocks("<a><div>" + "<b>" * n + "x" + "</a>" * n)[0].text == "x"
    assert html_extract.page_blocks("<ul>" + "<li><div>" * n + "x")[0].text == "x"
    assert time.perf_counter() - began < 2
