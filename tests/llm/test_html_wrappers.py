"""Pages whose text stands in wrappers that look like boilerplate, or in a language without known stop words."""

import pytest

from tidemark.llm import html_text

TEXT = "The first of the paragraphs is long enough to be decided by its words and it is in the page for all of you."
FOREIGN = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są obdarzeni rozumem i sumieniem."


@pytest.mark.parametrize("wrap", ['class="layout has-sidebar"', 'id="nav-open"', 'class="hidden-xs"', 'class="no-banner wide"', 'class="widget"'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrapper_keeps_text(wrap, tag):
    page = f'<body><div {wrap}><{tag}><p>{TEXT}</p></{tag}></div><footer>&copy; x</footer></body>'
    assert html_text.extract(page) == TEXT


def test_form_around_the_body():
    assert html_text.extract(f"<body><form id=f><div><p>{TEXT}</p><p>{TEXT}</p></div></form></body>") == f"{TEXT}\n\n{TEXT}"


def test_foreign_page_keeps_text():
    assert html_text.extract(f'<body><ul><li><a href="/">x</a></li></ul><div><p>{FOREIGN}</p></div></body>') == FOREIGN


def test_boilerplate_still_goes():
    """Comments as articles beside an article, a hidden article, a form in an article."""
    comment = f'<div id="comments"><article><p>{TEXT} {TEXT} {TEXT} {TEXT}</p></article></div>'
    assert html_text.extract(f"<body><article><p>{TEXT}</p><form><p>{TEXT}</p></form></article>{comment}</body>") == TEXT
    assert html_text.extract(f"<div hidden><article><p>{TEXT}</p></article></div>") == ""


@pytest.mark.parametrize(
    "part",
    [
        '<section id="related-work"><h2>Related work</h2><p>{0}</p></section>',
        '<section id="related"><h2>Related</h2><p>{0}</p></section>',
        '<h2 id="search">Search</h2><p>{0}</p>',
        '<h2 id="navigation">Navigation</h2><p>{0}</p>',
        '<h2 id="social-effects">Social effects</h2><p>{0}</p>',
        '<section id="copyright-law"><p>{0}</p></section>',
        '<div class="share-price"><p>{0}</p></div>',
        '<p class="notice-me">{0}</p>',
        '<div class="searchlight commentary"><p>{0}</p></div>',
    ],
)
def test_names_that_only_hold_such_words_stay(part):
    page = f"<body><article><h1>Title</h1><p>{TEXT}</p>{part.format(TEXT[::-1])}</article></body>"
    assert TEXT[::-1] in html_text.extract(page) and ("<h2" not in part or html_text.re.search(r"<h2[^>]*>([^<]*)", part)[1] in html_text.extract(page))


@pytest.mark.parametrize("name", ["related-posts", "shareButtons", "comment-list", "nav", "ad", "ad-slot-1", "cookie-banner", "social_links", "site-header", "newsletter-signup"])
def test_names_of_boilerplate_go(name):
    assert html_text.extract(f'<body><article><h1>Title</h1><p>{TEXT}</p><div class="{name}"><p>{TEXT[::-1]}</p></div></article></body>') == f"Title\n\n{TEXT}"
