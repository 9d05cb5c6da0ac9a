"""The two passes of the block rules on pages without an article element, text that must not be lost, and hostile markup."""

import re
import time

import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import extract

TEXT = "The first of the paragraphs is long enough to be decided by its words and it is in the page for all of you."
OTHER = "This is another of the paragraphs, and it is there so that the rest of them have a good neighbour in the page."
MENU = '<div><ul><li><a href="/a">About</a></li><li><a href="/b">Buy now</a></li></ul></div>'


def truth(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
    return "\n\n".join(p for p in parts if p)


def test_pages_without_their_article_element(spark, sf, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet").collect() if r["html"]]
    bare = [(re.sub(r"</?article>|</?nav>", "", p).replace(' class="ad"', ""), truth(p)) for p in pages]
    wrong = sum(extract(re.sub(r"</?article>", "", p)) != truth(p) for p in pages)
    assert wrong <= 0.02 * len(pages)
    ruled = sum(extract(p) == want for p, want in bare)
    assert ruled >= 0.7 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "first_pass", lambda b, foreign=False: False if b.bad else None)
        assert sum(extract(p) == want for p, want in bare) < 0.01 * ruled
    with monkeypatch.context() as m:
        m.setattr(html_text, "second_pass", lambda found, labels: [bool(x) for x in labels])
        assert sum(extract(p) == want for p, want in bare) < 0.01 * ruled
        assert sum(extract(p) != truth(p) for p in pages) > 0.9 * len(pages)


def test_first_pass_by_density_length_and_links():
    page = f"{MENU}<h2>Short title</h2><p>{TEXT}</p><p>Short.</p><p>{OTHER}</p><div>{'zzkr brng ' * 30}</div>{MENU}"
    assert extract(page) == f"Short title\n\n{TEXT}\n\nShort.\n\n{OTHER}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>T</title><meta name=a><body><p>{TEXT}</p></body>", TEXT),  # the head is not closed
        (f"<head><title>T</title><p>{TEXT}</p>", TEXT),
        (f"<head><noscript><p>Switch scripts on.</p></noscript><p>{TEXT}</p>", TEXT),
        (f"<article><h1><a href=x>A linked heading</a></h1><p>{TEXT}</p></article>", f"A linked heading\n\n{TEXT}"),
        (f"<h1><a href=x>A linked heading</a></h1><p>{TEXT}</p>", f"A linked heading\n\n{TEXT}"),
        (f"<article><p>{TEXT}</p><ul><li><a href=x>A source</a><li><a href=y>Another</a></ul><p>{OTHER}</p></article>", f"{TEXT}\n\nA source\n\nAnother\n\n{OTHER}"),
        (f"<article><p>{TEXT} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", f"{TEXT} x=2"),
        (f"<article><p>{TEXT}</p><xmp>a <b> &amp; c</xmp></article>", f"{TEXT}\n\na <b> &amp; c"),
        (f"<article><p>{TEXT}</p><noscript><p>{OTHER}</p></noscript></article>", f"{TEXT}\n\n{OTHER}"),
        (f"<article><p>{TEXT}</p></article><div><p>{OTHER}</p></div>", f"{TEXT}\n\n{OTHER}"),  # beside an article
        (f"<article><p>{TEXT}</p><p class=warning>Mind the gap.</p></article>", f"{TEXT}\n\nMind the gap."),
        ("<p>A short page.</p>", "A short page."),
        (f"{MENU}<p>A short page.</p><footer>&copy; x</footer>", "A short page."),
        (f'<p>{TEXT} <a href="x>y</a> z</p><p>{OTHER}</p>', f"{TEXT} y z\n\n{OTHER}"),  # the quote never closes
        (f"<p>{TEXT} <a title='>'>y</a> 1 < 2 <3</p>", f"{TEXT} y 1 < 2 <3"),
        (f"<p>{TEXT}</p><p class='x", TEXT),  # the page ends within a tag
        (f"<article><p>{TEXT}</p><svg><title>t</title></svg><video><p>No video</p></video><template><p>x</p></template></article>", TEXT),
        (f"<article><p>{TEXT}</p><script>'<p>x</p>'</script><textarea><p>y</textarea><select><option>z<option>w</select></article>", TEXT),
        (f"<p>{TEXT}</p></section></b></p><p>{OTHER}", f"{TEXT}\n\n{OTHER}"),
        (f"<!-- > --><!--><p>{TEXT}<!-- a -- > b --></p><![CDATA[x]]><?php y ?>", TEXT),
    ],
)
def test_text_that_must_stay(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("piece", ["<a '", "<div>", '<a href="', "<!--", "<script", "<", "<! ", "<a = =", "<![CDATA[", "<style>", "<b hidden><div>", "<xmp>", "</section>", "<a href='>"])
def test_hostile_markup_is_read_in_linear_time(piece):
    start = time.monotonic()
    extract("<div>" * 1000 + piece * (2_000_000 // len(piece)) + "</section>" * 1000)
    assert time.monotonic() - start < 20


def test_long_page_is_read_whole():
    paragraph = f"<p>{TEXT}</p>"
    start = time.monotonic()
    text = extract(f"<div>{paragraph * (10_000_000 // len(paragraph))}</div>")
    assert len(text.split("\n\n")) == 10_000_000 // len(paragraph) and time.monotonic() - start < 60
