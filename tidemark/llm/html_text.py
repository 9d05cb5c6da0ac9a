"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass decides each block alone, by its length, its share of
link text and its density of stop words: many links make it bad, enough length with enough stop words good, and a long
block without stop words bad; a short block stays open, and so does one between the bounds. Markup that names itself
as boilerplate (menus, forms, notices, comments) makes its blocks bad; ids of headings and sections, which come from a
heading's words, name nothing. The second pass gives each open block the label
of its nearest decided neighbours: the same on both sides, the nearer one, and at a tie the good one.

An article element is a feature beside these: within it, links and foreign words decide nothing, and neighbours count
only on the same side of its bounds. Where nothing decided is near, an open block is good within an article and bad
elsewhere; what stands beside an article is kept if the first pass makes it good. On a page without any good block the
open blocks are all the text there is, and stay.

A wrapper that only its name marks, or a form, is no boilerplate if it holds most of the page's text; articles in such
wrappers count where no other does. Where no block is good by stop words of the known languages, long blocks are.

Defined cases: null and empty html have empty text. Unclosed and misnested tags are read as browsers do in the simple
cases: an end tag closes up to its start tag or is ignored, a head ends where a body's element or text begins, a quote
that never closes ends with its tag. What browsers never show goes: scripts, styles, templates, the contents of svg and
media elements; xmp and math stay. Blocks of white space only are no blocks. A page of any length is read whole, in
time linear in it. Null page_id and url and repeated rows are kept as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's elements by their part in a page.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead title tr ul xmp".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp plaintext".split())
UNSEEN = frozenset("template svg audio video canvas datalist".split())
OF_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
BAD = frozenset("nav footer aside form menu button select option fieldset label legend dialog header search".split())
ARTICLE, MAIN = frozenset(["article"]), frozenset(["main"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words that name boilerplate where a class, id or role is made of them, alone or with words for its place and shape.
BAD_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements banner bottombar breadcrumb breadcrumbs captcha comment commentlist comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe taboola teaser toolbar topbar widget".split()
)
SHAPE_WORDS = frozenset(
    "area articles bar block blocks bottom box btn button buttons center col column container content form global group head header icon icons inner item items js label left line link links list main media message news outer page panel pane policy post posts primary right row secondary section site slot small sticky stories sub text top unit wide wrap wrapper zone".split()
)
PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
BAD_COMPOUND = re.compile(r"(?:.*\s)?(?:bottom-?bar|byline-share|site-?header|page-?header|skip-?link)(?:\s.*)?", re.I)
BAD_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:alert|warning)(?:$|[\s_-])|^(?:.*\s)?(?:header|top)(?:\s.*)?$", re.I)
# Names that tell a wrapper's state or screen size, not what it holds.
STATE = re.compile(r"(?:has|with|without|no|not|is|js|show|hide)[_-].*|.*[_-](?:open|opened|closed|active|enabled|disabled|visible|collapsed|xs|sm|md|lg|xl|print)", re.I)
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Frequent words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that for it was on are as with his they at be this from i have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now my made over did down only way find use may these also "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous mais comme aux cette ses tout elle fait été on être deux même ont leur "
    "el que y los del se las por con no para su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH, LINKS_HIGH = 0.15, 0.25, 0.3
#: A long block of fewer stop words than this has none to speak of.
STOP_NONE = 0.05
#: A wrapper that is boilerplate by name only, or a form, is none if it holds more than this share of the page's text.
MOST = 0.7

NAME, BLANKS = re.compile(r"[a-zA-Z][^\s/>]*+"), re.compile(r"[\s/]*+")
ATTRIBUTE, EQUALS, BARE = re.compile(r"[^\s/>][^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
SOFT, HARD = 1, 2


class Scanner:
    """A page's tokens. Every character is looked at a bounded number of times, whatever the markup is like."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last_quote = {'"': page.rfind('"'), "'": page.rfind("'")}
        self.last_close = page.rfind(">")

    def tokens(self) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
        """(kind, text or tag name, attributes); kinds: text, start, end, literal (text without character references)."""
        page, at, kept = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            if at > self.last_close:
                break  # no tag is complete from here on
            ending = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + ending)
            if not name and not page.startswith(("!", "?", "/"), at + 1):
                at += 1  # a less-than sign in text
                continue
            if at > kept:
                yield "text", page[kept:at], []
            if not name:
                kept = at = self.declaration(at)
                continue
            tag = name[0].lower()
            attributes, kept = self.tag(name.end())
            at = kept
            if ending:
                yield "end", tag, []
                continue
            yield "start", tag, attributes
            if tag in RAW:
                close = None if tag == "plaintext" else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if tag in ("xmp", "plaintext"):
                    yield "literal", page[at : close.start() if close else len(page)], []
                kept = at = close.end() if close else len(page)
                yield "end", tag, []
        if kept < len(page):
            rest = page[kept:]
            # A tag that the page's end cuts off is no text.
            cut = next((m.start() for m in re.finditer(r"<[/!?a-zA-Z]", rest)), len(rest)) if kept + rest.find("<") > self.last_close else len(rest)
            yield "text", rest[:cut], []

    def declaration(self, at: int) -> int:
        """The end of a comment, CDATA section, document type or the like."""
        page = self.page
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(opening, at):
                if opening == "<!--" and page.startswith((">", "->"), at + 4):
                    return page.index(">", at + 4) + 1
                end = page.find(closing, at + len(opening))
                return end + len(closing) if end >= 0 else len(page)
        return page.index(">", at) + 1

    def tag(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """The attributes of a tag whose name ends at a place, and the tag's end."""
        page, found = self.page, []
        while True:
            at = BLANKS.match(page, at).end()
            if at >= len(page):
                return found, at
            if page[at] == ">":
                return found, at + 1
            name = ATTRIBUTE.match(page, at)
            at, value = name.end(), ""
            if equals := EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in self.last_quote and quote:
                    if self.last_quote[quote] > at:
                        end = page.index(quote, at + 1)
                        value, at = page[at + 1 : end], end + 1
                    else:  # it never closes
                        end = page.find(">", at)
                        end = len(page) if end < 0 else end
                        value, at = page[at + 1 : end], end
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            found.append((name[0].lower(), value))


class Block(NamedTuple):
    text: str
    links: float
    """Share of link text."""
    bad: bool
    """Named as boilerplate."""
    within: int
    """The number of the article or main element around it, 0 without any."""
    article: bool
    """Whether that is an article."""
    heading: bool


@lru_cache(65_536)
def names_boilerplate(token: str) -> bool:
    """Whether a class or id is a word for boilerplate or made of such and words for its place: share-buttons, not share-price."""
    parts = [w.lower() for w in PARTS.split(token.strip("_-")) if not w.isdigit()]
    return any(w in BAD_WORDS for w in parts) and all(w in BAD_WORDS or w in SHAPE_WORDS for w in parts)


def marked(attributes: list[tuple[str, str]], inside: bool, titled: bool = False) -> int:
    """Whether attributes name what an element holds as no part of the main text (SOFT), or hide it (HARD)."""
    by_name = 0
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return HARD
        if name == "style" and UNSHOWN.search(value):
            return HARD
        if name in ("class", "id", "role", "aria-label") and not (titled and name in ("id", "aria-label")):
            tokens = [w for w in html.unescape(value).split() if not STATE.fullmatch(w)]
            says = " ".join(tokens)
            named = any(map(names_boilerplate, tokens)) if name != "aria-label" or len(tokens) == 1 else False
            if named or BAD_COMPOUND.fullmatch(says) or not inside and name != "aria-label" and BAD_OUTSIDE.search(says):
                by_name = SOFT
    return by_name


class Blocks:
    """A page's blocks, gathered token by token."""

    def __init__(self) -> None:
        self.found: list[tuple[str, float, int, int, bool]] = []
        self.stack: list[tuple[str, int, int]] = []  # tag, innermost flag, container
        self.open: dict[str, list[int]] = {}  # places in the stack, by tag
        self.walls: list[int] = []  # places of block-level elements in the stack
        self.flags: list[tuple[int, int]] = [(0, 0)]  # the flag around it, kind: 0 for a container's start
        self.kinds = [""]  # container's tag, by number
        self.text: list[str] = []
        self.linked = 0
        self.heading = False

    def here(self) -> tuple[int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0)

    def flag(self, around: int, kind: int) -> int:
        self.flags.append((around, kind))
        return len(self.flags) - 1

    def push(self, tag: str, flag: int, within: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.walls.append(len(self.stack))
        self.stack.append((tag, flag, within))

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag in BLOCK:
                self.walls.pop()

    def decided(self) -> list[Block]:
        """The blocks, once it is known what each flagged element holds.

        What a wrapper's name says does not hold for most of a page's text, nor, where all of a page's containers stand
        in such wrappers, for the containers.
        """
        held = [0] * len(self.flags)
        for text, _, flag, _, _ in self.found:
            held[flag] += len(text)
        total = sum(held)
        for k in range(len(held) - 1, 0, -1):
            held[self.flags[k][0]] += held[k]
        bad, hard = [False] * len(held), [False] * len(held)

        def spread(reset: bool) -> None:
            for k in range(1, len(held)):
                around, kind = self.flags[k]
                hard[k] = hard[around] or kind == HARD
                bad[k] = hard[k] if kind == 0 and reset else bad[around] or kind == HARD or kind == SOFT and held[k] <= MOST * total

        spread(False)
        if not any(within and not bad[flag] for _, _, flag, within, _ in self.found):
            spread(True)
        return [Block(text, links, bad[flag], within, self.kinds[within] in ARTICLE, heading) for text, links, flag, within, heading in self.found]

    def close(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((text, self.linked / max(1, len(text) - text.count(" ")), *self.here(), self.heading))
        self.text, self.linked = [], 0

    def add(self, text: str) -> None:
        if self.open.get("head") and not text.isspace() and not self.open.get("noscript"):
            self.pop_to(self.open["head"][0])
        self.text.append(text)
        if self.open.get("a"):
            self.linked += len("".join(text.split()))

    def start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if self.open.get("head") and tag not in OF_HEAD and not self.open.get("noscript"):
            self.close()
            self.pop_to(self.open["head"][0])
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            self.close()
            self.heading = tag in HEADING
            if tag in ("p", "li", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
                self.pop_to(len(self.stack) - 1)
        if tag == "a" and self.open.get("a"):
            self.end("a")
        if tag in VOID:
            return
        flag, within = self.here()
        if tag in ARTICLE and self.kinds[within] not in ARTICLE or tag in MAIN and not within:
            self.kinds.append(tag)
            within = len(self.kinds) - 1
            flag = self.flag(flag, 0)
        inside = self.kinds[within] in ARTICLE
        own = tag in BAD and not (tag == "header" and within)
        named = 0 if tag in ("html", "body") or tag in ARTICLE or tag in MAIN else marked(attributes, inside, tag in HEADING or tag == "section")
        flagged = HARD if tag in ("head", "noscript") and self.open.get("head") or tag == "head" or tag in UNSEEN or own and tag != "form" else max(SOFT * own, named)
        if flagged:
            flag = self.flag(flag, flagged)
        if tag in BLOCK or flagged or tag in ("a", "noscript"):
            self.push(tag, flag, within)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.close()
            self.heading = False
        places = self.open.get(tag)
        # An inline end tag closes nothing outside its block.
        if places and (tag in BLOCK or not self.walls or places[-1] > self.walls[-1]):
            self.pop_to(places[-1])


def blocks(page: str) -> list[Block]:
    out = Blocks()
    unseen, depth = "", 0
    for kind, what, attributes in Scanner(page).tokens():
        if unseen:  # inside an element that is never shown
            if what == unseen and kind in ("start", "end"):
                depth += 1 if kind == "start" else -1
                unseen = unseen if depth else ""
        elif kind == "text":
            out.add(html.unescape(what))
        elif kind == "literal":
            out.add(what)
        elif kind == "end":
            out.end(what)
        elif what in UNSEEN:
            if not (attributes and attributes[-1] == ("/", "")):
                unseen, depth = what, 1
        else:
            out.start(what, attributes)
    out.close()
    return out.decided()


def density(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]{}*#$%&|<>«»„“”").lower() for w in text.split()]
    return sum(w in STOP for w in words) / max(1, len(words))


def first_pass(b: Block, foreign: bool = False) -> bool | None:
    """True good, False bad, None open. On a page in a language whose stop words are not known, length decides alone."""
    if b.bad:
        return False
    share = density(b.text)
    if b.links > LINKS_HIGH:  # a linked headline, or a link in an article, says nothing by itself
        return None if b.heading or b.article or len(b.text) > LENGTH_HIGH and share >= STOP_LOW else False
    if len(b.text) < LENGTH_LOW:
        return False if b.text.startswith("©") and not b.within else None
    if share >= STOP_HIGH or len(b.text) > LENGTH_HIGH and share >= STOP_LOW or foreign:
        return True
    return None if share >= STOP_NONE or b.within else False


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take their nearest decided neighbours' label, from the same side of a container's bounds.

    Blocks that markup names as boilerplate are apart from the text around them and decide nothing for it.
    """
    n = len(found)
    near: list[list[tuple[int, bool] | None]] = [[None, None] for _ in range(n)]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for k in order:
            if labels[k] is not None and not found[k].bad:
                last[found[k].within] = (k, labels[k])
            near[k][side] = last.get(found[k].within)
    bare = True not in labels
    out = []
    for k, label in enumerate(labels):
        if label is None:
            before, after = near[k]
            if bare or not before and not after:
                label = bare or bool(found[k].within)
            elif not before or not after:
                label = (before or after)[1]
            elif before[1] == after[1]:
                label = before[1]
            else:
                d = (k - before[0]) - (after[0] - k)
                label = True if d == 0 else (before if d < 0 else after)[1]
        out.append(label)
    return out


def extract(page: str | None) -> str:
    found = blocks(page or "")
    labels = [first_pass(b) for b in found]
    if True not in labels:  # the known stop words make no block good: they say nothing of this page
        labels = [first_pass(b, True) for b in found]
    return "\n\n".join(b.text for b, keep in zip(found, second_pass(found, labels), strict=True) if keep)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Narrow: no shuffle."""
    pages = pages.select("page_id", "url", "html")

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars bigint")
