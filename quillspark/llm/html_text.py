"""Main text of web pages by block rules in two passes.

A page is cut into blocks of text at block-level tags.  Regions whose tag, role
or class names say navigation, advert, form, comment and so on never form
blocks.  Pass one decides blocks by length, link density and stop-word density:
good, bad, or open.  Pass two lets each open block inherit the label of its
nearest decided neighbours; where they differ, the run of decided text that is
longer counts, and with none it goes.  Where article (or main) regions hold the
article, blocks outside them are boilerplate and all inside stay; links decide
nothing there.  They do so if there is but one with text that isn't linked,
however short and in whatever language, or if all of them together hold at least
as much text as the good blocks outside; else (teasers around an unmarked
article) the regions count for nothing.  A page without a good block (as in
languages whose stop words aren't listed) keeps its longest run of open ones.

An article element counts as such if its own attributes don't say otherwise and
it stands in no other article and no dropped region.  One exception: a region
whose end tag is missing from there on doesn't hold the article.  Inside an
article a class or id marks a region only if all its words are marks; there the
words of ``WEAK`` don't mark paragraphs, and widgets are part of the article.

Null html is empty and gives an empty text.  Texts are whole: nothing is capped.
Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form button select option menu dialog svg math canvas audio video object map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(["article", "main"])
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark a region as not part of the article.
DROPPED_WORDS = re.compile(
    r"(?:ads?|advert(?:s|isement|ising)?|adbox|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|tions)?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|footer|header|masthead|topbar|toolbar|pagination|pager"
    r"|comments?|commentlist|respond|responses?|replies|feedback|disqus|social|share|sharing|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|copyright|disclaimer|widget)"
)
#: Words that may stand beside such words in the name of a region.
BESIDE = frozenset("site page main top bottom left right list lists item items section box bar container wrapper wrap block area inner outer post posts article articles link links button buttons slot unit thread content js global sticky fixed".split())
BESIDE_INSIDE = BESIDE | frozenset("widget user users reader readers visitor visitors".split())
#: Words that mark boxes of an article, but none of its paragraphs.
WEAK = frozenset("alert notice notices social response responses feedback".split())
PARAGRAPHS = frozenset("p blockquote li dd dt pre figcaption td".split())
#: Regions that hold articles of their own, none of them the page's.
HOLDS_ARTICLES = re.compile(r"comments?|commentlist|respond|responses?|replies|feedback|disqus|related|recommended|recommendations|sidebar|promo(?:tion|tions)?|sponsor(?:ed|s)?")
NOT_DROPPED_AFTER = frozenset("no with has without hide".split())

# Frequent function words of the languages covered.
STOP_WORDS = frozenset(
    "the of and to a in is that it for was on with be as this are at from an or by not have he you but his they we she which their all would there been one if will what has more when who so no out up said its about into than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many must before back see through way where get much go well your know should down work year because come people just say each how those take "
    "der die und das von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei den in "
    "le la les de des du un une et est que qui dans en pour pas sur par au avec ce il sont plus ne se sa son ou mais nous vous elle aux cette ses comme tout on été fait leur même ces "
    "el los las y del que se por con una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros".split()
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
END = re.compile(r"</([a-zA-Z][^\s/>]*)")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

# Rule parameters of pass one.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
LINK_HIGH = 0.33

GOOD, BAD, OPEN = 1, 0, -1


class Block:
    __slots__ = ("heading", "linked", "parts", "region")

    def __init__(self, region: int, heading: bool):
        self.parts: list[str] = []
        self.linked, self.region, self.heading = 0, region, heading  # region 0: outside all


KEPT, MAYBE, SURELY = 0, 1, 2


def _marked(group: str, inside: bool, paragraph: bool) -> int:
    """Whether a class or id names a region outside the article."""
    words = [w for w in re.split(r"[^a-z0-9]+", group) if w]
    marks = [w for k, w in enumerate(words) if DROPPED_WORDS.fullmatch(w) and (not k or words[k - 1] not in NOT_DROPPED_AFTER)]
    if inside:
        marks = [w for w in marks if w != "widget" and not (paragraph and w in WEAK)]
    if not marks or (inside and not all(w in marks or w in BESIDE_INSIDE or w.isdigit() for w in words)):
        return KEPT
    return SURELY if any(HOLDS_ARTICLES.fullmatch(w) for w in marks) else MAYBE


def _dropped(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element's own tag or attributes put it outside the article;
    surely, if an article in it can't be the page's."""
    found = KEPT
    if tag in DROPPED:
        found = SURELY if tag in ("aside", "form", "dialog", "head") else MAYBE
    if not attributes or tag in ("html", "body"):
        return found
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return SURELY
        if name == "role" and value in DROPPED_ROLES:
            found = max(found, SURELY if value in ("complementary", "dialog", "alertdialog") else MAYBE)
        if name in ("class", "id"):
            whole = inside or tag in CONTAINERS
            found = max([found, *(_marked(g, whole, tag in PARAGRAPHS) for g in value.split())])
    return found


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, without dropped regions."""
    found: list[Block] = []
    # tag, whether it starts a dropped region, and up to where an article in it or
    # in what holds it can't be the page's
    open_tags: list[tuple[str, int, float]] = []
    counts: dict[str, int] = {}
    open_blocks: list[int] = []  # places of block-level tags in open_tags
    last_end = {m[1].lower(): m.start() for m in END.finditer(html)}
    dropped = inside = links = breaks = regions = 0
    saved: list[tuple[int, int]] = []
    now: Block | None = None
    at = 0

    def text(piece: str) -> None:
        nonlocal now, breaks
        if dropped or not piece:
            return
        if now is None:
            now = Block(regions if inside else 0, any(t in HEADINGS for t, _, _ in open_tags[-4:]))
            found.append(now)
        now.parts.append(piece)
        if links:
            now.linked += len(piece.strip())
        if not piece.isspace():
            breaks = 0

    def leave(upto: int) -> None:
        nonlocal dropped, inside, links
        while len(open_tags) > upto:
            tag, drops, _ = open_tags.pop()
            counts[tag] -= 1
            if open_blocks and open_blocks[-1] == len(open_tags):
                open_blocks.pop()
            links -= tag == "a"
            if tag in CONTAINERS:
                dropped, inside = saved.pop()
            else:
                dropped -= drops > 0

    def enter(tag: str, drops: int) -> None:
        if tag in BLOCKS:
            open_blocks.append(len(open_tags))
        counts[tag] = counts.get(tag, 0) + 1
        own = len(html) if drops == SURELY else last_end.get(tag, -1) if drops else -1
        open_tags.append((tag, drops, max(own, open_tags[-1][2] if open_tags else -1)))

    def holds_no_article() -> bool:
        """Whether an article that starts here stands in a dropped region."""
        return bool(open_tags) and open_tags[-1][2] >= at

    while match := TAG.search(html, at):
        if match.start() > at:
            text(html[at: match.start()])
        at = match.end()
        if not match[2]:
            continue
        closing, tag, attributes = match[1], match[2].lower(), match[3]
        if tag == "br":
            breaks += 1
            text(" ")
            if breaks > 1:
                now = None
            continue
        if tag in BLOCKS:
            now, breaks = None, 0
        if closing:
            # a stray end tag closes nothing; others close what stands inside
            if counts.get(tag):
                k = len(open_tags) - 1
                while open_tags[k][0] != tag:
                    k -= 1
                leave(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in BLOCKS and open_blocks:  # an open paragraph ends here
            own = open_tags[open_blocks[-1]][0]
            if own == "p" or (own == tag and (tag == "li" or tag in HEADINGS)):
                leave(open_blocks[-1])
        if tag == "a":
            links += 1
        if tag in CONTAINERS:
            away = _dropped(tag, attributes, inside > 0) > 0 or (dropped > 0 and (inside > 0 or holds_no_article()))
            saved.append((dropped, inside))
            dropped = dropped + 1 if away else 0
            regions += not away and not inside
            inside += not away
            enter(tag, KEPT)
            continue
        drops = _dropped(tag, attributes, inside > 0) or (MAYBE if tag == "header" and not inside else KEPT)
        dropped += drops > 0
        enter(tag, drops)
    rest = html[at:]
    # a tag cut off by the end of the page is markup, not text
    cut = rest.rfind("<")
    if cut >= 0 and re.match(r"</?[a-zA-Z][^>]*\Z|<!", rest[cut:]):
        rest = rest[:cut]
    text(rest)
    return found


def first_pass(text: str, linked: int, heading: bool) -> int:
    """Good, bad or open by length, link density and stop-word density."""
    if linked > LINK_HIGH * max(len(text), 1):
        return BAD
    if heading or len(text) < LENGTH_LOW:
        return OPEN
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if density >= STOP_HIGH or (density >= STOP_LOW and len(text) > LENGTH_HIGH):
        return GOOD
    return OPEN


def second_pass(labels: list[int], sizes: list[int]) -> list[int]:
    """Open blocks take the label of their nearest decided neighbours; of two that
    differ, that of the run of equal labels with more text."""
    n = len(labels)
    before, after = [(OPEN, 0)] * n, [(OPEN, 0)] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        run = (OPEN, 0)
        for k in order:
            side[k] = run
            if labels[k] != OPEN:
                run = (labels[k], sizes[k] + (run[1] if run[0] == labels[k] else 0))
    out = []
    for label, (x, more_x), (y, more_y) in zip(labels, before, after):
        if label == OPEN:
            label = x if y == OPEN else y if x == OPEN else x if more_x >= more_y else y
        out.append(BAD if label == OPEN else label)
    return out


def _longest_open(texts: list[str], labels: list[int]) -> list[str]:
    """The run of open blocks with most text, the first of equals."""
    runs: list[list[str]] = [[]]
    for text, label in zip(texts, labels):
        if label == OPEN:
            runs[-1].append(text)
        else:
            runs.append([])
    return max(runs, key=lambda run: sum(map(len, run)))


def _holds_article(kept: list[tuple[Block, str]], labels: list[int]) -> bool:
    """Whether the page's article is what its article regions hold."""
    regions = {b.region for b, _ in kept if b.region}
    own = sum(len(t) for b, t in kept if b.region)
    linked = sum(b.linked for b, _ in kept if b.region)
    outside = sum(len(t) for (b, t), label in zip(kept, labels) if not b.region and label == GOOD)
    return len(regions) > 0 and (own >= outside or (len(regions) == 1 and linked < own))


def main_text(html: str | None) -> str:
    """The article's text: white space in a block is one space, blocks are joined
    by a newline."""
    kept = []
    for b in blocks(html or ""):
        # references are decoded after markup is gone, so they can't form tags
        if text := SPACE.sub(" ", unescape("".join(b.parts))).strip():
            kept.append((b, text))
    labels = [first_pass(t, b.linked, b.heading) for b, t in kept]
    if _holds_article(kept, labels):
        # what the article links to is part of it
        return "\n".join(t for b, t in kept if b.region)
    decided = second_pass(labels, [len(t) for _, t in kept])
    out = [t for (_, t), label in zip(kept, decided) if label == GOOD]
    return "\n".join(out or _longest_open([t for _, t in kept], labels))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].tolist()]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInPandas(run, "page_id long, url string, text string, n_chars long")
