"""Main text of web pages by tree scoring.

Paragraphs pass points (one, one for each comma, up to three for length) to
their parent, and half of them to its parent; an element's points are
discounted by the share of its text that is link text.  The element with most
points is the content, or the article element around it.  Its siblings are
kept if they have a good part of its points, or are headings or paragraphs of
prose; where no article element tells its bounds, so are siblings with prose
of its ancestors.  Menus, headers, footers, sidebars, notices, adverts, forms
and comments never score nor stay; titles in an article's own header do.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import with_columns
from .html_tree import Node, read_page

# What isn't the article, by element, role, and words of class and id.
DROPPED = frozenset("head nav header footer aside form button select dialog menu fieldset search option label".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo outbrain taboola".split())
#: One of these in a name is enough.
STRONG = ADVERTS | frozenset(
    "popup modal overlay banner nav navbar navigation breadcrumb breadcrumbs sidebar footer foot masthead topbar comment comments commentlist disqus cookie cookies gdpr newsletter subscribe signup login "
    "toolbar pagination pager recommended menu".split()
)
#: With these, a name's other words have to be of the same kind, or of FILLERS: an article may have side-effects and related-work.
WEAK = frozenset("header side discussion respond reply replies consent notice notices notification alert share sharing social related promotion widget skip byline hidden more-like".split())
FILLERS = frozenset(
    "box wrapper wrap container area block section list bar panel inner outer main top bottom left right content item items site page global primary secondary links link button buttons icons icon col column region holder module unit slot "
    "posts articles stories topics count form body text title label group strip zone info warning left center small large fixed sticky".split()
)
LIKELY = frozenset("article content post entry body main story text page".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote td".split())
LISTS = frozenset("ul ol dl table figure".split())
#: Elements of text, which go by their class alone: their ids are targets of links.
TEXTUAL = HEADINGS | PROSE | frozenset("li dt dd th tr figure figcaption hgroup address summary".split())
#: Words of class and id that drop an article element, too.
NEVER = frozenset("comment comments ad ads advert adverts advertisement sidebar cookie sponsored".split())
#: A name with one of these tells what is elsewhere on the page (has-sidebar).
ABOUT = frozenset("has with no without".split())
WORDS = re.compile(r"[a-z]+|\d+")


def names_of(value: str) -> list[list[str]]:
    """The words of each name in a class or id, without names that speak of other elements."""
    names = [WORDS.findall(x) for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split()]
    return [x for x in names if x and not ABOUT.intersection(x)]


def only(name: list[str], kinds: frozenset) -> bool:
    """Whether a name has words of the kinds, and else fillers and numbers."""
    return bool(kinds.intersection(name)) and all(x in STRONG or x in WEAK or x in FILLERS or x.isdigit() for x in name)


def is_hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()


def is_dropped(node: Node) -> bool:
    if node.name in DROPPED:
        return True
    if not node.attributes or node.name in ("html", "body", "main"):
        return False
    a = node.attributes
    if is_hidden(a) or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    classes, ids = names_of(a.get("class", "")), names_of(a.get("id", ""))
    if node.name in TEXTUAL:
        return any(only(x, STRONG | WEAK) for x in classes)
    if any(NEVER.intersection(x) for x in classes) or any(only(x, STRONG if node.name in ("section", "article") else STRONG | WEAK) for x in ids):
        return True
    # page-footer is a footer, not a page; a post with the mark `related` is a post
    unlikely = any(STRONG.intersection(x) or only(x, WEAK) for x in classes)
    return node.name != "article" and unlikely and not any(LIKELY.issuperset(x) for x in classes + ids)


def is_inline_advert(name: str, a: dict[str, str]) -> bool:
    """Whether an element within a line of text is an advert, or hidden."""
    return is_hidden(a) or any(only(x, ADVERTS) for x in names_of(a.get("class", "")))


def drops(nodes: list[Node]) -> list[bool]:
    """For each node, whether it or one around it is dropped. An element around `main` stays whatever its names; headings stay in the header of an article."""
    around, out = set(), [False] * len(nodes)
    for node in nodes:
        if node.name == "main":
            at = node.up
            while at >= 0 and at not in around:
                around.add(at)
                at = nodes[at].up
    for i, node in enumerate(nodes):  # parents come first
        up = node.up
        if up < 0 or i in around:
            continue
        own_title = node.name in HEADINGS and nodes[up].name == "header" and nodes[nodes[up].up].name == "article" and not out[nodes[up].up]
        out[i] = not own_title and (out[up] or is_dropped(node))
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main content, joined by line breaks; empty if there is none."""
    if not html:
        return ""
    page = read_page(html, is_inline_advert)
    dropped = drops(page.nodes)
    blocks = [b for b in page.blocks if not dropped[b.node]]
    points, chars, links = ([0.0] * len(page.nodes) for _ in range(3))
    prose, titled = [False] * len(page.nodes), [False] * len(page.nodes)
    for b in blocks:
        node = page.nodes[b.node]
        titled[b.node] |= node.name in HEADINGS
        chars[b.node] += len(b.text)
        links[b.node] += b.link_chars
        prose[b.node] |= node.name in PROSE
        if node.name in HEADINGS:
            continue
        own = 1 + b.text.count(",") + b.text.count("，") + min(len(b.text) // 100, 3)
        if node.name not in PROSE:
            own *= 0.25 if node.name in ("li", "dd", "dt") else 0.5
        at = node.up if node.name in PROSE or node.name in ("li", "dd", "dt") else b.node
        for share in (1, 0.5):
            if at >= 0:
                points[at] += own * share
                at = page.nodes[at].up
    for i in range(len(page.nodes) - 1, 0, -1):  # children come after their parents
        up = page.nodes[i].up
        chars[up] += chars[i]
        links[up] += links[i]
        prose[up] |= prose[i]
        titled[up] |= titled[i]
    scores = [p * (1 - links[i] / chars[i]) if chars[i] else 0.0 for i, p in enumerate(points)]
    for i, node in enumerate(page.nodes):
        if scores[i] and (node.name in ("article", "main") or any(LIKELY.intersection(x) for k in ("class", "id") for x in names_of(node.attributes.get(k, "")))):
            scores[i] *= 1.25
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    if not scores[best]:
        inside = [i for i, n in enumerate(page.nodes) if n.name in ("article", "main") and chars[i] and not dropped[i]]
        if not inside:
            return ""
        best = inside[0]
    # the article around the winner tells its bounds
    at = best
    while at >= 0 and page.nodes[at].name != "article":
        at = page.nodes[at].up
    bounded = at >= 0
    best = at if bounded else best
    kept, least = {best}, max(1.0, 0.2 * scores[best])
    children: list[list[int]] = [[] for _ in page.nodes]
    for i, node in enumerate(page.nodes):
        if node.up >= 0 and chars[i] and not dropped[i]:
            children[node.up].append(i)
    at = best
    while page.nodes[at].up >= 0 and page.nodes[at].name not in ("main", "body"):
        siblings = [i for i in children[page.nodes[at].up] if i != at]
        for i in siblings:
            name, plain = page.nodes[i].name, links[i] < 0.25 * chars[i]
            if scores[i] >= least or plain and (name in PROSE and chars[i] >= 80 or not bounded and (prose[i] or name in LISTS)):
                kept.add(i)
        last = max([at, *[i for i in siblings if i in kept]])
        kept.update(i for i in siblings if titled[i] and i < last and (page.nodes[i].name in HEADINGS or links[i] < 0.25 * chars[i]))
        if bounded:
            break
        at = page.nodes[at].up
    within = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        within[i] = i in kept or node.up >= 0 and within[node.up]
    return "\n".join(b.text for b in blocks if within[b.node])


ADDED = T.StructType([T.StructField("main_text", T.StringType())])


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """The columns of `pages` and main_text (a column of that name is replaced): empty for null, empty and contentless pages. Rows are independent; whole pages are read."""
    return with_columns(pages, html_column, ADDED, lambda pages: [pa.array([main_text(x.as_py()) for x in pages], pa.string())])
