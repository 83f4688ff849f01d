"""A tolerant reader of HTML: block elements as a tree, and their text as blocks in page order."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from html import unescape

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What stands before a tag's end or an attribute: the end, or a name and perhaps an equals sign.
PART = re.compile(r"([\s/]*)(?:>|([^\s/>][^\s/>=]*)(\s*=\s*)?)")
UNQUOTED = re.compile(r"[^\s>]*")
# Element names of HTML by how they are read.
#: Text up to the end tag, or to the page's end.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Skipped up to the end tag; without one, only the tag itself.
SKIPPED = frozenset("noscript template svg object audio video canvas annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button label".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot option optgroup button label summary legend".split())
SAME = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Of these only a space remains, between the words around them.
SPACED = frozenset(["br", "img", "input"])


@dataclass
class Node:
    name: str
    up: int
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Block:
    node: int
    text: str
    link_chars: int


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[Block]
    title: str = ""
    links: list[str] = field(default_factory=list)


class Source:
    """A page's markup, read from left to right in time linear in its length."""

    def __init__(self, html: str):
        self.html, self.end = html, len(html)
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.ends: dict[str, list[int]] = {}

    def tag(self, at: int) -> tuple[int, dict[str, str], bool]:
        """(place after the tag, attributes, whether it closes itself) of a tag whose name ends at `at`; the page's end if the tag never ends. Quotes count after an equals sign only, and if there is a second one."""
        html, found = self.html, {}
        if html.startswith(">", at):
            return at + 1, found, False
        while m := PART.match(html, at):
            at = m.end()
            if m[2] is None:
                return at, found, "/" in m[1]
            value = ""
            if m[3]:
                quote = html[at : at + 1]
                if self.last_quote.get(quote, -1) > at:
                    stop = html.index(quote, at + 1)
                    value, at = html[at + 1 : stop], stop + 1
                else:
                    value = UNQUOTED.match(html, at)[0]
                    at += len(value)
            found.setdefault(m[2].lower(), unescape(value))
        return self.end, found, False

    def after(self, text: str, at: int) -> int:
        """The place after the next `text`, or the page's end."""
        stop = self.html.find(text, at)
        return self.end if stop < 0 else stop + len(text)

    def end_tag(self, name: str, at: int) -> int:
        """Where the next end tag of a name begins, or -1."""
        if name not in self.ends:
            self.ends[name] = [m.start() for m in re.finditer(rf"</{re.escape(name)}(?=[\s/>])", self.html, re.IGNORECASE)]
        k = bisect_left(self.ends[name], at)
        return self.ends[name][k] if k < len(self.ends[name]) else -1


def read_page(html: str, hides: Callable[[str, dict[str, str]], bool] | None = None) -> Page:
    """Script and style contents, comments and declarations are dropped; unclosed and misplaced tags are tolerated. White space of a block is one space.

    hides: whether an inline element, given its name and attributes, goes with all that is in it.
    """
    page, source = Page([Node("#page", -1)], []), Source(html)
    open_nodes, opened, texts, link_depth, link_texts = [0], Counter(), [], 0, []
    hidden: list | None = None  # name, depth, and nodes open around an inline element that goes

    def flush() -> None:
        if texts:
            if text := " ".join("".join(texts).split()):
                page.blocks.append(Block(open_nodes[-1], text, len(" ".join("".join(link_texts).split()))))
            texts.clear()
            link_texts.clear()

    def add(text: str) -> None:
        if hidden:
            return
        texts.append(text)
        if link_depth:
            link_texts.append(text)

    def close(names: tuple, within: tuple = ()) -> None:
        """Ends the nearest open element of the names, and what is open in it, unless one of `within` comes before."""
        nonlocal link_depth, hidden
        if not any(opened[n] for n in names):
            return
        for k in range(len(open_nodes) - 1, 0, -1):
            name = page.nodes[open_nodes[k]].name
            if name in names:
                flush()
                opened.subtract(page.nodes[i].name for i in open_nodes[k:])
                del open_nodes[k:]
                link_depth = 0
                if hidden and len(open_nodes) < hidden[2]:
                    hidden = None
                return
            if name in within:
                return

    at = 0
    while at < source.end:
        start = html.find("<", at)
        if start < 0:
            add(unescape(html[at:]))
            break
        if start > at:
            add(unescape(html[at:start]))
        ends = html.startswith("/", start + 1)
        m = NAME.match(html, start + 1 + ends)
        if not m:
            if html.startswith("<!--", start):
                short = next((x for x in (">", "->") if html.startswith(x, start + 4)), None)
                at = start + 4 + len(short) if short else source.after("-->", start + 4)
            elif ends or html.startswith(("!", "?"), start + 1):
                at = source.after(">", start + 1)
            else:
                add("<")
                at = start + 1
            continue
        name = m[0].lower()
        at, told, closed = source.tag(m.end())
        if name in RAW or name in SKIPPED:
            if not ends and not closed:
                stop = source.end_tag(name, at)
                if name == "title" and not page.title:
                    page.title = " ".join(unescape(html[at : stop if stop >= 0 else source.end]).split())
                if stop >= 0:
                    at = source.after(">", stop)
                elif name in RAW:
                    at = source.end
            continue
        if name in BLOCKS:
            flush()
            if ends:
                close((name,), ("td", "th", "table") if name in ("p", "li") else ())
                link_depth = 0
                continue
            if name in CLOSES_P:
                close(("p",), ("td", "th", "li", "div", "article", "section", "body", "table", "blockquote"))
            if name in SAME:
                names, within = SAME[name]
                close(tuple(names.split()), within)
            page.nodes.append(Node(name, open_nodes[-1], told))
            link_depth = 0
            if name not in VOID:
                open_nodes.append(len(page.nodes) - 1)
                opened[name] += 1
            continue
        if hidden:
            if name == hidden[0]:
                hidden[1] += -1 if ends else 1
                if not hidden[1]:
                    hidden = None
        elif told and hides and not ends and not closed and name not in VOID and hides(name, told):
            hidden = [name, 1, len(open_nodes)]
        if name == "a":
            link_depth = 0 if ends else 1
            if not ends and (href := told.get("href")):
                page.links.append(href)
        elif name in SPACED:
            add(" ")
    flush()
    return page
