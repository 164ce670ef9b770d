"""HTML to a pruned tree of block elements with text leaves, without a browser.

Tags are read by a scanner that doesn't go back; open elements are a stack with the usual
implied ends (``p`` before a block, list items, table cells).  Only block
elements that hold text stay in the tree; a leaf is a run of inline text
between block boundaries, its character references decoded and its white
space joined.  Elements in ``RAW`` are skipped up to their own closing tag; one
that is never closed is read as an ordinary element (a script or style ends
with the page, as in browsers).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

from ..sources.tags import Scanner

ATTR = re.compile(r"""(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; a title is metadata.
RAW = frozenset("script style title noscript template iframe object svg".split())
#: Those of them that may hold themselves, and those that end with the page if nothing closes them.
NESTED, TO_END = frozenset("template object svg".split()), frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody td textarea tfoot th thead title tr ul".split()
)
#: An opening tag ends an open element of these names, unless one of the second set is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOT_IN_P = BLOCK - {"button", "label", "option", "optgroup", "select", "textarea", "title", "td", "th", "tr", "li", "dd", "dt", "html", "head", "body"}
P_SCOPE = frozenset({"td", "th", "button", "object", "caption", "html"})


@dataclass
class Tree:
    """Nodes in page order; a leaf has text.  parent is -1 at the root."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)  # words of class, id and role
    text: list[str | None] = field(default_factory=list)
    link: list[float] = field(default_factory=list)  # share of a leaf's characters inside links

    def add(self, parent: int, tag: str, words: tuple[str, ...] = (), text: str | None = None, link: float = 0.0) -> int:
        for column, value in zip((self.parent, self.tag, self.words, self.text, self.link), (parent, tag, words, text, link), strict=True):
            column.append(value)
        return len(self.parent) - 1


def _attribute_words(attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return ()
    values = " ".join(a or b or c for _, a, b, c in ATTR.findall(attrs))
    split = re.sub(r"([a-z])([A-Z])", r"\1 \2", values)
    return tuple(dict.fromkeys(re.findall(r"[a-z]+", split.lower())))


def _closed(html: str, name: str) -> dict[int, int]:
    """Where each closed element of this name ends, by the end of its opening tag."""
    opened, ends, scanner, at = [], {}, Scanner(html), 0
    while tag := scanner.next(at):
        at = tag.end
        if tag.name != name:
            continue
        if not tag.close:
            if not (name == "svg" and tag.self_closed):
                opened.append(at)
        elif opened:
            ends[opened.pop()] = at
    return ends


def parse(html: str | None) -> Tree:
    full = Tree()
    root = full.add(-1, "root")
    names, nodes = ["root"], [root]  # the open elements; an inline one has its block's node
    open_ = Counter(names)
    parts: list[str] = []
    linked = total = anchors = 0
    ends: dict[str, dict[int, int]] = {}
    unclosed: set[str] = set()  # names without a closing tag in the rest of the page

    def skipped(name: str, at: int) -> int | None:
        """Where the raw element whose opening tag ends at ``at`` ends; None if nothing closes it."""
        if name in NESTED:
            if name not in ends:
                ends[name] = _closed(html, name)
            return ends[name].get(at)
        if name not in unclosed:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            if end:
                return end.end()
            unclosed.add(name)
        return len(html) if name in TO_END else None

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                full.add(nodes[-1], "#text", (), text, linked / max(total, 1))
            parts.clear()
        linked = total = 0

    def pop_to(depth: int) -> None:
        nonlocal anchors
        if any(n in BLOCK for n in names[depth:]):
            flush()
        anchors -= names[depth:].count("a")
        open_.subtract(names[depth:])
        del names[depth:], nodes[depth:]

    def close(of: set | frozenset, until: set | frozenset) -> None:
        if not any(open_[n] for n in of):
            return
        for d in range(len(names) - 1, 0, -1):
            if names[d] in of:
                pop_to(d)
                return
            if names[d] in until:
                return

    html = html or ""
    scanner, at = Scanner(html), 0
    while at < len(html):
        tag = scanner.next(at)
        stop = tag.start if tag else len(html)
        if stop > at:
            parts.append(html[at:stop])
            total += stop - at
            linked += (stop - at) * (anchors > 0)
        if not tag:
            break
        at, name = tag.end, tag.name
        if not name:
            continue
        if tag.close:
            if open_[name] > 0:
                depth = len(names) - 1
                while names[depth] != name:
                    depth -= 1
                pop_to(depth)
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            if name == "svg" and tag.self_closed:
                continue
            if (end := skipped(name, at)) is not None:
                at = end
                continue
        if name == "br":
            parts.append(" ")
        if name in NOT_IN_P:
            close({"p"}, P_SCOPE)
        if name in ENDS:
            close(*ENDS[name])
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        anchors += name == "a"
        names.append(name)
        open_[name] += 1
        nodes.append(full.add(nodes[-1], name, _attribute_words(tag.attrs)) if name in BLOCK else nodes[-1])
    flush()
    return _pruned(full)


def _pruned(full: Tree) -> Tree:
    """Without elements that hold no text."""
    keep = [t is not None for t in full.text]
    for i in range(len(keep) - 1, 0, -1):
        if keep[i]:
            keep[full.parent[i]] = True
    keep[0] = True
    new, tree = {}, Tree()
    for i, k in enumerate(keep):
        if k:
            new[i] = tree.add(new.get(full.parent[i], -1), full.tag[i], full.words[i], full.text[i], full.link[i])
    return tree
