"""A scanner for the tags of a page, from left to right, in linear time on any input."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

START = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|[!?]|/(?=[^a-zA-Z])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+))")
#: The end of a comment that has begun; ``<!-->`` and ``<!--->`` are whole ones.
COMMENT_END = re.compile(r"--!?>")
#: What a tag's end is looked for by: the end, or a value and how it begins.
STOP = re.compile(r""">|=\s*+(?:(["'])|[^\s>"'][^\s>]*+)""")
#: A name, and perhaps a value: quoted, or up to white space.
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")


class Tag(NamedTuple):
    start: int
    end: int
    name: str | None = None  # none: a comment or declaration
    close: bool = False
    attrs: str = ""
    self_closed: bool = False


class Scanner:
    """Finds tags from left to right; nothing is looked at more than a few times, whatever the page.

    A quote delimits a value only behind ``=`` and only if the page has another
    one further on; else it is a character, and the tag ends at the next ``>``.
    Once a tag has run to the page's end in search of its own, quotes mean
    nothing any more.  Without a ``>`` ahead, ``<`` is text.
    """

    def __init__(self, html: str):
        self.html, self.quotes = html, True
        self.last = {s: html.rfind(s) for s in (">", '"', "'", "]]>")}

    def next(self, at: int) -> Tag | None:
        html = self.html
        while m := START.search(html, at):
            at = m.end()
            if m["comment"]:
                short = next((at + len(x) for x in (">", "->") if html.startswith(x, at)), None)
                closed = None if short else COMMENT_END.search(html, at)
                return Tag(m.start(), short or (closed.end() if closed else len(html)))
            if m["cdata"] and self.last["]]>"] >= at:
                return Tag(m.start(), html.find("]]>", at) + 3)
            if not m["name"]:
                end = html.find(">", at) + 1 if self.last[">"] >= at else len(html)
                return Tag(m.start(), end)
            end = self._end(at)
            if end:
                return Tag(m.start(), end, m["name"].lower(), bool(m["close"]), html[at : end - 1], html[end - 2] == "/")
        return None

    def _end(self, at: int) -> int:
        """Behind the tag whose name ends at ``at``; 0 if the page has no end for it."""
        if self.last[">"] < at:
            return 0
        if not self.quotes:
            return self.html.find(">", at) + 1
        i = at
        while m := STOP.search(self.html, i):
            i = m.end()
            if m.group() == ">":
                return i
            if m[1] and self.last[m[1]] >= i:
                i = self.html.find(m[1], i) + 1
        self.quotes = False
        return self.html.find(">", at) + 1


def attributes(attrs: str) -> dict[str, str]:
    """Lower-case names and decoded values; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def raw_end(html: str, name: str, at: int) -> tuple[int, int]:
    """Where the text of a script or style that begins at ``at`` ends, and where its closing tag does."""
    end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
    return (end.start(), end.end()) if end else (len(html), len(html))
