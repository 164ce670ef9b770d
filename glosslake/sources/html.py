"""Static HTML as two child tables: text nodes and elements, in document order.

One small Python step reads each page's markup; what it emits is already
filtered (no text of scripts and styles, no elements that no scanner looks at),
because a filter can't be pushed through it.  What only the open elements tell
(the scopes around a property, the strings of a JSON-LD script) comes with the
element, so that nothing has to join or parse again.  Broken markup is
tolerated: unclosed elements end where an enclosing one ends.  A page takes
time in proportion to its length and to what it gives, whatever it holds.
An element has its text, or the scopes around it, only where these may name a
work; contents of templates other than open shadow roots are no part of a page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import FOUND_ARROW, FOUND_DDL
from .jsonld import jsonld_values
from .splits import bounded, spread
from .tags import Scanner, attributes, raw_end

# Elements whose text is not read, and elements without content.
UNREAD = ("SCRIPT", "STYLE", "NOSCRIPT")
SCOPES = ("div", "section", "article")
RAW = ("script", "style")
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HOSTS = frozenset("article aside blockquote body div footer h1 h2 h3 h4 h5 h6 header main nav p section span".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a property's value holds if it names a work.
MARK = re.compile(r"10\.|arxiv", re.I)
#: Classes of the marks that ``render`` writes; text inside of them was read before.
OWN_CLASSES = ("gl-highlight", "gl-sentence")

TEXT_NODES = f"array<struct<node_ord:int,text:string,parent_tag:string,parent_classes:array<string>,in_body:boolean,found:array<struct<{FOUND_DDL}>>>>"
ELEMENTS = (
    "array<struct<el_ord:int,tag:string,attrs:map<string,string>,text_content:string,subtree_end:int,"
    "values:array<string>,scopes:array<struct<el_ord:int,itemtype:string>>>>"
)
_TEXT = pa.list_(pa.struct([
    ("node_ord", pa.int32()), ("text", pa.string()), ("parent_tag", pa.string()), ("parent_classes", pa.list_(pa.string())), ("in_body", pa.bool_()),
    ("found", pa.list_(pa.struct(FOUND_ARROW))),
]))
_ELEMENT = pa.list_(pa.struct([
    ("el_ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text_content", pa.string()), ("subtree_end", pa.int32()),
    ("values", pa.list_(pa.string())), ("scopes", pa.list_(pa.struct([("el_ord", pa.int32()), ("itemtype", pa.string())]))),
]))


class _Reader:
    """Reads one page: text runs by parent, and the elements that carry metadata.

    The tree's order has detours: an element's open shadow root comes before
    its other children, wherever its template is.  In a page with such
    templates every element keeps what it holds, and these lists are read in
    the tree's order at the end.  Text of kept elements is joined once for the
    page; each of them is a slice of it, and is cut out only if it may name a
    work.
    """

    def __init__(self, html: str):
        self.stack: list[dict] = []
        self.open: Counter[str] = Counter()
        self.texts: list[dict] = []
        self.elements: list[dict] = []
        self.run: list[str] = []
        self.content: list[str] = []
        self.slices: list[tuple[dict, int, int, tuple | None]] = []
        self.length = self.keeping = self.inert = self.n = 0
        self.scope: tuple | None = None  # (outer scope, number, itemtype)
        self.root: list = []
        self.detours = "shadowrootmode" in html.lower()
        self._read(html)

    def _read(self, html: str) -> None:
        scanner, at = Scanner(html), 0
        while at < len(html):
            tag = scanner.next(at)
            stop = tag.start if tag else len(html)
            if stop > at:
                self._data(unescape(html[at:stop]))
            if not tag:
                break
            at = tag.end
            if not tag.name:
                self._end_run()
            elif tag.close:
                self._close(tag.name)
            else:
                self._start(tag.name, attributes(tag.attrs))
                if tag.name in RAW:
                    stop, at = raw_end(html, tag.name, tag.end)
                    self._data(html[tag.end : stop])
                    self._close(tag.name)
        self._end_run()
        while self.stack:
            self._leave()
        self._cut()
        if self.detours:
            self._in_tree_order()

    def _data(self, data: str) -> None:
        self.run.append(data)
        if self.keeping:
            self.content.append(data)
            self.length += len(data)

    def _end_run(self) -> None:
        text = "".join(self.run)
        self.run = []
        if self.inert or not text.strip():
            return
        tag, classes = (self.stack[-1]["shown"], self.stack[-1]["classes"]) if self.stack else (None, [])
        if tag not in UNREAD and not set(classes) & set(OWN_CLASSES):
            self._hold(-1 - len(self.texts))
            self.texts.append({"node_ord": len(self.texts), "text": text, "parent_tag": tag, "parent_classes": classes, "in_body": not self.open["head"]})

    def _hold(self, x) -> None:
        """Elements by number, texts by negative numbers, and lists of both."""
        if self.detours:
            (self.stack[-1]["holds"] if self.stack else self.root).append(x)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        self._end_run()
        if self.open["head"] and (tag == "body" or self.stack[-1]["tag"] == "head" and tag not in IN_HEAD):
            self._close("head")
        host = self.stack[-1] if self.stack else None
        shadow = tag == "template" and attrs.get("shadowrootmode", "").lower() == "open" and host is not None and host["shadow"] is None and (host["tag"] in HOSTS or "-" in host["tag"])
        data = tag == "script" and attrs.get("type", "").lower() == "application/ld+json"
        prop, row = attrs.get("itemprop"), None
        if not self.inert and (tag in ("meta", "link") or data or tag == "a" and "href" in attrs or prop is not None or "itemscope" in attrs):
            row = {"el_ord": self.n, "tag": tag.upper(), "attrs": list(attrs.items()), "text_content": None, "subtree_end": self.n, "values": [], "scopes": []}
            self.elements.append(row)
        value = next((attrs[a] for a in ("content", "href", "src") if a in attrs), None)
        if row is not None and prop is not None and value is not None and MARK.search(value):
            row["scopes"] = _scopes(self.scope)
        self._hold(self.n)
        at = self.n
        self.n += 1
        if tag in VOID:
            return
        keep = row is not None and (data or prop is not None and value is None)
        own = {
            "tag": tag, "shown": None if shadow else tag.upper(), "classes": attrs.get("class", "").split(), "row": row, "from": self.length if keep else None, "inert": tag == "template" and not shadow,
            "outer": self.scope, "data": data, "holds": [], "shadow": None, "attached": shadow,
        }
        if shadow:
            host["shadow"] = own["holds"]
        if tag in SCOPES and "itemscope" in attrs:
            self.scope = (self.scope, at, attrs.get("itemtype", ""))
        self.stack.append(own)
        self.open[tag] += 1
        self.inert += own["inert"]
        self.keeping += keep

    def _close(self, tag: str) -> None:
        if self.open[tag]:
            self._end_run()
            while self.stack and self._leave() != tag:
                pass

    def _leave(self) -> str:
        """Closes the innermost element."""
        e = self.stack.pop()
        self.open[e["tag"]] -= 1
        self.inert -= e["inert"]
        self.scope = e["outer"]
        if e["row"] is not None:
            e["row"]["subtree_end"] = self.n - 1
        if e["from"] is not None:
            self.keeping -= 1
            self.slices.append((e["row"], e["from"], self.length, None if e["data"] else e["outer"], e["data"]))
        if not e["attached"] and (e["holds"] or e["shadow"]):
            self._hold([e["shadow"] or [], e["holds"]])
        return e["tag"]

    def _cut(self) -> None:
        whole = "".join(self.content)
        marks = [m.start() for m in MARK.finditer(whole)]
        for row, low, high, scope, data in self.slices:
            if data:
                row["text_content"] = whole[low:high]
                row["values"] = jsonld_values(whole[low:high])
            else:
                i = bisect_left(marks, low)
                if i < len(marks) and marks[i] < high:
                    row["text_content"], row["scopes"] = whole[low:high], _scopes(scope)

    def _in_tree_order(self) -> None:
        final, texts, todo = {}, [], [self.root]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(reversed(x))
            elif x < 0:
                texts.append(self.texts[-1 - x])
            else:
                final[x] = len(final)
        for i, node in enumerate(texts):
            node["node_ord"] = i
        for row in self.elements:
            at, size = final[row["el_ord"]], row["subtree_end"] - row["el_ord"]
            row["el_ord"], row["subtree_end"] = at, at + size
            row["scopes"] = [{"el_ord": final[s["el_ord"]], "itemtype": s["itemtype"]} for s in row["scopes"]]
        self.texts = texts
        self.elements.sort(key=lambda r: r["el_ord"])


def _scopes(scope: tuple | None) -> list[dict]:
    """The scope and those around it, from the outermost one."""
    out = []
    while scope is not None:
        out.append({"el_ord": scope[1], "itemtype": scope[2]})
        scope = scope[0]
    return out[::-1]


def parse_pages(pages: DataFrame, find: Callable[[], Callable[[str], Iterator[tuple]]] | None = None) -> DataFrame:
    """page_id, url, text_nodes, elements; null html has neither.

    find: makes a function that gives a text's matches; then each text node
    holds what was ``found`` in it, and its text doesn't leave the worker.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = find() if find else None
        for batch in batches:
            texts, elements = [], []
            for html in batch.column("html"):
                reader = _Reader(html.as_py() or "")
                for node in reader.texts:
                    node["found"] = [dict(zip(_FOUND_NAMES, m, strict=True)) for m in matches(node["text"])] if matches and node["in_body"] else []
                    if matches:
                        node["text"] = None
                texts.append(reader.texts)
                elements.append(reader.elements)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, _TEXT), pa.array(elements, _ELEMENT)],
                names=["page_id", "url", "text_nodes", "elements"],
            )

    key = pages.schema["page_id"].dataType.simpleString()
    return bounded(spread(pages.select("page_id", "url", "html"))).mapInArrow(read, f"page_id {key}, url string, text_nodes {TEXT_NODES}, elements {ELEMENTS}")


_FOUND_NAMES = [name for name, _ in FOUND_ARROW]


def text_nodes(parsed: DataFrame) -> DataFrame:
    """page_id, node_ord, text, parent_tag, parent_classes of the body's accepted text nodes."""
    each = parsed.select("page_id", F.explode("text_nodes").alias("n")).select("page_id", "n.*")
    return each.where("in_body").drop("in_body", "found")


def elements(parsed: DataFrame) -> DataFrame:
    """page_id, url, el_ord, tag, attrs, text_content, subtree_end, values, scopes."""
    return parsed.select("page_id", "url", F.explode("elements").alias("e")).select("page_id", "url", "e.*")
