"""Keywords in texts by one Aho-Corasick automaton for all of them.

``places`` gives every occurrence of every keyword that isn't part of a longer
word.  The same automaton, over strings that a match must hold, tells the scan
where matches may begin, so that expressions run at those few places only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from re import Match, Pattern
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.splits import bounded, spread

WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
#: A literal of fewer characters says too little to look for.
SHORTEST = 2
#: Characters of a match before such a literal, at most, if its places are to tell where matches begin.
BEFORE = 64


def automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, value)
    out.make_automaton()
    return out


def places(df: DataFrame, keys: list[str], keywords: list[str], text: str = "text") -> DataFrame:
    """keys, keyword, start, end of all occurrences, also overlapping ones; null texts have none.

    Case matters, and neither neighbour may be an ASCII letter, digit or underscore.
    """
    own = sorted({k for k in keywords if k})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton({k: k for k in own}) if own else None
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column("_text").to_pylist() if known else []):
                for last, word in known.iter(t or ""):
                    start, end = last + 1 - len(word), last + 1
                    if not (start and t[start - 1] in WORD or end < len(t) and t[end] in WORD):
                        rows.append(i)
                        found.append((word, start, end))
            held = batch.select(keys).take(pa.array(rows, pa.int64()))
            cols = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*held.columns, *cols], names=[*keys, "keyword", "start", "end"])

    rows = bounded(spread(df.select(*keys, F.col(text).alias("_text"))))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema), "keyword string, start int, end int"])
    return rows.mapInArrow(look, shape)


class Needed(NamedTuple):
    """Strings of which every match of an expression holds at least one, and how many characters of the match may be before it."""

    words: frozenset[str]
    low: int
    high: int

    @property
    def worth(self) -> tuple[bool, int]:
        shortest = min(map(len, self.words), default=0)
        return shortest >= SHORTEST and self.high <= BEFORE, shortest


def needed(regex: str, ignore_case: bool = False) -> Needed | None:
    """What every match of an expression holds (in lower case for ``ignore_case``); None if there is nothing of use."""
    tree = parser.parse(regex)
    found = _of_sequence(list(tree), tree.state)
    if found is None or min(map(len, found.words), default=0) < SHORTEST:
        return None
    return found._replace(words=frozenset(x.lower() for x in found.words)) if ignore_case else found


def required(regex: str, ignore_case: bool = False) -> frozenset[str] | None:
    """Strings of which every match of an expression holds at least one; None if there are no such."""
    found = needed(regex, ignore_case)
    return None if found is None else found.words


def _of_sequence(items: list, state: parser.State) -> Needed | None:
    """The best of what the parts in a row need: their literals in a row are one string."""
    best, run, low, high = None, "", 0, 0
    for item in [*items, (None, None)]:
        code, arg = item
        if code is op.LITERAL:
            run += chr(arg)
            continue
        best = _better(best, Needed(frozenset([run]), low, high) if run else None)
        low, high, run = low + len(run), high + len(run), ""
        own = None
        if code is op.BRANCH:
            parts = [_of_sequence(list(p), state) for p in arg[1]]
            own = None if any(p is None for p in parts) else Needed(frozenset().union(*(p.words for p in parts)), min(p.low for p in parts), max(p.high for p in parts))
        elif code is op.SUBPATTERN and not (arg[1] or arg[2]):  # a part with flags of its own may ignore case
            own = _of_sequence(list(arg[3]), state)
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            own = _of_sequence(list(arg[2]), state)
        best = _better(best, own and Needed(own.words, low + own.low, high + own.high))
        if code is not None:
            least, most = parser.SubPattern(state, [item]).getwidth()
            low, high = low + least, high + most
    return best


def _better(a: Needed | None, b: Needed | None) -> Needed | None:
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda n: n.worth)


@cache
def _gate(patterns: tuple[tuple[str, bool], ...]) -> tuple:
    """Automata over the texts as they are and in lower case, and the patterns that always run; values are bit masks of patterns."""
    exact: dict[str, int] = {}
    lower: dict[str, int] = {}
    always = 0
    for k, (regex, ignore_case) in enumerate(patterns):
        words = required(regex, ignore_case)
        if words is None:
            always |= 1 << k
        for w in words or ():
            own = lower if ignore_case else exact
            own[w] = own.get(w, 0) | 1 << k
    return (automaton(exact) if exact else None), (automaton(lower) if lower else None), always


def possible(text: str, patterns: tuple[tuple[str, bool], ...]) -> int:
    """A bit mask of the (expression, ignores case) pairs that may match in the text."""
    exact, lower, out = _gate(patterns)
    for known, t in ((exact, text), (lower, text.lower())):
        if known is not None:
            for _, mask in known.iter(t):
                out |= mask
    return out


@cache
def _anchors(patterns: tuple[tuple[str, bool], ...]) -> tuple:
    """Automata over the texts as they are and in lower case; values are a word's length and, for each pattern with it, how far before it a match may begin."""
    own: tuple[dict, dict] = {}, {}
    for k, (regex, ignore_case) in enumerate(patterns):
        found = needed(regex, ignore_case)
        for w in found.words if found and found.worth[0] else ():
            own[ignore_case].setdefault(w, (len(w), []))[1].append((k, found.low, found.high))
    anchored = {k for words in own for _, each in words.values() for k, _, _ in each}
    return *(automaton(words) if words else None for words in own), anchored


def spots(text: str, patterns: tuple[tuple[str, bool], ...]) -> dict[int, list[tuple[int, int]]] | None:
    """Where matches of the (expression, ignores case) pairs may begin: for each pair's number, ranges of places, both ends inclusive.

    A pair that isn't named has no match, unless its expression says too little
    of where its matches begin: then its list is empty.  None for the few texts
    whose lower case has other places.
    """
    exact, lower, anchored = _anchors(patterns)
    lowered = text.lower() if lower is not None else text
    if len(lowered) != len(text):
        return None
    out: dict[int, list[tuple[int, int]]] = {k: [] for k in range(len(patterns)) if k not in anchored}
    for known, t in ((exact, text), (lower, lowered)):
        if known is not None:
            for last, (length, each) in known.iter(t):
                for k, low, high in each:
                    out.setdefault(k, []).append((last + 1 - length - high, last + 1 - length - low))
    return out


def matches(rx: Pattern, text: str, ranges: list[tuple[int, int]]) -> Iterator[Match]:
    """What ``rx.finditer(text)`` gives, if every match begins in one of the ranges and none is empty."""
    at = 0
    for low, high in sorted(ranges):
        at = max(at, low)
        while at <= high:
            m = rx.match(text, at)
            if m:
                yield m
            at = m.end() if m else at + 1
