"""Best-fit packing by bin completion.

Documents become token ids (each ends with id 0); longer ones are cut into
full pieces.  Only lengths matter for the packing, so Spark sums a histogram
(at most 2,048 counts, whatever the input) and the search runs on it: the
incumbent is best-fit decreasing; then bin completion takes the longest
remaining piece, enumerates all undominated fillings of the rest of its
sequence, those of least waste first, uses each filling as often as the counts
allow (then less often), and goes back where the waste so far shows that the incumbent can't be
beaten.  The search ends at the lower
bound or after ``MAX_NODES`` fillings; the best plan found is used.

A plan is a short table: a filling, and how often it is used.  Pieces are
ranked globally by (length, doc_id, piece); a piece's rank among its length
says which filling and which place it gets, by a join with the plan.

Defined cases: null text is empty: one piece, id 0 alone; very long texts are
tokenised whole; repeated rows are packed one by one; a null doc_id is packed
like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, map_batches, materialize, table
from .words import chunks

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Fillings that the search may open in all; beyond, the best plan found is used, and ``lower_bound`` tells how far off it can be.
MAX_NODES = 10_000
#: Words whose ids a worker remembers.
REMEMBERED = 300_000


class Encoder:
    """Ids of whole texts; words that were met before are not encoded again.

    The tokenizer's pre-tokens never hold white space, and its normaliser
    works inside of words, so a text's ids are its words' ids in a row.  A
    full stop or comma between letters, digits or white space is a pre-token of
    its own, and letters are lower-cased anyway, so both are done first: fewer
    different words are left.  Texts for which that might not hold take the
    plainer way: special tokens' strings, other marks beside a stop, and
    characters outside of ``_PLAIN``.  Those ranges hold no separator that is
    white space to Python only, no mark that composes with a letter before it,
    and no capital whose small letter depends on its place or is two characters
    (capital sigma, I with a dot).
    """

    _PLAIN = (
        r"\t-\r\x20-\u012f\u0131-\u024f\u0391-\u03a1\u03a4-\u03ce\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
        r"\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
    )
    #: ASCII marks but the apostrophe, which may begin a pre-token with letters behind it.
    _MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    _OTHER = re.compile(f"[^{_PLAIN}]")
    _BESIDE = re.compile(r"[.,](?:[^\w\s]|_|(?<=[^\w\s].)|(?<=_.))")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def _bytes(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are one pre-token, and marks behind them one more: encoded together, and parted where their last pre-token's last token is."""
        plain, other, count = [], [], []
        for w in words:
            if w.isalpha() or w.rstrip(self._MARKS).isalpha():
                plain.append(w)
                count.append(1 if w.isalpha() else 2)
            else:
                other.append(w)
        together = [" ".join(plain[k : k + 64]) for k in range(0, len(plain), 64)]
        parts = self.tokenizer.encode_batch_fast(together, add_special_tokens=False)
        ids = np.array([i for x in parts for i in x.ids], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == sum(count):
            raw, at = ids.tobytes(), [0, *(4 * ends[np.cumsum(count, dtype=np.int64) - 1]).tolist()]
            self.known.update((w, raw[a:b]) for w, a, b in zip(plain, at, at[1:], strict=False))
        else:
            other = words
        self.known.update(zip(other, map(self._bytes, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))

    def _words(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special) or self._OTHER.search(text):
            return None
        text = text.lower()
        if not self._BESIDE.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = [self._words(t) for t in texts]
        missing = set().union(*filter(None, words)).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = set().union(*filter(None, words))
        self._learn(list(missing))
        for text, own in zip(texts, words, strict=True):
            if own is None:
                yield self._bytes(self.tokenizer.encode(text, add_special_tokens=False))
            else:
                yield b"".join(itemgetter(*own)(self.known)) if len(own) > 1 else b"".join(map(self.known.__getitem__, own))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token pieces."""
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                for i, ids in enumerate(own.ids(texts[lo:hi]), lo):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            columns = [doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), cut, shape)


# The plan: (filling, times); a filling is a tuple of lengths, longest first.
Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best of the volume bound and Martello and Toth's L2 over all thresholds."""
    size = np.arange(len(counts))
    n = np.concatenate(([0], np.cumsum(counts)))  # n[x]: pieces shorter than x
    s = np.concatenate(([0], np.cumsum(counts * size)))
    best = -(-int(s[-1]) // capacity)
    half = capacity // 2
    for a in range(half + 1):
        big = n[-1] - n[capacity - a + 1]
        middle, filled = n[capacity - a + 1] - n[half + 1], s[capacity - a + 1] - s[half + 1]
        small = s[half + 1] - s[a]
        best = max(best, int(big + middle + max(0, -(-(small - (middle * capacity - filled)) // capacity))))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit on the histogram: equal sequences are handled together."""
    open_: dict[int, Counter] = {}  # room left -> fillings and how many sequences have them
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in open_ if r >= length):
            while left and open_.get(room):
                filling, times = open_[room].popitem()
                fits = min(room // length, -(-left // times))  # a sequence with the least room is filled on
                whole, rest = divmod(left, fits) if left < fits * times else (times, 0)
                if whole:
                    open_.setdefault(room - fits * length, Counter())[filling + (length,) * fits] += whole
                if rest:
                    open_.setdefault(room - rest * length, Counter())[filling + (length,) * rest] += 1
                if times - whole - bool(rest):
                    open_[room][filling] += times - whole - bool(rest)
                left -= whole * fits + rest
            if not left:
                break
        if left:
            fits = capacity // length
            whole, rest = divmod(left, fits)
            if whole:
                open_.setdefault(capacity - fits * length, Counter())[(length,) * fits] += whole
            if rest:
                open_.setdefault(capacity - rest * length, Counter())[(length,) * rest] += 1
    return [(f, n) for fillings in open_.values() for f, n in fillings.items() if n]


def dominated(filling: tuple[int, ...], waste: int, left: int) -> bool:
    """Whether a piece that is left over could take the place of some of the filling's, and hold them.

    left: bits of the lengths that are left over.  Such a piece is as long as
    the pieces together or longer, by no more than the waste; a piece that just
    fits in beside the others counts too.
    """
    one, more = 1, 0  # bits of the sums of none or one piece, and of two or more
    for x in filling:
        more |= (more << x) | ((one & ~1) << x)
        one |= 1 << x
    return any(((more << k) | (one << k if k else 0)) & left for k in range(waste + 1))


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of ``room``, least waste first, each made when it is asked for; None for a dominated one.

    Sums that the shorter lengths can reach are bits of a number for each
    length, so the search for a given sum never enters a dead end by its size.
    """
    own = {x: int(counts[x]) for x in range(min(room, len(counts) - 1), 0, -1) if counts[x]}
    there = list(own)
    if not there or there[0] == room:  # one piece that fills the room dominates everything else
        yield tuple(there[:1])
        return
    full, reach = (1 << room + 1) - 1, [1] * (len(there) + 1)
    for i in range(len(there) - 1, -1, -1):
        x, sums = there[i], reach[i + 1]
        copies, step = min(own[x], room // x), 1
        while copies > 0:
            sums |= (sums << min(step, copies) * x) & full
            copies, step = copies - step, 2 * step
        reach[i] = sums

    def made(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for j in range(i, len(there)):
            if not reach[j] >> total & 1:
                return
            x = there[j]
            for k in range(min(own[x], total // x), 0, -1):
                if reach[j + 1] >> total - k * x & 1:
                    for rest in made(j + 1, total - k * x):
                        yield (x,) * k + rest

    for waste in range(room + 1):
        if reach[0] >> room - waste & 1:
            for filling in made(0, room - waste):
                used = Counter(filling)
                left = sum(1 << x for x in there if own[x] > used[x])
                yield None if dominated(filling, waste, left) else filling


class _Level:
    """A depth of the search: the longest piece, and the fillings around it that are still to be tried.

    Only the deepest levels keep their sums; one further up makes them again
    when the search comes back to it, and skips what it has tried.
    """

    KEPT = 64

    def __init__(self, longest: int, room: int):
        self.longest, self.room, self.tried, self.options = longest, room, 0, None
        self.filling, self.times = (), 0

    def next(self, counts: np.ndarray) -> tuple[tuple[int, ...], int] | None | bool:
        """A filling with the longest piece and how often to use it, None for a dominated one, False if there are no more.

        Each is used as often as the counts allow first, then once less, and so on.
        """
        if self.times > 1:
            self.times -= 1
            return self.filling, self.times
        if self.options is None:
            counts[self.longest] -= 1
            self.options = fillings(counts, self.room)
            option = next(islice(self.options, self.tried, None), False)
            counts[self.longest] += 1
        else:
            option = next(self.options, False)
        self.tried += 1
        if option is None or option is False:
            return option
        self.filling = (self.longest, *option)
        self.times = min(int(counts[x]) // k for x, k in Counter(self.filling).items())
        return self.filling, self.times


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> Plan:
    """The best plan found for a histogram of lengths 1 to ``capacity``: an optimal one if fewer than ``max_nodes`` fillings were opened."""
    counts = counts.astype(np.int64).copy()
    best = best_fit_decreasing(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    volume = int((counts * np.arange(len(counts))).sum())
    plan: Plan = []
    stack: list[_Level] = []
    used = wasted = nodes = 0
    deeper = True
    while fewest > bound and nodes < max_nodes:
        if deeper:
            if not counts.any():
                if used < fewest:
                    best, fewest = list(plan), used
                deeper = False
            elif used + -(-(volume - used * capacity + wasted) // capacity) < fewest:  # sequences that the rest needs at least
                longest = int(np.flatnonzero(counts)[-1])
                stack.append(_Level(longest, capacity - longest))
                if len(stack) > _Level.KEPT:
                    stack[-1 - _Level.KEPT].options = None
            else:
                deeper = False
        if not deeper:  # back to the last depth that may have an untried filling
            if not stack:
                break
            if len(plan) == len(stack):
                filling, times = plan.pop()
                for x in filling:
                    counts[x] += times
                used, wasted = used - times, wasted - times * (capacity - sum(filling))
        option = stack[-1].next(counts)
        nodes += 1
        if option is False:
            stack.pop()
            deeper = False
        elif option is None:
            deeper = False
        else:
            filling, times = option
            for x in filling:
                counts[x] -= times
            plan.append(option)
            used, wasted = used + times, wasted + times * (capacity - sum(filling))
            deeper = True
    return best


def plan_rows(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """length, low and high rank among its length, first sequence, sequences, offset of its first copy."""
    rows, taken, first = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for length, copies in sorted(Counter(filling).items(), reverse=True):
            rows.append((length, taken[length], taken[length] + times * copies, first, times, offset))
            taken[length] += times * copies
            offset += length * copies
        first += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, vocabulary), "pieces")  # else the ranges' sampling tokenises once more
    ranked, _ = global_rank(cut, ["length", "doc_id", "piece", "ids_crc32"], "ranked")
    histogram = ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    before = (np.cumsum(counts) - counts).tolist()
    full: Plan = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    rows = plan_rows(full + bin_completion(counts, capacity, max_nodes))
    shape = "length long, _low long, _high long, _first long, _times long, _offset long, _before long"
    plan = spark.createDataFrame([(*r, before[r[0]]) for r in rows], shape)  # bounded by the plan, not by the input
    place = F.col("rank") - F.col("_before")
    own = place - F.col("_low")
    return ranked.join(F.broadcast(plan), "length").where((place >= F.col("_low")) & (place < F.col("_high"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + own % F.col("_times")).alias("sequence_id"),
        (F.col("_offset") + F.floor(own / F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
