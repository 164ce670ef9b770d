"""Words and their 64-bit hashes, for whole batches of texts at once in numpy.

A word is a maximal run of bytes other than the six ASCII white-space bytes,
or, as a term, of ASCII letters and digits and non-ASCII bytes, after A-Z are
lower-cased.  A word's hash is a polynomial over random values
of its bytes, finished by a mixer; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The bytes that part terms: ASCII other than letters and digits.
TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**64, 64, np.uint64) | np.uint64(1)
#: Bytes of text that are handled at once.
CHUNK = 250_000


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    hashes: np.ndarray  # of all words, text by text
    first: np.ndarray  # for each text, the index of its first word; one more at the end
    starts: np.ndarray  # byte offsets in ``text``
    ends: np.ndarray
    text: bytes
    offsets: np.ndarray  # for each text, its first byte in ``text``

    def prefixes(self, n: int) -> np.ndarray:
        """A hash of the first ``n`` bytes of each word, of fewer where the word is shorter."""
        raw = np.frombuffer(self.text, np.uint8)
        total = np.zeros(len(self.starts), np.uint64)
        power = np.cumprod(np.full(n, _BASE))
        for k in range(n):
            at = self.starts + k
            total += np.where(at < self.ends, _VALUE[_LOWER[raw[np.minimum(at, len(raw) - 1)]]] * power[k], np.uint64(0))
        return total


def words_of(texts: list[str | None], apart: np.ndarray = _SPACE) -> Words:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts) + b"\n"
    size = np.array([len(p) + 1 for p in parts], np.int64)
    offsets = np.cumsum(size) - size
    raw = np.frombuffer(joined, np.uint8)
    space = apart[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a space
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), starts, ends, joined, offsets)
    length = ends - starts
    inside = np.flatnonzero(~space)
    at = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    power = np.cumprod(np.full(int(length.max()) + 1, _BASE))
    hashes = mixed(np.add.reduceat(_VALUE[_LOWER[raw[inside]]] * power[at], np.cumsum(length) - length))
    return Words(hashes, np.searchsorted(starts, np.append(offsets, len(joined))), starts, ends, joined, offsets)


def windows(hashes: np.ndarray, picked: list[int], span: int) -> np.ndarray:
    """Hash of the words at ``picked`` places of every window of ``span`` words."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, p in enumerate(picked):
        total += hashes[p : p + n] * _STEP[k]
    return mixed(total)


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters; a longer text is alone."""
    low = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > size:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(texts):
        yield low, len(texts)
