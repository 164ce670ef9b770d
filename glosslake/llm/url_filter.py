"""URL filters: glob rules in one bit-parallel automaton.

Every glob rule takes a run of bits, one for each of its states, packed over
as many 64-bit words as needed.  One step reads a byte of each canonical URL
(host and path) and moves all states of all rules at once: a shift (with the
carry between words) into the states that this byte reaches, and the states
that loop on it.  A batch of URLs steps together in numpy.

``*`` matches any bytes but ``/``; ``**`` matches any bytes.  A rule for a host
and path becomes two globs, ``host/path**`` and ``*.host/path**``.  The longest
rule that fits decides; without one, the method's own globs (spam hosts and
tracking paths) block, and the rest is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is allowed; very long urls are stepped to their end; repeated rows are
judged one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: (host/path, verdict); a rule fits its host and all subdomains and every path that starts with its path.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: The method's own verdict where no rule fits: hosts and paths that these globs match are blocked.
SPAM = ["*casino*/**", "*cheap-*/**", "*pills*/**", "*viagra*/**", "*poker*/**", "*porn*/**", "*xxx*/**", "ads.*/**", "*.ads.*/**", "*/wp-login**", "**/cgi-bin/**"]
#: URLs that step together.
BATCH = 8192


class GlobAutomaton:
    """Masks of a rule list: reach[byte] and loop[byte], a row of words each."""

    def __init__(self, globs: list[str]):
        reach, loop, start, accept, at = [0] * 256, [0] * 256, 0, [], 0
        for glob in globs:
            start |= 1 << at
            rest = glob.encode()
            while rest:
                if rest.startswith(b"*"):
                    any_byte = rest.startswith(b"**")
                    rest = rest[2 if any_byte else 1 :]
                    for b in range(256):
                        if any_byte or b != ord("/"):
                            loop[b] |= 1 << at
                else:
                    at += 1
                    reach[rest[0]] |= 1 << at
                    rest = rest[1:]
            accept.append(at)
            at += 1
        self.words = at // 64 + 1
        self.reach, self.loop = self._pack(reach), self._pack(loop)
        self.start = self._pack([start])[0]
        self.accept = np.array(accept)

    def _pack(self, masks: list[int]) -> np.ndarray:
        return np.array([[(m >> 64 * w) & (2**64 - 1) for w in range(self.words)] for m in masks], np.uint64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """For each text, which globs match it whole."""
        n = len(texts)
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")  # those that still have bytes are a prefix
        flat = np.frombuffer(b"".join(texts), np.uint8)
        first = (np.cumsum(length) - length)[order]
        state = np.tile(self.start, (n, 1))
        active = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        for step, k in enumerate(active):
            byte = flat[first[:k] + step]
            d = state[:k]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.reach[byte]) | (d & self.loop[byte])
        out = np.empty((n, len(self.accept)), bool)
        out[order] = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1) == 1
        return out


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise("")
    cut = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    return cut.select(
        "page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, spam: list[str] = SPAM) -> DataFrame:
    """page_id, host, path, rule (null without one), verdict."""
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    globs = [g for rule, _ in ranked for g in (f"{rule}**", f"*.{rule}**")] + spam

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        names = np.array([r for r, _ in ranked] + [None], object)
        verdicts = np.array([v for _, v in ranked], object)
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                part = whole.slice(at, BATCH)
                hit = automaton.matches([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)])
                ruled = hit[:, 0 : 2 * len(ranked) : 2] | hit[:, 1 : 2 * len(ranked) : 2]
                none = ~ruled.any(axis=1)
                which = np.where(none, len(ranked), ruled.argmax(axis=1))
                method = np.where(hit[:, 2 * len(ranked) :].any(axis=1), "block", "allow")
                said = np.where(none, method, np.append(verdicts, "")[which])
                cols = [*part.columns, pa.array(names[which].tolist(), pa.string()), pa.array(said.tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "rule", "verdict"])

    shape = f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string"
    return map_batches(split_url(pages), judge, shape)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'"
        for r, h, p in ((r, *r.split("/", 1)) for r, _ in sorted(RULES, key=lambda r: -len(r[0])))
    )
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    own = " OR ".join(f"regexp_full_match(host || path, '{_regex(g)}', 's')" for g in SPAM)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE
{fits}
    END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN CASE WHEN {own} THEN 'block' ELSE 'allow' END
  ELSE CASE rule {said} END END AS verdict FROM j
"""


def _regex(glob: str) -> str:
    any_byte, own = glob.split("**"), lambda s: "[^/]*".join(x.replace(".", "[.]") for x in s.split("*"))
    return ".*".join(map(own, any_byte))


OP3_SQL = _sql()
