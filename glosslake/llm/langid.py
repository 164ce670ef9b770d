"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text's letters are lower-cased, every run of other characters becomes one
space, and n-grams of one to three characters are hashed into columns: 32,768
of them, or as many fewer (a power of two) as keep languages x columns within
``MATRIX`` values, so that what is broadcast has a bound.  Counts are summed by Spark over a bounded sample of labelled rows;
the matrix of log-probabilities (languages x columns) is broadcast, and whole
texts are scored batch by batch in numpy: the non-zero features only, very long
texts in slices of ``SLICE`` characters whose log-probabilities are added.

The sample: of each language, every training row if there are at most
``DOCS_PER_LANG``, else rows by a hash of the doc_id so that about that many
are expected.

Defined cases: null text, or one without a letter, is ``und`` with score 0; so
is every text where no labelled row exists.  Rows with a null lang or doc_id
are never learned from.  Repeated rows are scored one by one.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table
from .words import chunks

#: Columns are 2 ** BITS; values of the matrix of log-probabilities (64 MB).
BITS, MATRIX = 15, 1 << 24
ALPHA = 0.1
DOCS_PER_LANG = 1500
FOLDS = 5
#: Log-probabilities that are looked up at once: bounds the memory for one long text too.
BLOCK = 1 << 21
#: Characters of a part of a very long text.
SLICE = 1_000_000
#: Counts that the driver takes from Spark at once.
FETCHED = 1 << 20
#: The pipeline keeps a document whose language has at least this probability.
MIN_SCORE = 0.5


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def columns_for(n_langs: int) -> int:
    """Bits of the column number: BITS, or fewer where the matrix would be too large."""
    return max(4, min(BITS, (MATRIX // max(1, n_langs)).bit_length() - 1))


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Columns of all n-grams (positions x orders, ``2 ** bits``: none) and each position's text."""
    lower = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in lower], np.int64)
    code = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    keep = letter | np.concatenate(([False], letter[:-1]))  # letters, and the first other character after one
    of = np.repeat(np.arange(len(texts)), size)[keep]
    c = np.concatenate((np.full(2, 32, np.uint32), np.where(letter, code, 32)[keep].astype(np.uint32)))
    shift = np.uint32(32 - bits)
    one, two = c[2:], c[1:-1] * np.uint32(0x01000193)
    h1 = one * np.uint32(0x9E3779B1)
    h2 = (one + two + np.uint32(1)) * np.uint32(0x85EBCA6B)
    h3 = (one + two + c[:-2] * np.uint32(0xC2B2AE35) + np.uint32(2)) * np.uint32(0x27D4EB2F)
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    out = np.stack([mix(h1), mix(h2), mix(h3)], axis=1).astype(np.int32)
    first = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
    out[first, 2] = 1 << bits  # this one would reach into the text before
    return out, of


def slices(text: str | None) -> list[str]:
    """A text's parts of ``SLICE`` characters; n-grams across a cut count as at a text's end."""
    text = text or ""
    return [text[at : at + SLICE] for at in range(0, len(text), SLICE)] or [""]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2 ** bits + 1) x languages; the last row is zero
    prior: np.ndarray

    def _totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of each text by language, without the prior, and whether it has a letter."""
        f, of = features(texts, (len(self.weights) - 1).bit_length() - 1)
        total = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)
        seen[of] = True
        block = max(1, BLOCK // max(1, len(self.langs)))
        for at in range(0, len(of), block):
            mine = of[at : at + block]
            cut = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            for order in range(3):
                w = self.weights[f[at : at + block, order]]
                total[mine[cut]] += np.add.reduceat(w, cut, axis=0, dtype=np.float64)
        return total, seen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and their probabilities; a very long text is summed up by slices."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        parts = [(i, p) for i, t in enumerate(texts) for p in slices(t)]
        total, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        for lo, hi in chunks([p for _, p in parts]):
            of = np.array([i for i, _ in parts[lo:hi]])
            some, letters = self._totals([p for _, p in parts[lo:hi]])
            np.add.at(total, of, some)
            np.logical_or.at(seen, of, letters)
        total += self.prior
        best = total.argmax(axis=1)
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if s else "und" for b, s in zip(best, seen, strict=True)], np.where(seen, p, 0.0)


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """labelled: doc_id, text, lang (no nulls in lang and doc_id)."""
    spark = labelled.sparkSession
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # a row for each language
    bits, langs = columns_for(len(sizes)), [r["lang"] for r in sizes]
    if not sizes:
        return Model([], np.zeros((2**bits + 1, 0), np.float32), np.zeros(0))
    rates = [(r["lang"], i, min(1.0, docs_per_lang / r["n"])) for i, r in enumerate(sizes)]
    rates = F.broadcast(spark.createDataFrame(rates, "lang string, lang_no int, rate double"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.join(rates, "lang").where(place < F.col("rate")).select("lang_no", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("lang_no").to_numpy()
            for lang in np.unique(of):
                texts = [p for t in batch.column("text").filter(pa.array(of == lang)).to_pylist() for p in slices(t)]
                for lo, hi in chunks(texts):
                    f, _ = features(texts[lo:hi], bits)
                    n = np.bincount(f.ravel(), minlength=2**bits + 1)[: 2**bits]
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang_no", "feature", "n"])

    each = map_batches(sample, count, "lang_no int, feature int, n long").groupBy("lang_no", "feature").agg(F.sum("n").alias("n"))
    each = materialize(each, "counts")
    weights = np.zeros((2**bits + 1, len(langs)), np.float32)
    step = max(1, FETCHED >> bits)  # languages at once
    for low in range(0, len(langs), step):
        rows = each.where(F.col("lang_no").between(low, low + step - 1)).toPandas()  # FETCHED at most
        n = np.zeros((2**bits, min(step, len(langs) - low)))
        n[rows["feature"], rows["lang_no"] - low] = rows["n"]
        weights[:-1, low : low + step] = np.log(n + ALPHA) - np.log((n + ALPHA).sum(axis=0))
    discard(each)
    share = np.array([r["n"] for r in sizes], float)
    return Model(langs, weights, np.log(share / share.sum()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text", "lang")
    return own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            langs, scores = own.predict(texts)
            said = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *said], names=names)

    rows = docs.select(*keep, F.col("text").alias("_text"))
    shape = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    names = shape.fieldNames()
    return map_batches(rows, score, shape)


def in_known_language(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is known with ``min_score``; decided in place.

    Without any labelled row, every text with a letter stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if own.langs:
                stays = [x != "und" and p >= min_score for x, p in zip(*own.predict(texts), strict=True)]
            else:
                stays = [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return map_batches(docs, keep, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(training_rows(docs)), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
