"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Tokens are maximal runs of ASCII letters and digits and of all other non-ASCII
characters, A-Z lower-cased.  Each has a few hashed features: the whole token,
and its first bytes (so that an inflected word is known by its stem).  The
chain has two tags, clean and toxic; forward-backward gives each token's
marginal, and the weight of all taggings against the one without a toxic token
gives the odds that a document holds any.  That, the expected number of toxic
tokens and the document's length go through a logistic function fitted to the
documents' labels, which gives the score; offending spans are runs of tokens
whose marginal is at least ``MIN_MARGINAL``, with offsets in code points.

Labelled tokens come from labelled documents: a token of a toxic document is
toxic if one of its features is far more frequent in toxic documents than in
clean ones.  Equal features between equal neighbours count once, so groups of
copies count as one.  The field is then trained by its exact likelihood.

The sample that it learns from: of each label, rows by a hash of the doc_id so
that about ``TRAIN_CHARS`` characters, and at most ``TRAIN_ROWS`` rows, are expected
(all, if there are fewer), none of more than ``LONGEST`` characters.  Whole texts of all rows are scored,
a very long one in slices of ``SLICE`` characters, each a chain of its own whose
sums are added up, so it needs little more memory than a short one.

Defined cases: null, empty and token-free texts get the score of a document
without a token and no spans; where not both labels occur, every score is 0.
Rows with a null label or doc_id are never learned from; rows of ``labels``
that contradict each other are learned from as they are.  Repeated rows are
scored one by one.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import broadcast_if_small, map_batches, table
from .words import TERM, Words, chunks, mixed, words_of

#: Weights are 2 ** BITS.
BITS = 18
#: Bytes of a token's beginning that are features, where the token is longer.
PREFIXES = (4, 5, 6, 8)
#: Characters of the sample for label 0 and for label 1, its rows of each, and the characters of its longest document.
TRAIN_CHARS, TRAIN_ROWS, LONGEST = (12_000_000, 6_000_000), 40_000, 50_000
FOLDS = 3
#: A feature marks tokens as toxic from this many distinct contexts, this ratio of frequencies and this likelihood-ratio statistic on.
LEAST_SEEN, LEAST_LIFT, LEAST_GAIN = 4, 8.0, 20.0
EPOCHS, RATE, SHRINK = 4, 0.5, 1e-6
MIN_MARGINAL = 0.5
THRESHOLD = 0.7
#: Tokens that step together in the chain's recursion, and code points of a slice of one long text.
STRIDE, SLICE = 64, 1_000_000


def features(words: Words) -> np.ndarray:
    """Tokens x (1 + prefixes): columns of the weights; the token's own where it is too short for a prefix."""
    mask = np.uint64((1 << BITS) - 1)
    out = np.empty((len(words.hashes), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = words.hashes & mask
    length = words.ends - words.starts
    for k, n in enumerate(PREFIXES, 1):
        head = mixed(words.prefixes(n) + np.uint64(n))
        out[:, k] = np.where(length > n, head & mask, out[:, 0])
    return out


@dataclass
class Chain:
    """Weights of features and of the four transitions; the clean tag's weights are 0."""

    weights: np.ndarray
    bias: float
    step: np.ndarray  # log-weights: clean to toxic, toxic to clean, toxic to toxic; clean to clean is 0

    def emissions(self, f: np.ndarray) -> np.ndarray:
        return self.weights[f].sum(axis=1, dtype=np.float64) + self.bias

    def marginals(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: P(toxic), P(this and the next one toxic), and the log of its share of Z.

        e: emissions; first: whether a token begins a text.  Texts follow one
        another as one chain whose step into a first token forgets what was
        before.  Blocks of the chain are multiplied up side by side, their
        products are folded, and the blocks are gone through once more.
        """
        n = len(e)
        rows = -(-n // STRIDE)
        size = rows * STRIDE
        toxic = np.exp(np.clip(np.concatenate((e, np.zeros(size - n))), -30, 30)).reshape(rows, STRIDE)
        forget = np.concatenate((first, np.ones(size - n, bool))).reshape(rows, STRIDE)
        ct, tc, tt = np.exp(self.step)
        # The step into token t: [[1, ct * x], [tc, tt * x]]; into a first token both rows are [1, ct * x].
        a = np.ones((rows, STRIDE))
        b = ct * toxic
        c = np.where(forget, 1.0, tc)
        d = np.where(forget, ct * toxic, tt * toxic)
        # Forward: products of each block, then the vector that enters each, then every place.
        p = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
        for t in range(STRIDE):
            p = _times(p, (a[:, t], b[:, t], c[:, t], d[:, t]))
        enter = np.empty((rows, 2))
        x, y = 1.0, 0.0
        for k in range(rows):
            enter[k] = x, y
            x, y = x * p[0][k] + y * p[2][k], x * p[1][k] + y * p[3][k]
            x, y = x / (x + y), y / (x + y)
        alpha, share = np.empty((rows, STRIDE)), np.empty((rows, STRIDE))
        x, y = enter[:, 0], enter[:, 1]
        for t in range(STRIDE):
            x, y = x * a[:, t] + y * c[:, t], x * b[:, t] + y * d[:, t]
            total = x + y
            x, y = x / total, y / total
            alpha[:, t], share[:, t] = y, total
        # Backward, from the other end.
        leave = np.empty((rows, 2))
        x, y = 0.5, 0.5
        for k in range(rows - 1, -1, -1):
            leave[k] = x, y
            x, y = p[0][k] * x + p[1][k] * y, p[2][k] * x + p[3][k] * y
            x, y = x / (x + y), y / (x + y)
        beta = np.empty((rows, STRIDE))
        x, y = leave[:, 0], leave[:, 1]
        for t in range(STRIDE - 1, -1, -1):
            beta[:, t] = y / (x + y)
            x, y = a[:, t] * x + b[:, t] * y, c[:, t] * x + d[:, t] * y
            total = x + y
            x, y = x / total, y / total
        alpha, beta, share = alpha.ravel()[:n], beta.ravel()[:n], share.ravel()[:n]
        p = alpha * beta / (alpha * beta + (1 - alpha) * (1 - beta))
        # Pairs: what comes before a token and what follows it, through each of the four steps.
        into = np.exp(np.clip(e, -30, 30))
        last = np.concatenate((alpha, [0.0]))[:-1][np.maximum(np.arange(n) - 1, 0)] if n else alpha
        w = (1 - last) * (1 - beta), (1 - last) * ct * into * beta, last * tc * (1 - beta), last * tt * into * beta
        pair = np.stack([w[1], w[2], w[3]], axis=1) / (w[0] + w[1] + w[2] + w[3])[:, None]
        pair[first] = 0.0  # a text begins as if a clean token came before
        pair[first, 0] = p[first]
        return p, pair, np.log(share)


def _times(p: list, m: tuple) -> list:
    a, b, c, d = p[0] * m[0] + p[1] * m[2], p[0] * m[1] + p[1] * m[3], p[2] * m[0] + p[3] * m[2], p[2] * m[1] + p[3] * m[3]
    total = a + b + c + d
    return [a / total, b / total, c / total, d / total]


@dataclass
class Model:
    chain: Chain | None
    fit: np.ndarray  # of the logistic function: constant, log-odds of any toxic token, expected tokens, length

    def score(self, texts: list[str | None], spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Scores, and the toxic spans (start, end, marginal) if asked for."""
        sums, found = np.zeros((len(texts), 3)), [[] for _ in texts]
        if self.chain is None:
            return np.zeros(len(texts)), found
        for lo, hi in chunks(texts):
            if hi - lo == 1 and len(texts[lo] or "") > SLICE:
                for at, part in _slices(texts[lo]):
                    some, own = self._sums([part], spans)
                    sums[lo] += some[0]
                    found[lo] += [(s + at, e + at, p) for s, e, p in own[0]]
            else:
                sums[lo:hi], found[lo:hi] = self._sums(texts[lo:hi], spans)
        return _logistic(_inputs(sums) @ self.fit), found

    def _sums(self, texts: list[str | None], spans: bool) -> tuple[np.ndarray, list]:
        words = words_of(texts, TERM)
        n, found = np.diff(words.first), [[] for _ in texts]
        of = np.repeat(np.arange(len(texts)), n)
        first = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        p, _, share = self.chain.marginals(self.chain.emissions(features(words)), first)
        sums = np.stack([np.bincount(of, v, len(texts)) for v in (share, p, np.ones(len(of)))], axis=1)
        if spans:
            hot = np.flatnonzero(p >= MIN_MARGINAL)
            runs = np.flatnonzero(np.concatenate(([True], (np.diff(hot) > 1) | (of[hot[1:]] != of[hot[:-1]])))) if len(hot) else hot
            for begin, end in zip(runs, np.append(runs, len(hot))[1:], strict=True):
                i, j = hot[begin], hot[end - 1]
                base = int(words.offsets[of[i]])
                before = len(words.text[base : words.starts[i]].decode("utf-8", "replace"))
                inside = len(words.text[words.starts[i] : words.ends[j]].decode("utf-8", "replace"))
                found[of[i]].append((before, before + inside, float(p[i : j + 1].max())))
        return sums, found


def _slices(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of a long text that end behind a token, and where they begin."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and (text[end].isascii() is False or text[end].isalnum()):
            end += 1
        yield at, text[at:end]
        at = end


def _inputs(sums: np.ndarray) -> np.ndarray:
    """share of Z, expected toxic tokens and tokens of each text: columns of the logistic function."""
    odds = np.log(np.expm1(np.clip(sums[:, 0], 1e-9, 500)))
    return np.stack([np.ones(len(sums)), np.clip(odds, -12, 12), np.log1p(sums[:, 1]), np.log1p(sums[:, 2]) / 4], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and features of all tokens, and each text's number of tokens."""
    parts = [(w.hashes, features(w), np.diff(w.first)) for lo, hi in chunks(texts) for w in [words_of(texts[lo:hi], TERM)]]
    hashes, f, n = zip(*parts, strict=True)
    return np.concatenate(hashes), np.concatenate(f), np.concatenate(n)


def _tags(f: np.ndarray, hashes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of tokens: those of toxic documents with a feature that marks them."""
    before = np.concatenate(([np.uint64(0)], hashes[:-1]))
    after = np.concatenate((hashes[1:], [np.uint64(0)]))
    context = mixed(before * np.uint64(3) + mixed(after)) >> np.uint64(BITS)
    marks = np.zeros(1 << BITS, bool)
    of_toxic = np.bincount(f[toxic].ravel(), minlength=1 << BITS)
    for k in range(f.shape[1]):
        maybe = of_toxic[f[:, k]] >= LEAST_SEEN
        seen, total = [], []
        for label in (True, False):
            mine = maybe & (toxic == label)
            once = np.unique((context[mine] << np.uint64(BITS)) | f[mine, k].astype(np.uint64))
            seen.append(np.bincount((once & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS))
            total.append(max(1, int((toxic == label).sum())))
        a, b = seen[0] + 0.5, seen[1] + 0.5
        expected = (a + b) * total[0] / (total[0] + total[1])  # in toxic documents, if labels made no difference
        gain = 2 * (a * np.log(a / expected) + b * np.log(b / (a + b - expected)))
        marks |= (seen[0] >= LEAST_SEEN) & (a / total[0] >= LEAST_LIFT * b / total[1]) & (gain >= LEAST_GAIN)
    return toxic & marks[f].any(axis=1)


def fit(texts: list[str], labels: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of labelled texts (0 and 1); a text of each label stands for so many of the whole."""
    label = np.array(labels, bool)
    if label.all() or not label.any():
        return Model(None, np.zeros(4))
    hashes, f, n = _tokens(texts)
    begins_at = np.concatenate(([0], np.cumsum(n)))
    of = np.repeat(np.arange(len(texts)), n)
    first = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
    tag = _tags(f, hashes, label[of])
    share = max(1e-6, float(tag.mean())) if len(tag) else 1e-6
    chain = Chain(np.zeros(1 << BITS), float(np.log(share)), np.zeros(3))
    squares, bias_squares, step_squares = np.full(1 << BITS, 1e-2), 1.0, np.ones(3)
    order = np.random.default_rng(7).permutation(len(texts))
    batches = list(_batches(order, n))
    for _ in range(EPOCHS):
        for docs in batches:
            at = np.concatenate([np.arange(begins_at[i], begins_at[i + 1]) for i in docs])
            if not len(at):
                continue
            own, y, begins = f[at], tag[at], first[at]
            p, pair, _ = chain.marginals(chain.emissions(own), begins)
            miss = y - p
            g = np.zeros(1 << BITS)
            for k in range(own.shape[1]):
                g += np.bincount(own[:, k], miss, 1 << BITS)
            last = np.concatenate(([False], y[:-1])) & ~begins
            real = np.stack([~last & y, last & ~y, last & y], axis=1)
            gs = (real - pair).sum(axis=0)
            squares += g * g
            chain.weights += RATE * g / np.sqrt(squares) - SHRINK * chain.weights
            bias_squares += miss.sum() ** 2
            chain.bias += RATE * miss.sum() / np.sqrt(bias_squares)
            step_squares += gs**2
            chain.step = np.clip(chain.step + RATE * gs / np.sqrt(step_squares), -6, 6)
    chain.weights = chain.weights.astype(np.float32)
    model = Model(chain, np.zeros(4))
    sums = np.concatenate([model._sums(texts[lo:hi], False)[0] for lo, hi in chunks(texts)])
    model.fit = _calibrated(_inputs(sums), label, np.where(label, stands_for[1], stands_for[0]))
    return model


def _batches(order: np.ndarray, n: np.ndarray, tokens: int = 20_000) -> Iterator[np.ndarray]:
    low = held = 0
    for k, i in enumerate(order):
        held += n[i]
        if held >= tokens:
            yield order[low : k + 1]
            low, held = k + 1, 0
    if low < len(order):
        yield order[low:]


def _calibrated(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic regression of weighted rows by Newton steps that never raise the loss; a little ridge on all but the constant."""
    w, ridge = np.zeros(x.shape[1]), np.array([1e-3, 1.0, 1.0, 1.0])
    sign = np.where(label, -1.0, 1.0)
    loss = lambda v: float((weight * np.logaddexp(0, sign * (x @ v))).sum() + (ridge * v * v).sum() / 2)
    least = loss(w)
    for _ in range(40):
        p = _logistic(x @ w)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (weight * (label - p)) - ridge * w)
        while (now := loss(w + step)) > least and np.abs(step).max() > 1e-9:
            step = step / 2
        if now > least - 1e-9 * abs(least):
            break
        w, least = w + step, now
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows to learn from."""
    return labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))


def train(docs: DataFrame, labels: DataFrame, chars: tuple[int, int] = TRAIN_CHARS, rows: int = TRAIN_ROWS, longest: int = LONGEST) -> Model:
    """A model of the labelled documents.  labels: doc_id, toxic.

    The sample is bounded by ``chars`` of label 0 and 1 and by ``rows`` of each,
    in expectation.  Only ids and lengths of the documents meet all labels; the
    texts of the sample alone are fetched.
    """
    sizes = docs.where("doc_id is not null").select("doc_id", F.length("text").alias("n")).where(F.col("n") <= longest)
    known = sizes.join(labels, "doc_id")
    total = {r["toxic"]: (r["rows"], r["chars"]) for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars")).collect()}  # two rows
    if len(total) < 2:
        return Model(None, np.zeros(4))
    rates = [min(1.0, chars[t] / max(1, total[t][1]), rows / total[t][0]) for t in (0, 1)]
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    wanted = labels.where(place < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])).distinct()
    wanted = wanted.join(sizes.select("doc_id").where(place < max(rates)), "doc_id", "left_semi")
    own = docs.where(place < max(rates)).select("doc_id", "text").where(F.length("text") <= longest)
    sample = own.join(broadcast_if_small(wanted), "doc_id").toPandas().sort_values(["doc_id", "text", "toxic"])  # about ``chars``
    return fit(sample["text"].tolist(), sample["toxic"].tolist(), (1 / rates[0], 1 / rates[1]))


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], spans: bool = True) -> DataFrame:
    """The columns ``keep`` of docs, score, and spans (start, end in code points, marginal) if wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = sent.value.score(batch.column("_text").to_pylist(), spans)
            said = [pa.array(scores, pa.float64())]
            if spans:
                said.append(pa.array([[{"start": s, "end": e, "marginal": p} for s, e, p in x] for x in found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *said], names=names)

    rows = docs.select(*keep, F.col("text").alias("_text"))
    added = StructType.fromDDL("score double" + (", spans array<struct<start:long,end:long,marginal:double>>" if spans else ""))
    shape = StructType([*rows.drop("_text").schema, *added])
    names = shape.fieldNames()
    return map_batches(rows, score, shape)


def op13_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    out = score_toxicity(docs, model, ["doc_id"])
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), said.alias("spans"))
