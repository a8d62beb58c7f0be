"""Toxic spans and document scores from a linear-chain CRF (operator 9).

Tokens are runs of ASCII letters and digits (A-Z lowered) and of non-ASCII
characters. The chain has two states, outside (0) and toxic (1). A token's
emission is a sum of learned weights over hashed features of its bytes: all
byte 3-, 4- and 5-grams of the word with both ends marked, and the whole word.
Forward-backward marginals give every token's probability of state 1; a
document's score is its largest marginal, calibrated on the training labels,
and its offending offsets are the runs of tokens above one half.

Labels are per document, so token labels for the fit come from them: in a
toxic training document, the tokens with a feature that toxic documents hold
significantly and far more often than clean ones. The fit uses a bounded sample
(about ``per_class`` documents of each label) and runs in one task; everything
else covers all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, Words, kept_rows, max_by, ragged, sums_by, text_slices
from .samples import bounded_sample, held_out

FEATURE_BITS = 22
GRAMS = (3, 4, 5)
PER_CLASS = 1200
CHUNK = 256
#: Text that a task scores at once.
SLICE_BYTES = 2 << 20
STEPS = 15
#: Share of wrongly chosen features that the choice of seeds admits, and how much likelier they must be in toxic documents.
FALSE_SHARE, SEED_RATIO = 0.01, 20.0
THRESHOLD = 0.3
MIX = np.uint64(0x9E3779B97F4A7C15)
#: bias, kernel (row by row), slope and intercept of the calibration: every token is outside
NO_MODEL = np.array([-30.0, 1.0, 1e-9, 1.0, 1e-9, 1.0, 0.0])
#: strength of the pull of the calibration to slope 1 and intercept 0
PRIOR = np.array([1.0, 0.02])
MODEL = "places binary, weights binary, extra binary"


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, bounds) of the distinct words."""
    flat, offsets = words.buffers()
    n, lengths = len(offsets) - 1, np.diff(offsets)
    flat = flat[:offsets[-1]] if n else flat[:0]
    # a 0 before, between and after the words marks their ends
    marked = np.concatenate([[0], np.insert(flat, offsets[1:], 0)]).astype(np.uint64)
    starts = offsets[:-1] + np.arange(n)
    h, ids, counts = marked, [], []
    for size in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(1099511628211) + marked[size - 1:] + np.uint64(1)
        if size in GRAMS:
            counts.append(np.maximum(lengths + 3 - size, 0))
            ids.append((ragged(h, starts, counts[-1]) + np.uint64(size)) * MIX)
    ids.append((words.hashes() + np.uint64(1)) * MIX)
    counts.append(np.ones(n, np.int64))
    owner = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
    order = np.argsort(owner, kind="stable")
    features = (np.concatenate(ids)[order] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return features, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def _lockstep(lengths: np.ndarray):
    """(order, active): chunks by descending length, and how many still run at each step."""
    order = np.argsort(-lengths, kind="stable")
    down = lengths[order]
    return order, [int(k) for k in np.searchsorted(-down, -np.arange(int(down[0]) if len(down) else 0), side="left")]


def forward_backward(emission: np.ndarray, first: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward, backward) share of state 1 at every token, documents given by ``first``.

    ``kernel[i, j]`` is the weight of going from state i to j; a document
    starts from state 0. Documents are cut into chunks of ``CHUNK`` tokens:
    chunks' 2x2 products are made in lockstep, chained per document, and the
    passes then run inside all chunks at once. The result is that of one pass
    over every document, in about ``CHUNK`` vector steps.
    """
    w = np.exp(np.clip(emission, -30, 30))
    length = np.diff(first)
    n_chunks = -(-length // CHUNK)
    total = int(n_chunks.sum())
    forward, backward = np.zeros(len(emission)), np.zeros(len(emission))
    if not total:
        return forward, backward
    doc_first = np.cumsum(n_chunks) - n_chunks
    ordinal = np.arange(total) - np.repeat(doc_first, n_chunks)
    start = np.repeat(first[:-1], n_chunks) + ordinal * CHUNK
    size = np.minimum(CHUNK, np.repeat(first[1:], n_chunks) - start)
    order, active = _lockstep(size)
    at, m = start[order], np.tile(np.array([[1.0], [0.0], [0.0], [1.0]]), (1, total))
    (k00, k01), (k10, k11) = kernel
    for t, n in enumerate(active):
        e, p = w[at[:n] + t], m[:, :n]
        a0, a1 = p[0] * k00 + p[1] * k10, (p[0] * k01 + p[1] * k11) * e
        b0, b1 = p[2] * k00 + p[3] * k10, (p[2] * k01 + p[3] * k11) * e
        scale = 1.0 / (a0 + a1 + b0 + b1)
        m[:, :n] = a0 * scale, a1 * scale, b0 * scale, b1 * scale
    product = np.empty_like(m)
    product[:, order] = m
    # chain the chunks of each document
    into, out = np.empty((2, total)), np.empty((2, total))
    longest = int(n_chunks.max())
    docs = np.flatnonzero(n_chunks)
    v = np.tile([[1.0], [0.0]], (1, len(n_chunks)))
    u = np.ones((2, len(n_chunks)))
    for k in range(longest):
        docs = docs[n_chunks[docs] > k]
        c = doc_first[docs] + k
        into[:, c] = v[:, docs]
        p, x = product[:, c], v[:, docs]
        y = np.stack([x[0] * p[0] + x[1] * p[2], x[0] * p[1] + x[1] * p[3]])
        v[:, docs] = y / y.sum(0)
    docs = np.flatnonzero(n_chunks)
    for k in range(longest):
        docs = docs[n_chunks[docs] > k]
        c = doc_first[docs] + n_chunks[docs] - 1 - k
        out[:, c] = u[:, docs]
        p, x = product[:, c], u[:, docs]
        y = np.stack([p[0] * x[0] + p[1] * x[1], p[2] * x[0] + p[3] * x[1]])
        u[:, docs] = y / y.sum(0)
    f, b, last = into[:, order].copy(), out[:, order].copy(), at + size[order] - 1
    for t, n in enumerate(active):
        e = w[at[:n] + t]
        a0, a1 = f[0, :n] * k00 + f[1, :n] * k10, (f[0, :n] * k01 + f[1, :n] * k11) * e
        share = a1 / (a0 + a1)
        f[0, :n], f[1, :n] = 1 - share, share
        forward[at[:n] + t] = share
        back = last[:n] - t
        share = b[1, :n] / (b[0, :n] + b[1, :n])
        backward[back] = share
        x0, x1 = 1 - share, share * w[back]
        y0, y1 = k00 * x0 + k01 * x1, k10 * x0 + k11 * x1
        s = 1.0 / (y0 + y1)
        b[0, :n], b[1, :n] = y0 * s, y1 * s
    return forward, backward


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    on, off = forward * backward, (1 - forward) * (1 - backward)
    return on / np.maximum(on + off, 1e-300)


def seed_features(in_toxic: np.ndarray, in_clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Features that only toxic words can explain, from the documents of each label that hold them.

    A feature of c documents that has nothing to do with the label falls into
    toxic ones with probability n1 / (n1 + n0) each, so its count there has a
    binomial tail. The tails of all features go through the Benjamini-Hochberg
    bound: the same test whatever the sample's size. The odds must be large too, as
    common words of one topic can be significant in a large sample.
    """
    total, share = in_toxic + in_clean, n1 / (n1 + n0)
    kinds, which = np.unique(np.stack([in_toxic, total]).astype(np.int64), axis=1, return_inverse=True)
    tail = np.ones(kinds.shape[1])
    for k, (hits, n) in enumerate(kinds.T.tolist()):
        if hits > n * share:
            tail[k] = _binomial_tail(hits, n, share)
    p = tail[which.ravel()]
    rank = np.searchsorted(np.sort(p), p, side="right")
    passing = p[p <= FALSE_SHARE * rank / max(1, len(p))]
    return (p <= (passing.max() if len(passing) else -1.0)) & (in_toxic / n1 >= SEED_RATIO * in_clean / n0)


def _binomial_tail(hits: int, n: int, share: float) -> float:
    """Probability of at least ``hits`` of ``n`` with probability ``share`` each."""
    k = np.arange(hits, n + 1)
    log = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in k.tolist()]) + k * np.log(share) + (n - k) * np.log1p(-share)
    return float(min(1.0, np.exp(log).sum()))


def fit(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, [bias, kernel...]) from whole texts and their labels (1: toxic)."""
    weights, extra = np.zeros(1 << FEATURE_BITS, np.float32), NO_MODEL.copy()
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    words = Words(LOWER[np.frombuffer(b"".join(raw), np.uint8)], offsets, ALNUM)
    if not len(words) or not (toxic == 1).any() or not (toxic == 0).any():
        return weights, extra  # nothing to tell apart: every marginal is 0
    hashed, bounds = word_features(words)
    doc = np.repeat(np.arange(len(raw)), np.diff(words.first))
    present, features = np.unique(hashed, return_inverse=True)  # only features that occur are fitted
    pairs = np.unique(np.stack([doc, words.codes]), axis=1)  # the distinct words of each document
    # copies of one text count once: documents with the same words stand for each other
    held = np.zeros(len(raw), np.uint64)
    np.add.at(held, pairs[0], (words.hashes()[pairs[1]] + np.uint64(1)) * MIX)
    _, keep = np.unique(np.stack([held, toxic.astype(np.uint64)]), axis=1, return_index=True)
    counts = {}
    for label in (0, 1):
        per_word = np.bincount(pairs[1][np.isin(pairs[0], keep[toxic[keep] == label])], minlength=len(words.distinct))
        counts[label] = np.bincount(features, weights=np.repeat(per_word, np.diff(bounds)), minlength=len(present))
    n1, n0 = max(1, int((toxic[keep] == 1).sum())), max(1, int((toxic[keep] == 0).sum()))
    seeds = seed_features(counts[1], counts[0], n1, n0)
    offending = max_by(seeds[features].astype(float), bounds) > 0
    y = (offending[words.codes] & (toxic[doc] == 1)).astype(float)
    if not y.any():
        return weights, extra
    # conditional log-likelihood, full-batch Adam with a small L2 term
    begin = np.zeros(len(y), bool)
    begin[words.first[:-1][np.diff(words.first) > 0]] = True
    previous = np.where(begin, 0.0, np.concatenate([[0.0], y[:-1]]))
    observed = np.array([[((1 - previous) * (1 - y)).sum(), ((1 - previous) * y).sum()],
                         [(previous * (1 - y)).sum(), (previous * y).sum()]])
    bias, trans, fitted = np.log(y.mean() / (1 - y.mean())), np.zeros((2, 2)), np.zeros(len(present))
    state = [np.zeros_like(fitted), np.zeros_like(fitted), np.zeros(5), np.zeros(5)]
    rate = 0.3
    for step in range(1, STEPS + 1):
        scores = bias + sums_by(fitted[features], bounds)[words.codes]
        kernel = np.exp(trans)
        forward, backward = forward_backward(scores, words.first, kernel)
        p = marginals(forward, backward)
        by_word = np.bincount(words.codes, weights=y - p, minlength=len(words.distinct))
        g = np.bincount(features, weights=np.repeat(by_word, np.diff(bounds)), minlength=len(present))
        w = np.exp(np.clip(scores, -30, 30))
        before = np.where(begin, 0.0, np.concatenate([[0.0], forward[:-1]]))
        pair = np.array([[(1 - before) * kernel[0, 0] * (1 - backward), (1 - before) * kernel[0, 1] * w * backward],
                         [before * kernel[1, 0] * (1 - backward), before * kernel[1, 1] * w * backward]])
        expected = (pair / np.maximum(pair.sum((0, 1)), 1e-300)).sum(2)
        small = np.concatenate([[(y - p).sum()], (observed - expected).ravel()])
        for gradient, first, second, apply in ((g - 0.01 * fitted, 0, 1, "w"), (small / 50, 2, 3, "s")):
            state[first] = 0.8 * state[first] + 0.2 * gradient
            state[second] = 0.95 * state[second] + 0.05 * gradient ** 2
            move = rate * (state[first] / (1 - 0.8 ** step)) / (np.sqrt(state[second] / (1 - 0.95 ** step)) + 1.0)
            if apply == "w":
                fitted += move
            else:
                bias += move[0]
                trans += move[1:].reshape(2, 2)
                trans -= trans[0, 0]
    scores = bias + sums_by(fitted[features], bounds)[words.codes]
    largest = max_by(marginals(*forward_backward(scores, words.first, np.exp(trans))), words.first)
    weights[present] = fitted
    return weights, np.concatenate([[bias], np.exp(trans).ravel(), calibrate(largest, toxic)])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def calibrate(largest: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, intercept) of a logistic curve from the largest marginal's log-odds to the label (damped Newton)."""
    x = np.stack([log_odds(largest), np.ones(len(y))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(PRIOR)
        theta = theta + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - PRIOR * (theta - [1.0, 0.0])), -0.5, 0.5)
    return theta if theta[0] > 0 else np.array([1.0, 0.0])


def document_scores(largest: np.ndarray, extra: np.ndarray, has_tokens: np.ndarray) -> np.ndarray:
    return np.where(has_tokens, 1 / (1 + np.exp(-np.clip(extra[5] * log_odds(largest) + extra[6], -700, 700))), 0.0)


class Model:
    """Weights of the features that occur in the fit, and [bias, kernel, calibration]; small enough for the driver, whatever the corpus."""

    def __init__(self, places: np.ndarray, values: np.ndarray, extra: np.ndarray):
        self.places, self.values, self.extra = places, values, extra

    def weights(self) -> np.ndarray:
        """One weight for every hashed feature (16 MB); made in the tasks that score."""
        out = np.zeros(1 << FEATURE_BITS, np.float32)
        out[self.places] = self.values
        return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows, in one executor task.

    Rows without a label or an id are not used; a document with several
    labels takes the largest.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))
    sample = bounded_sample(known, "label", "id", per_class)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            y += batch.column("label").to_pylist()
        weights, extra = fit(texts, np.array(y, np.int64))
        places = np.flatnonzero(weights)
        parts = places.astype("<i4"), weights[places].astype("<f4"), extra.astype("<f8")
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["places", "weights", "extra"])

    row = rows.select("id", "text", "label").repartition(1).sortWithinPartitions("id").select("text", "label").mapInArrow(one, MODEL).collect()
    if not row:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), NO_MODEL)
    return Model(*(np.frombuffer(row[0][k], t) for k, t in (("places", "<i4"), ("weights", "<f4"), ("extra", "<f8"))))


def token_marginals(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, extra: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, probability of state 1 at each, score of each document) for a run of texts."""
    words = Words(LOWER[data], offsets, ALNUM)
    features, bounds = word_features(words)
    by_word = extra[0] + sums_by(weights[features], bounds)
    p = marginals(*forward_backward(by_word[words.codes] if len(words) else np.zeros(0), words.first, extra[1:5].reshape(2, 2)))
    return words, p, document_scores(max_by(p, words.first), extra, np.diff(words.first) > 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``score``, ``n_toxic_tokens`` and ``spans`` (character offsets, end exclusive).

    Every row gives one row. A null or empty text, or one without tokens,
    scores 0 and has no spans. Other columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, extra = model.weights(), model.extra
        for batch in batches:
            for rows, data, offsets in text_slices(batch, limit=SLICE_BYTES):
                words, p, scores = token_marginals(data, offsets, weights, extra)
                on = np.flatnonzero(p > 0.5)
                doc_of = np.searchsorted(words.first, on, side="right") - 1
                new = np.ones(len(on), bool)
                new[1:] = (np.diff(on) > 1) | (np.diff(doc_of) > 0)
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(on))[:len(begin)] - 1
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                span_doc = doc_of[begin]
                base = chars[offsets[span_doc]]
                spans = pa.StructArray.from_arrays([pa.array((chars[words.starts[on[begin]]] - base).astype(np.int64)),
                                                    pa.array((chars[words.ends[on[end]]] - base).astype(np.int64))], names=["start", "end"])
                cuts = np.concatenate([[0], np.cumsum(np.bincount(span_doc, minlength=len(offsets) - 1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array(scores), pa.array(np.bincount(doc_of, minlength=len(offsets) - 1).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(cuts), spans)], names=["id", "score", "n_toxic_tokens", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    scored = rows.mapInArrow(run, f"id {kind}, score double, n_toxic_tokens int, spans array<struct<start: bigint, end: bigint>>")
    return scored.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text scores below ``threshold``.

    Rows are scored and filtered in one pass, without a shuffle. A null or
    empty text scores 0 and stays; repeated and null ids are judged row by row.
    """
    def judge() -> Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]:
        weights = model.weights()
        return lambda _, data, offsets: token_marginals(data, offsets, weights, model.extra)[2] < threshold

    return kept_rows(docs, judge, text_col, SLICE_BYTES)


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Fit on labels outside the held-out fold and score every document."""
    model = train(docs, labels.where(~held_out("doc_id", folds, fold)))
    return score(docs, model).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic_tokens", "spans")
