"""Document quality by co-training two views (operator 2).

The *content* view sees the text: relative frequencies of its byte trigrams,
hashed to a fixed number of columns, and how often words repeat at once. The *metadata* view sees the page's
record and layout: source, language, length, line lengths, and the shares of
capitals, digits, marks, spaces and non-ASCII bytes. Each view has its own
logistic classifier. Over rounds, each labels the unlabelled pool where it is
confident and hands these rows to the other one. Both are then calibrated on
labelled rows that neither was fitted on, and a document's score is the
logistic mean of the two calibrated views.

The fit uses bounded samples (about ``per_class`` labelled rows of each class
and ``pool`` unlabelled rows) and runs in one task; scoring covers every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, Words, kept_rows, sums_by, text_slices
from .samples import bounded_sample

TRIGRAM_BITS = 11
SOURCES, LANGS = 64, 16
SHAPES = 12
REPEATS = 2
PER_CLASS = 1500
POOL = 1500
ROUNDS = 2
#: Probability from which a view's label counts as confident, and how many it hands over per round and class.
CONFIDENT = 0.95
HANDED = 300
#: Documents below this score are rejected; under one half, so that a doubtful document stays.
KEEP = 0.3


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram that begins at each byte but the last two."""
    x = data.astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:] if len(x) > 2 else x[:0]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)


def _inner(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the trigrams that lie inside each document."""
    begin = np.minimum(offsets[:-1], n)
    return begin, np.maximum(np.minimum(offsets[1:] - 2, n), begin)


def repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of words that equal the word one and two before them in the document."""
    words = Words(data, offsets, NOT_SPACE)
    out = np.zeros((len(offsets) - 1, REPEATS))
    for back in range(1, REPEATS + 1):
        same = np.zeros(len(words))
        same[back:] = words.codes[back:] == words.codes[:-back]
        for ahead in range(back):  # the first words of a document have none before them
            same[np.minimum(words.first[:-1] + ahead, len(words) - 1) if len(words) else []] = 0
        out[:, back - 1] = sums_by(same, words.first) / np.maximum(np.diff(words.first), 1)
    return out


def content_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense relative trigram frequencies and repetition shares; for the bounded sample only."""
    h = trigrams(data)
    out = np.zeros((len(offsets) - 1, (1 << TRIGRAM_BITS) + REPEATS), np.float32)
    out[:, 1 << TRIGRAM_BITS:] = repetition(data, offsets)
    for k, (a, b) in enumerate(zip(*_inner(offsets, len(h)))):
        if b > a:
            out[k, :1 << TRIGRAM_BITS] = np.bincount(h[a:b], minlength=1 << TRIGRAM_BITS) / (b - a)
    return out


def content_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What ``content_matrix @ weights`` gives, without the matrix."""
    h = trigrams(data)
    begin, end = _inner(offsets, len(h))
    total = np.concatenate([[0.0], np.cumsum(weights[h], dtype=np.float64)])
    return (total[end] - total[begin]) / np.maximum(end - begin, 1) + repetition(data, offsets) @ weights[1 << TRIGRAM_BITS:]


def metadata_matrix(data: np.ndarray, offsets: np.ndarray, source: list, lang: list) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    per_byte = np.maximum(size, 1)

    def share(mask):
        return sums_by(mask, offsets) / per_byte

    newline = sums_by(data == 10, offsets)
    space = share(data == 32)
    alpha = share(((data | 32) >= 97) & ((data | 32) <= 122))
    shapes = [np.log1p(size) / 10, np.log1p(size / (1 + newline)) / 10, np.log1p(newline) / 5, space, alpha,
              share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(data >= 128),
              share((data > 32) & (data < 48) & (data != 44) & (data != 46)), share((data == 44) | (data == 46)),
              share((data >= 58) & (data <= 64) | (data >= 91) & (data <= 96) | (data >= 123) & (data < 128)), size == 0]
    out = np.zeros((n, SHAPES + SOURCES + LANGS), np.float32)
    for k, column in enumerate(shapes):
        out[:, k] = column
    rows = np.arange(n)
    for values, first, size_ in ((source, SHAPES, SOURCES), (lang, SHAPES + SOURCES, LANGS)):
        column = {v: first + crc32(str(v).encode()) % size_ for v in set(values)}  # each distinct value is hashed once
        out[rows, np.fromiter((column[v] for v in values), np.int64, n)] = 0.3
    return out


class Logistic:
    """Standardised features, full-batch accelerated gradient steps, classes weighted alike."""

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 60, l2: float = 1e-3) -> Logistic:
        self.mean, spread = x.mean(0), x.std(0)
        self.scale = np.where(spread > 1e-7, 1 / np.maximum(spread, 1e-7), 0.0)
        z = ((x - self.mean) * self.scale).astype(np.float32)
        z = np.clip(z, -6, 6)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        theta, bias, v, vb = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
        rate = 4.0 / max(1.0, float((z * z).sum(1).mean()))
        for _ in range(steps):
            r = weight * (y - 1 / (1 + np.exp(-np.clip(z @ theta.astype(np.float32) + bias, -30, 30))))
            v = 0.9 * v + rate * (z.T @ r.astype(np.float32) - l2 * theta)
            vb = 0.9 * vb + r.sum()
            theta, bias = theta + v, bias + vb
        self.weights = theta * self.scale
        self.bias = bias - float(self.mean @ self.weights)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def platt(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, intercept) that calibrate a view on held-back rows, pulled weakly to (1, 0)."""
    x, theta, prior = np.stack([logit, np.ones(len(y))], 1), np.array([1.0, 0.0]), np.array([0.5, 0.5])
    for _ in range(60):
        p = sigmoid(x @ theta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior)
        theta = theta + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - prior * (theta - [1.0, 0.0])), -0.5, 0.5)
    return theta if theta[0] > 0 else np.array([0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))])


def co_train(content: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """[content weights, meta weights, [content bias, meta bias, calibrations...]]; label -1 is unlabelled."""
    labelled = np.flatnonzero(label >= 0)
    held = labelled[2::4]  # every fourth labelled row calibrates
    train = np.setdiff1d(labelled, held)
    pool = np.flatnonzero(label < 0)
    own = [(train, label[train].astype(float)), (train, label[train].astype(float))]
    views = [content, meta]
    if len(np.unique(label[train])) < 2:
        share = float((label[labelled].sum() + 1) / (len(labelled) + 2))
        return [np.zeros(content.shape[1]), np.zeros(meta.shape[1]), np.array([0, 0, 0, np.log(share / (1 - share)), 0, np.log(share / (1 - share))])]
    models = [Logistic().fit(x[rows], y) for x, (rows, y) in zip(views, own)]
    free = [pool, pool]
    for _ in range(rounds):
        for giver, taker in ((0, 1), (1, 0)):
            rows = free[taker]
            if not len(rows):
                continue
            p = sigmoid(models[giver].logit(views[giver][rows]))
            for y, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:HANDED]
                chosen = rows[best[sure[best] >= CONFIDENT]]
                own[taker] = np.append(own[taker][0], chosen), np.append(own[taker][1], np.full(len(chosen), y))
                free[taker] = np.setdiff1d(free[taker], chosen)
        models = [Logistic().fit(x[rows], y) for x, (rows, y) in zip(views, own)]
    if not len(held):
        held = train
    marks = [platt(m.logit(x[held]), label[held]) for m, x in zip(models, views)]
    return [models[0].weights, models[1].weights, np.concatenate([[models[0].bias, models[1].bias], *marks])]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, pool: int = POOL, label_col: str = "quality") -> list[np.ndarray]:
    """Fit in one task on bounded samples; the model has a fixed size. Rows without an id are not used."""
    known = (labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang")).where("id is not null")
    taken = F.broadcast(bounded_sample(known, "label", "id", per_class))
    all_ids = rows.select("id", F.lit(-1).alias("label"))
    free = F.broadcast(bounded_sample(all_ids, "label", "id", pool).dropDuplicates(["id"]).join(taken.select("id"), "id", "left_anti"))
    sample = rows.join(F.broadcast(taken.unionByName(free)), "id")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, meta, label = [], [], []
        for batch in batches:
            for some, data, offsets in text_slices(batch):
                content.append(content_matrix(data, offsets))
                meta.append(metadata_matrix(data, offsets, some.column("source").to_pylist(), some.column("lang").to_pylist()))
                label += some.column("label").to_pylist()
        if label:
            model = co_train(np.concatenate(content), np.concatenate(meta), np.array(label))
            yield pa.RecordBatch.from_arrays([pa.array([m.astype("<f8").tobytes()], pa.binary()) for m in model], names=["content", "meta", "rest"])

    row = (sample.select("id", "text", "source", "lang", "label").repartition(1).sortWithinPartitions("id", "text")
           .mapInArrow(one, "content binary, meta binary, rest binary").collect())
    if not row:
        return [np.zeros((1 << TRIGRAM_BITS) + REPEATS), np.zeros(SHAPES + SOURCES + LANGS), np.zeros(6)]
    return [np.frombuffer(row[0][k], "<f8") for k in ("content", "meta", "rest")]


def score(docs: DataFrame, model: list[np.ndarray]) -> DataFrame:
    """doc_id, ``content_score``, ``meta_score``, ``score`` (0 to 1, higher: better) and ``keep`` for every row.

    Null text, source or lang are values of their own (an empty text, an
    unknown source); an empty text has only its metadata and the content view's
    prior. Every row gives one row; other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 2,000 numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in text_slices(batch):
                a, b, total = view_scores(some, data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(a), pa.array(b), pa.array(total), pa.array(total >= KEEP)],
                                                 names=["doc_id", "content_score", "meta_score", "score", "keep"])

    rows = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, content_score double, meta_score double, score double, keep boolean")


def view_scores(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, model: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, metadata, combined) scores of a run of rows."""
    content, meta, rest = model
    columns = [rows.column(c).cast(pa.string()).to_pylist() for c in ("source", "lang")]
    a = rest[2] * (content_scores(data, offsets, content) + rest[0]) + rest[3]
    b = rest[4] * (metadata_matrix(data, offsets, *columns) @ meta + rest[1]) + rest[5]
    return sigmoid(a), sigmoid(b), sigmoid((a + b) / 2)


def good_rows(docs: DataFrame, model: list[np.ndarray], least: float = KEEP) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``least`` or more, each by its own values; one pass, no shuffle."""
    return kept_rows(docs, lambda: lambda rows, data, offsets: view_scores(rows, data, offsets, model)[2] >= least)
