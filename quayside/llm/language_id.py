"""Language of whole texts from segmentation-marginalised unigrams (operator 10).

The vocabulary is a fixed public one: the byte pieces of a byte-level BPE file.
A word is a run of ASCII letters (A-Z lowered) and non-ASCII bytes with a space
before it. For every language each piece has a probability; the probability of
a word is the sum, over all ways to cut it into pieces, of the product of its
pieces' probabilities (forward algorithm). A text's log-likelihood is the sum
over its words, and the prediction is the language with the largest one.

The piece probabilities are fitted by expectation-maximisation over all
segmentations, on the words of a bounded sample (about ``per_language``
documents of each language), in one task. Scoring covers every text whole:
each distinct word of a run of texts is scored once for all languages. Words
above ``BLOCK`` bytes are cut there, so no path product underflows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LETTER, LOWER, Words, text_slices
from .samples import bounded_sample, held_out

PER_LANGUAGE = 400
ROUNDS = 4
SMOOTHING = 0.05
#: The fit takes words in blocks of this many bytes; scores are over whole words.
BLOCK = 32
RESCALE = 16
LATTICE_BYTES = 400_000
UNKNOWN = "und"
BASE = np.uint64(0x100000001B3)


class Pieces:
    """Pieces looked up by a hash of their bytes; a piece's number is its place in the list."""

    def __init__(self, keep: list[bytes]):
        self.count = len(keep)
        self.longest = max(map(len, keep))
        nodes: dict[bytes, int] = {}  # the pieces' beginnings; -1 where one is no piece itself
        for i, p in enumerate(keep):
            for n in range(1, len(p)):
                nodes.setdefault(p[:n], -1)
            if nodes.get(p, -1) < 0:
                nodes[p] = i
        value = {b"": 0}
        by_length: dict[int, list[tuple[int, int]]] = {}
        for p in sorted(nodes, key=len):
            value[p] = (value[p[:-1]] * int(BASE) + p[-1] + 1) & 0xFFFFFFFFFFFFFFFF
            by_length.setdefault(len(p), []).append((value[p], nodes[p]))
        #: By length, the hashes and numbers of all beginnings, and of the pieces alone.
        self.beginnings, self.tables = {}, {}
        for n, rows in by_length.items():
            rows.sort()
            keys, ids = np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)
            self.beginnings[n] = keys, ids
            if (ids >= 0).any():
                self.tables[n] = keys[ids >= 0], ids[ids >= 0]

    def lattice(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, piece ids) of all matches, by length; matches stay inside words.

        A place is left as soon as no piece begins with what stands there.
        """
        room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        h = np.zeros(len(data), np.uint64)
        at = np.arange(len(data))
        out = []
        for n in range(1, self.longest + 1):
            inside = room[at] >= n
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * BASE + data[at + n - 1].astype(np.uint64) + np.uint64(1)
            keys, ids = self.beginnings[n]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            begun = keys[k] == h
            at, h, piece = at[begun], h[begun], ids[k[begun]]
            hit = piece >= 0
            out.append((n, at[hit], piece[hit]))
        return out


@lru_cache(maxsize=2)
def pieces_of(vocabulary: tuple[bytes, ...]) -> Pieces:
    """Those pieces that can stand in a marked word; every byte is one, so that every text can be cut."""
    keep = [p for p in vocabulary if p and LETTER[np.frombuffer(p[1:], np.uint8)].all() and (p[0] == 0x20 or LETTER[p[0]])]
    singles = set(keep)
    return Pieces(keep + [bytes([b]) for b in range(256) if (b == 0x20 or LETTER[b]) and bytes([b]) not in singles])


def read_vocabulary(path: str) -> tuple[bytes, ...]:
    """Pieces of a public rank file (base64 bytes and rank a line); a file of fixed size, read on the driver."""
    with open(path, "rb") as lines:
        return tuple(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def marked(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, word of each block): distinct words, each with a space before it, in blocks of ``BLOCK`` bytes."""
    flat, offsets = words.buffers()
    flat = flat[:offsets[-1]] if len(offsets) > 1 else flat[:0]
    data = np.insert(flat, offsets[:-1], 0x20)
    offsets = offsets + np.arange(len(offsets))
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    word = np.repeat(np.arange(len(sizes)), blocks)
    ordinal = np.arange(len(word)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return data, np.append(offsets[word] + ordinal * BLOCK, len(data)), word


def _steps(lattice, offsets: np.ndarray, size: int):
    """Matches ordered by where they end in their word: (bounds by end, start place, end place, piece).

    Prefix sums live at ``data`` places with one more place per word.
    """
    starts = np.concatenate([at for _, at, _ in lattice]) if lattice else np.zeros(0, np.int64)
    lengths = np.concatenate([np.full(len(at), n) for n, at, _ in lattice]) if lattice else np.zeros(0, np.int64)
    ids = np.concatenate([i for _, _, i in lattice]) if lattice else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    w = word[starts]
    local_end = starts + lengths - offsets[w]
    order = np.argsort(local_end, kind="stable")
    cuts = np.searchsorted(local_end[order], np.arange(1, size + 2))
    node = starts + w  # words have one more node than bytes
    return cuts, node[order], (node + lengths)[order], ids[order], w[order]


def forward(steps, offsets: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum over all segmentations of every prefix, for the columns of ``p`` (piece x language)."""
    cuts, begin, end, ids, _ = steps
    sums = np.zeros((int(offsets[-1]) + len(offsets) - 1, p.shape[1]))
    sums[offsets[:-1] + np.arange(len(offsets) - 1)] = 1.0
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        value = sums[begin[a:b]] * p[ids[a:b]]
        order = np.argsort(end[a:b], kind="stable")
        target = end[a:b][order]
        first = np.flatnonzero(np.append(True, np.diff(target) > 0))
        sums[target[first]] = np.add.reduceat(value[order], first, axis=0)
    return sums


def backward(steps, offsets: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum over all segmentations of every suffix."""
    _, begin, end, ids, word = steps
    sums = np.zeros((int(offsets[-1]) + len(offsets) - 1, p.shape[1]))
    sums[offsets[1:] + np.arange(len(offsets) - 1)] = 1.0
    local = begin - offsets[word] - word
    order = np.argsort(-local, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(local.max() - local if len(local) else local))]).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        mine = order[a:b]
        value = sums[end[mine]] * p[ids[mine]]
        by = np.argsort(begin[mine], kind="stable")
        target = begin[mine][by]
        first = np.flatnonzero(np.append(True, np.diff(target) > 0))
        sums[target[first]] = np.add.reduceat(value[by], first, axis=0)
    return sums


def log_totals(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of every word, whatever its length (words x languages).

    All words advance together, a byte at a step. Every :data:`RESCALE` steps
    the sums that a longer word may still use are divided by its latest one,
    whose logarithm is added up, so no product of many pieces underflows.
    """
    sizes = np.diff(offsets)
    cuts, begin, end, ids, _ = _steps(pieces.lattice(data, offsets), offsets, int(sizes.max()) if len(sizes) else 0)
    base = offsets[:-1] + np.arange(len(sizes))
    sums, logs = np.zeros((int(offsets[-1]) + len(sizes), p.shape[1])), np.zeros((len(sizes), p.shape[1]))
    sums[base] = 1.0
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    for step, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
        if a < b:
            value = sums[begin[a:b]] * p[ids[a:b]]
            by = np.argsort(end[a:b], kind="stable")
            target = end[a:b][by]
            first = np.flatnonzero(np.append(True, np.diff(target) > 0))
            sums[target[first]] = np.add.reduceat(value[by], first, axis=0)
        if step % RESCALE == 0:
            longer = order[np.searchsorted(ordered, step, side="right"):]
            latest = sums[base[longer] + step]
            logs[longer] += np.log(latest)
            used = (base[longer] + step)[:, None] - np.arange(min(pieces.longest, step + 1))
            with np.errstate(over="ignore"):  # far behind a piece may reach back over anything; what is beyond a double's range stays finite
                sums[used] = np.minimum(sums[used] / latest[:, None, :], 1e300)
    return logs + np.log(sums[base + sizes])


def word_log_likelihood(words: Words, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """log P(word | language) of the distinct words (words x languages), over all segmentations of the whole word."""
    flat, offsets = words.buffers()
    flat = flat[:offsets[-1]] if len(offsets) > 1 else flat[:0]
    data = np.insert(flat, offsets[:-1], 0x20)
    offsets = offsets + np.arange(len(offsets))
    out = np.zeros((len(offsets) - 1, p.shape[1]))
    start = 0
    while start < len(out):  # bounds the lattice held at once, by bytes; one word at least
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + LATTICE_BYTES, side="right")) - 1)
        some = offsets[start:stop + 1]
        out[start:stop] = log_totals(pieces, data[some[0]:some[-1]], some - some[0], p)
        start = stop
    return out


def fit(texts: list[str | None], languages: list[str], names: list[str], pieces: Pieces) -> np.ndarray:
    """Piece probabilities (piece x language) by expectation-maximisation over all segmentations."""
    p = np.full((pieces.count, len(names)), 1.0 / pieces.count)
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    byte_offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    words = Words(LOWER[np.frombuffer(b"".join(raw), np.uint8)], byte_offsets, LETTER)
    if not len(words):
        return p
    index = {name: k for k, name in enumerate(names)}
    of = np.repeat(np.array([index[x] for x in languages]), np.diff(words.first))
    counts = np.zeros((len(words.distinct), len(names)))
    np.add.at(counts, (words.codes, of), 1.0)
    data, offsets, word = marked(words)
    runs = []
    for k in range(0, len(word), 60_000):
        some = offsets[k:k + 60_001]
        runs.append((word[k:k + 60_000], some - some[0], _steps(pieces.lattice(data[some[0]:some[-1]], some - some[0]), some - some[0], BLOCK)))
    for _ in range(ROUNDS):
        expected = np.full_like(p, SMOOTHING)
        for mine, some, steps in runs:
            a, b = forward(steps, some, p), backward(steps, some, p)
            total = a[some[1:] + np.arange(len(some) - 1)]
            _, begin, end, ids, w = steps
            gain = a[begin] * p[ids] * b[end] * (counts[mine] / total)[w]
            for g in range(p.shape[1]):
                expected[:, g] += np.bincount(ids, weights=gain[:, g], minlength=pieces.count)
        p = expected / expected.sum(0)
    return p


def train(docs: DataFrame, vocabulary: tuple[bytes, ...], per_language: int = PER_LANGUAGE, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from a bounded sample of the rows with a language; null ids are not used."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")
                        ).where("lang is not null and id is not null")
    sample = bounded_sample(known, "lang", "id", per_language)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, languages = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            languages += batch.column("lang").to_pylist()
        if texts:
            names = sorted(set(languages))
            p = fit(texts, languages, names, pieces_of(vocabulary))
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([p.astype("<f4").tobytes()], pa.binary())],
                                             names=["names", "p"])

    row = sample.repartition(1).sortWithinPartitions("id", "text").select("text", "lang").mapInArrow(one, "names array<string>, p binary").collect()
    if not row:
        return [], np.zeros((0, 0))
    return list(row[0]["names"]), np.frombuffer(row[0]["p"], "<f4").astype(float).reshape(-1, len(row[0]["names"]))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: tuple[bytes, ...], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per document ``lang_pred`` and ``score``, the posterior under equal priors of the languages.

    ``und`` with score 0 for a null text, a text without a letter and, where
    no language was learned, for every text. Ties go to the first language in
    sort order. Every row gives one row; other columns are not carried.
    """
    names, p = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, names, p.astype(np.float32)))  # vocabulary x languages, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, names, p = shared.value
        pieces, p = pieces_of(rows_of), p.astype(float)
        labels = np.array([*names, UNKNOWN], object)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                words = Words(LOWER[data], offsets, LETTER)
                n = len(offsets) - 1
                pick, share = np.full(n, len(names)), np.zeros(n)
                if len(words) and names:
                    by_word = word_log_likelihood(words, pieces, p)
                    doc = np.repeat(np.arange(n), np.diff(words.first))
                    total = np.stack([np.bincount(doc, weights=by_word[words.codes, g], minlength=n) for g in range(len(names))], 1)
                    best = total.argmax(1)
                    posterior = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    # non-ASCII words need not hold a letter: such texts, few, are looked at one by one
                    ascii_letter = np.concatenate([[0], np.cumsum((LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A))])
                    has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                    texts = rows.column("text")
                    for k in np.flatnonzero(~has & (np.diff(words.first) > 0)):
                        has[k] = any(map(str.isalpha, texts[int(k)].as_py()))
                    pick, share = np.where(has, best, len(names)), np.where(has, posterior, 0.0)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(labels[pick], pa.string()), pa.array(share)],
                                                 names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_held_out(docs: DataFrame, vocabulary_file: str, folds: int = 5, fold: int = 0) -> DataFrame:
    """Fit outside the held-out fold and predict every document."""
    vocabulary = read_vocabulary(vocabulary_file)
    model = train(docs.where(~held_out("doc_id", folds, fold)), vocabulary)
    return identify(docs, model, vocabulary).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")
