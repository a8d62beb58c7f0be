r"""Periodic runs of words by online dyadic square catching (operator 12).

A run is a maximal stretch of words with smallest period q and at least two
periods (and ``least`` words). Words arrive by :meth:`Catchers.append`. Level k
catches the periods q in [2^(k+1), 2^(k+2)): half a square of such a period
holds a whole aligned block of 2^k words, and that block stands again q words
later. So each completed block becomes a catcher, and for the 2^k words that
end a window there are exactly two catchers whose distance lies in the level's
range. A window equal to a catcher starts a comparison of suffixes at that
distance: to the left until the words differ (less than 2^k steps, else the
block before would have caught it), and to the right with every word that is
appended. A comparison that reaches q words is a square, and squares of one
period merge into a run, which is reported when its comparison ends.

Windows are compared by 64-bit hashes of dyadic length, doubled from level to
level, for all appended words at once. What is reported is compared word by
word. Periods below :data:`SMALL` are compared directly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, Words, ragged, text_slices

LEAST = 12
#: Periods below this are compared directly; it is the smallest period of level 2.
SMALL = 8
SLICE_BYTES = 2 << 20
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Catchers:
    """Online search for runs in a growing sequence of word codes; :attr:`runs` has (start, length, period) of the ended ones."""

    def __init__(self, least: int = LEAST):
        self.least, self.n, self.runs = least, 0, []
        self.words = np.zeros(0, np.int64)
        self.hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]  # by level: of the window of 2^k words from every place
        self.compared: dict[int, int] = {}  # level -> windows that have met their catchers
        self.small = [None] * SMALL  # where the words began to equal those q places before
        self.open: dict[int, int] = {}  # period -> start, comparisons that the last word did not end

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        self.words = np.concatenate([self.words, words])
        self._hash()
        self._advance(old)
        for q in range(1, SMALL):
            self._direct(q, old)
        for k in range(2, len(self.hashes)):
            self._catch(k)

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs, by start and period, once no word follows."""
        for q in range(1, SMALL):
            if self.small[q] is not None:
                self._report(self.small[q], self.n, q)
        for q, start in self.open.items():
            self._report(start, self.n, q)
        self.small, self.open = [None] * SMALL, {}
        return sorted(self.runs, key=lambda r: (r[0], r[2]))

    def _hash(self) -> None:
        """Hashes of the windows that the appended words complete; a level exists once a square of it fits."""
        h = self.hashes
        h[0] = np.concatenate([h[0], _mix(self.words[len(h[0]):].astype(np.uint64))])
        k = 1
        while (1 << k + 2) <= self.n or k < 3:
            half = 1 << k - 1
            if k == len(h):
                h.append(np.zeros(0, np.uint64))
            done, stop = len(h[k]), self.n - 2 * half + 1
            if stop > done:
                new = _mix(h[k - 1][done:stop] * np.uint64(0x9E3779B97F4A7C15) + h[k - 1][done + half:stop + half] + np.uint64(k))
                h[k] = np.concatenate([h[k], new])
            k += 1

    def _advance(self, old: int) -> None:
        for q in list(self.open):
            end = self._match(old, q)
            if end < self.n:
                self._report(self.open.pop(q), end, q)

    def _match(self, at: int, q: int) -> int:
        """First place from ``at`` on whose word differs from the one q places before."""
        size = 64
        while at < self.n:
            stop = min(at + size, self.n)
            differ = np.flatnonzero(self.words[at:stop] != self.words[at - q:stop - q])
            if len(differ):
                return at + int(differ[0])
            at, size = stop, size * 4
        return at

    def _direct(self, q: int, old: int) -> None:
        """Advance the comparison with the words q places before, for a small period."""
        begin = max(old, q)
        if begin >= self.n:
            return
        same = self.words[begin:] == self.words[begin - q:self.n - q]
        if self.small[q] is not None:
            if same.all():
                return
            end = int(np.argmin(same))
            self._report(self.small[q], begin + end, q)
            self.small[q], same[:end] = None, False
        edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
        starts, ends = edge[::2] + begin - q, edge[1::2] + begin
        if len(ends) and ends[-1] == self.n:
            self.small[q], starts, ends = int(starts[-1]), starts[:-1], ends[:-1]
        long = ends - starts >= max(self.least, 2 * q)
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            self._report(a, b, q)

    def _catch(self, k: int) -> None:
        """Windows of 2^k words that the appended words complete, against the two live catchers of the level."""
        size, h = 1 << k, self.hashes[k]
        first, stop = max(self.compared.get(k, 0), 2 * size), self.n - size + 1
        if stop <= first:
            return
        self.compared[k] = stop
        caught = []
        blocks = h[::size]
        for back in (2, 3):  # blocks between a catcher's and the window's
            begin = max(first, back * size)
            if begin >= stop:
                continue
            low, high = begin // size, -(-stop // size)
            catcher = np.repeat(blocks[low - back:high - back], size)[begin - low * size:stop - low * size]
            at = np.flatnonzero(h[begin:stop] == catcher) + begin
            caught.append(np.stack([(at // size - back) * size, at]))
        s, b = np.concatenate(caught, axis=1)
        if not len(s):
            return
        q = b - s
        # the block before caught it already
        later = s >= size
        later[later] = h[s[later] - size] == h[s[later] - size + q[later]]
        s, q = s[~later], q[~later]
        # a square of a run of a smaller period that divides q has that period: not its smallest
        for start, end, p in self._known(3 * size, 2 * size):
            inside = (s >= start) & (s + q + size <= end) & (q % p == 0)
            s, q = s[~inside], q[~inside]
        if not len(s):
            return
        left, right = self._extend(s, q, k)
        order = np.lexsort((left, q))
        left, right, q = left[order], right[order], q[order]
        new = np.ones(len(q), bool)  # one comparison, even if two blocks caught it in one batch
        new[1:] = (np.diff(q) != 0) | (np.diff(left) != 0)
        going = right + q == self.n
        keep = new & (going | (right - left >= q))
        for a, e, p, on in zip(left[keep].tolist(), (right + q)[keep].tolist(), q[keep].tolist(), going[keep].tolist()):
            if on:
                self.open.setdefault(p, a)
            else:
                self._report(a, e, p)

    def _known(self, length: int, period: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, period) of squares so far, at least ``length`` long with a period of at most ``period``."""
        for start, n, p in self.runs:
            if n >= length and p <= period:
                yield start, start + n, p
        for p, start in [*((p, s) for p, s in enumerate(self.small) if s is not None), *self.open.items()]:
            if p <= period and self.n - start >= max(length, 2 * p):
                yield start, self.n, p

    def _extend(self, s: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximal [left, right) around s in which a word equals the one q places later, by windows that grow, then shrink."""
        left, right, top = s.copy(), s + (1 << k), len(self.hashes) - 1

        def longer(at: np.ndarray, j: int) -> np.ndarray:
            """Those of ``at`` that go on to the right for a window of level j."""
            at = at[right[at] + q[at] + (1 << j) <= self.n]
            at = at[self.hashes[j][right[at]] == self.hashes[j][right[at] + q[at]]]
            right[at] += 1 << j
            return at

        every = np.arange(len(s))
        at = every
        for j in range(k, top + 1):
            at = longer(at, j)
        while len(at):
            at = longer(at, top)
        for j in range(top - 1, -1, -1):
            longer(every, j)
        for j in range(k - 1, -1, -1):  # less than 2^k to the left, or the block before would have caught it
            step, h = 1 << j, self.hashes[j]
            at = np.flatnonzero(left >= step)
            at = at[h[left[at] - step] == h[left[at] - step + q[at]]]
            left[at] -= step
        return left, right

    def _report(self, start: int, end: int, q: int) -> None:
        """Keep [start, end) if it is a run: long enough, no smaller period, equal word by word."""
        if end - start < max(self.least, 2 * q):
            return
        words = self.words[start:end]
        if not np.array_equal(words[q:], words[:-q]):
            raise ArithmeticError(f"two windows with one 64-bit hash near word {start}")
        p, rest, factor = q, q, 2
        while rest > 1:  # a smaller period of a square divides q
            if rest % factor:
                factor = factor + 1 if factor * factor <= rest else rest
                continue
            rest //= factor
            p = q // factor
            if np.array_equal(words[p:], words[:-p]):
                return
            while rest % factor == 0:
                rest //= factor
        self.runs.append((start, end - start, q))


def runs_of_documents(codes: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(runs, bounds): rows (start, length, period) of every document by start and period; ``first`` bounds the documents.

    Documents of a slice are appended to one search, each ended by a word of its own.
    """
    n_docs = len(first) - 1
    place = np.arange(len(codes)) + np.repeat(np.arange(n_docs), np.diff(first))
    line = np.empty(len(codes) + n_docs, np.int64)
    line[place] = codes
    line[first[1:] + np.arange(n_docs)] = -1 - np.arange(n_docs)
    search = Catchers(least)
    search.append(line)
    runs = np.array(search.finish(), np.int64).reshape(-1, 3)
    begin = first[:-1] + np.arange(n_docs)
    doc = np.searchsorted(begin, runs[:, 0], side="right") - 1
    runs[:, 0] -= begin[doc]
    return runs, np.searchsorted(doc, np.arange(n_docs + 1))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def repeat_tail(n: int, number: int) -> np.ndarray | None:
    """The contract's damage: word numbers of a document whose tail repeats, None if it stays as it is."""
    if number % 10 or not n:
        return None
    g = number // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", damaged: bool = False) -> DataFrame:
    """Per row: id, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``, the text without the repeats.

    Words are runs of bytes other than ASCII white space; ``collapsed`` joins
    the words that no run holds after its first period by one space. A null or
    empty text, or one without words, has no runs and an empty ``collapsed``.
    Rows are independent: repeated and null ids give a row each, other columns
    are ignored, and an empty table gives no rows. ``damaged`` first repeats
    the tails of a tenth of the documents, by the checksum of their ids (a row
    without an id stays as it is).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, limit=SLICE_BYTES):
                words = Words(data, offsets, NOT_SPACE)
                codes, first = words.codes.astype(np.int64), words.first
                starts, ends = words.starts, words.ends
                if damaged:
                    numbers = [None if i is None else zlib.crc32(str(i).encode()) for i in rows.column("id").to_pylist()]
                    source = np.arange(len(codes))
                    for d in (d for d, h in enumerate(numbers) if h is not None and h % 10 == 0):
                        order = repeat_tail(int(first[d + 1] - first[d]), numbers[d])
                        if order is not None:
                            source[first[d]:first[d + 1]] = first[d] + order
                    codes, starts, ends = codes[source], starts[source], ends[source]
                found, bounds = runs_of_documents(codes, first, least)
                texts = []
                for d in range(len(first) - 1):
                    keep = np.flatnonzero(kept_words(int(first[d + 1] - first[d]), found[bounds[d]:bounds[d + 1]])) + first[d]
                    texts.append(_joined(data, starts[keep], ends[keep]))
                runs = pa.StructArray.from_arrays([pa.array(found[:, k].copy()) for k in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs),
                    pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Words joined by one space."""
    if not len(starts):
        return ""
    lengths = ends - starts
    out = np.full(int(lengths.sum()) + len(lengths) - 1, 0x20, np.uint8)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(owner)) + owner] = ragged(data, starts, lengths)
    return out.tobytes().decode("utf-8", "replace")


def run_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The contract's columns, from :func:`find_runs` over damaged documents."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    # greatest length first, then smallest start and period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return find_runs(docs, least, damaged=True).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.period").alias("period"), F.floor(F.lit(1000) * -F.col("best.l") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words")
