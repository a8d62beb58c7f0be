"""Best-fit packing of documents into sequences (operator 4).

A document's tokens (with the end id) are cut into pieces only where they
exceed the capacity: full pieces from the end, so the first one may be shorter.
What is packed are piece lengths, and these are whole numbers up to the
capacity: the plan is made from the count of pieces of every length, a table
of at most ``capacity`` rows, whatever the corpus holds.

Large-item matching: of pieces above a third of the capacity at most two
share a sequence, so these are matched greedily, the largest open one with
the largest partner that fits beside it. Smaller pieces then go, longest
first, to the smallest gap that takes them. The plan is a list of runs: the
pieces of one length with ranks from ``lo`` to ``hi`` go to consecutive
sequences. Every piece finds its run by its length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import text_slices
from .scratch import stored
from .tokens import END_ID, encoder, with_end

CAPACITY = 2048
#: Bytes of text that a task encodes at once.
SLICE_BYTES = 1 << 20
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, task_rank bigint"
PLAN = "length bigint, lo bigint, hi bigint, first_sequence bigint, per_sequence bigint, first_offset bigint"


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, lo, hi, first_sequence, per_sequence, first_offset) for the counts of each length.

    The piece of rank r in [lo, hi) goes to sequence first_sequence + (r - lo) // per_sequence,
    at offset first_offset + length * ((r - lo) % per_sequence).
    """
    runs, used, sequences = [], defaultdict(int), 0
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first sequence, how many)]
    gaps: list[int] = []  # those that have groups, ascending

    def place(length, n, first, each, offset):
        runs.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    def leave(gap, first, n):
        if gap and n:
            if not groups[gap]:
                insort(gaps, gap)
            groups[gap].append((first, n))

    left = {s: n for s, n in counts.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1  # the largest partner that fits
        if k < 0:
            place(a, left[a], sequences, 1, 0)
            leave(capacity - a, sequences, left[a])
            sequences += left.pop(a)
            large.pop()
            continue
        b = large[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n:
            place(a, n, sequences, 1, 0)
            place(b, n, sequences, 1, a)
            leave(capacity - a - b, sequences, n)
            sequences += n
            left[a] -= n
            left[b] -= n
        if a == b and left[a]:  # one of an odd number is left: match it with a smaller one
            if k:
                c = large[k - 1]
                place(a, 1, sequences, 1, 0)
                place(c, 1, sequences, 1, a)
                left[c] -= 1
                leave(capacity - a - c, sequences, 1)
            else:
                place(a, 1, sequences, 1, 0)
                leave(capacity - a, sequences, 1)
            sequences += 1
            left[a] = 0
        large = [s for s in large if left[s]]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(gaps, s)
            if k == len(gaps):  # no gap takes it: new sequences
                each = capacity // s
                bins = -(-n // each)
                leave(capacity, sequences, bins)
                sequences += bins
                continue
            gap = gaps[k]
            first, bins = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(k)
            each = gap // s
            full = min(bins, n // each)
            if full:
                place(s, full * each, first, each, capacity - gap)
                leave(gap - each * s, first, full)
                n -= full * each
            if full < bins and n:  # fewer than fill one more
                place(s, n, first + full, n, capacity - gap)
                leave(gap - n * s, first + full, 1)
                full, n = full + 1, 0
            leave(gap, first + full, bins - full)
    return runs




def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """A row for every piece, with its rank among the pieces of that length made by one task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encode = encoder(tokenizer).encode
        for batch in batches:
            for rows, data, offsets in text_slices(batch, limit=SLICE_BYTES):
                ids, bounds = with_end(*encode(data, offsets), END_ID)
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = sizes - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = bounds[doc] + start
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at, at + length)]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, PIECES)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Pack all documents; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has one piece, its end id. Null ids and repeated rows
    are packed like any others, each row once; an empty table gives no rows;
    other columns are ignored. The pieces are written to shared scratch once,
    so tokenizing runs once and ranks never change on a retry. A piece's
    rank in the corpus is its rank in its task plus the counts of the tasks
    before, so no length, however common, is gathered in one task.
    """
    spark = docs.sparkSession
    pieces = stored(document_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    base = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(pack_plan(counts, capacity), PLAN)
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    # the plan's size is bounded by the capacity, not by the corpus
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")),
                         (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + step % F.col("per_sequence") * F.col("length")).alias("offset"))


def packed_sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The token ids of every sequence: pieces with their ``ids`` joined to their places and laid end to end.

    A sequence holds at most ``capacity`` ids, so each group is bounded.
    """
    rows = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces_with_ids, ["doc_id", "piece"])
    laid = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return laid.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
