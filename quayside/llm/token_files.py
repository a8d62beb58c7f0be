"""Token-id files: Simple-8b words in blocks, written and read by Spark (operator 6).

File format. A table of Parquet files; one row is one *record* of whole
documents in ascending ``doc_id`` order:

- ``shard`` int, ``record`` int: ascending order of the records
- ``ids_before`` long: ids of the same shard before this record
- ``doc_ids`` array<long>, ``n_tokens`` array<long>: the documents
- ``block_words`` array<int>: 64-bit words of each block of 512 ids, so that
  every block decodes alone and all blocks of a record decode at once
- ``payload`` binary: the words, little-endian

A word's upper 4 bits are its selector, which fixes how many ids of how many
bits the lower 60 bits hold (:data:`SLOTS`). Selector 0 is the escape: the next
word is one raw 64-bit value (values of 2**60 and more). The last word of a
block may have spare slots, which are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import text_slices
from .tokens import END_ID, encoder, with_end

# Fixed values: (ids, bits of each) by selector; 0 is the escape.
SLOTS = ((0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
         (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in SLOTS])
BLOCK_IDS = 512
SHORT_BITS = np.searchsorted(2 ** np.arange(17), np.arange(1 << 16), side="right").astype(np.uint8)

FILE_SCHEMA = ("shard int, record int, ids_before bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
               "block_words array<int>, payload binary")


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, words of each block) of one run of unsigned ids.

    The greedy choice of selectors walks through all blocks in lockstep, so
    the Python loop runs at most ``BLOCK_IDS`` times, however many ids come.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    blocks, width = -(-n // BLOCK_IDS), BLOCK_IDS + int(COUNTS.max())
    # a row a block, with zeros behind its ids, so that no word reaches the next block
    padded = np.zeros((blocks, width), np.uint64)
    full = n // BLOCK_IDS
    padded[:full, :BLOCK_IDS] = ids[:full * BLOCK_IDS].reshape(full, BLOCK_IDS)
    padded[full:, :n - full * BLOCK_IDS] = ids[full * BLOCK_IDS:]
    padded = padded.ravel()
    need = _bits(padded)
    choice = np.zeros(len(need), np.uint8)  # the selector with most ids that fits at each place
    span, most = 1, need  # the bits that the next `span` ids, a power of 2, need
    for selector in range(len(SLOTS) - 1, 0, -1):  # later ones, with more ids, replace earlier ones
        count, bits = SLOTS[selector]
        while 2 * span <= count:
            most = np.append(np.maximum(most[:-span], most[span:]), most[-span:])
            span *= 2
        rest = count - span
        here = len(most) - rest  # the places behind are no ids
        choice[:here][np.maximum(most[:here], most[rest:]) <= bits] = selector
    at = np.arange(blocks) * width
    stop = at + np.minimum(BLOCK_IDS, n - np.arange(blocks) * BLOCK_IDS)
    step = np.maximum(COUNTS, 1)[choice]
    first = np.zeros(len(padded), bool)  # where words begin
    while len(at):
        first[at] = True
        at = at + step[at]
        alive = at < stop
        at, stop = at[alive], stop[alive]
    place = np.flatnonzero(first)
    selectors = choice[place]
    size = np.where(selectors == 0, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector, (count, bits) in enumerate(SLOTS):
        mine = np.flatnonzero(selectors == selector)
        if not len(mine):
            continue
        begin = place[mine]
        if not selector:
            words[where[mine] + 1] = padded[begin]
            continue
        word = np.full(len(mine), selector, np.uint64) << np.uint64(60)
        for k in range(count):
            word |= padded[begin + k] << np.uint64(k * bits)
        words[where[mine]] = word
    return words, np.bincount(place // width, weights=size, minlength=blocks).astype(np.int32)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each unsigned id (uint8); 61: too many."""
    if ids.max() < len(SHORT_BITS):
        return SHORT_BITS[ids]
    return np.searchsorted(np.uint64(1) << np.arange(61, dtype=np.uint64), ids, side="right").astype(np.uint8)


def decode_blocks(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a record, all blocks at once (uint64)."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # a raw word follows an escape and is no selector; a run of them alternates
    raw = np.zeros(len(words), bool)
    if (selectors == 0).any():
        starts = np.cumsum(block_words) - block_words
        first = np.zeros(len(words), bool)
        first[starts] = True
        k = 0
        escape = np.flatnonzero(selectors == 0)
        while k < len(escape):  # escapes are rare: ids of 2**60 and more
            if not raw[escape[k]]:
                raw[escape[k] + 1] = True
            k += 1
    ids_of = np.where(raw, 0, np.where(selectors == 0, 1, COUNTS[np.minimum(selectors, len(SLOTS) - 1)]))
    block = np.repeat(np.arange(len(block_words)), block_words)
    before = np.cumsum(ids_of) - ids_of
    block_first = before[np.cumsum(block_words) - block_words]
    place = block * BLOCK_IDS + before - block_first[block]
    stop = np.minimum((block + 1) * BLOCK_IDS, n)
    for selector, (count, bits) in enumerate(SLOTS):
        mine = np.flatnonzero((selectors == selector) & ~raw)
        if not len(mine):
            continue
        if not selector:
            out[place[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            index = place[mine] + k
            ok = index < stop[mine]
            out[index[ok]] = (words[mine[ok]] >> np.uint64(k * bits)) & mask
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write them to ``path`` in ascending order of ``id_col``.

    Texts are dealt by ranges of the id before they are tokenized, so only
    text is shuffled, and each task streams its range into records. A null
    text is empty (its only id is the end id); a null id sorts first; rows
    with one id keep their number and are ordered by text; other columns are
    ignored; an empty table gives files without rows.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, record, before = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer).encode
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                ids, bounds = with_end(*encode(data, offsets), END_ID)
                words, block_words = encode_blocks(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int32()), pa.array([record], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(bounds)], pa.list_(pa.int64())), pa.array([block_words], pa.list_(pa.int32())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary())],
                    names=["shard", "record", "ids_before", "doc_ids", "n_tokens", "block_words", "payload"])
                record += 1
                before += len(ids)

    (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
     .repartitionByRange(F.col("id").asc_nulls_first())
     .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
     .mapInArrow(records, FILE_SCHEMA).write.parquet(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Documents of token files: id, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, the ``ids`` themselves.

    Every record is decoded on its own; the ids before a shard come from the
    shards' totals (one row a file).
    """
    schema = f"shard int, {id_col} bigint, in_shard bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row]
                sizes = cell("n_tokens").values.to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                words = np.frombuffer(cell("payload").as_buffer(), "<u8")
                ids = decode_blocks(words, cell("block_words").values.to_numpy(zero_copy_only=False).astype(np.int64), int(bounds[-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
                arrays = [pa.array(np.full(len(sizes), cell("shard").as_py(), np.int32)), cell("doc_ids").values,
                          pa.array(cell("ids_before").as_py() + bounds[:-1]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["shard", id_col, "in_shard", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # a row a file
    docs = files.mapInArrow(documents, schema).join(F.broadcast(before), "shard")
    return docs.select(id_col, (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
