"""SentencePiece encoding and decoding by a lattice of pieces (operator 1).

A text is normalised as the library does for this model family (a space before
the text, spaces written as U+2581) and falls apart into *units*: a run of U+2581 and the
characters up to the next one. No piece of the vocabulary spans two units, so
the best segmentation of a text is that of its units, and equal units have one.

For units: all substrings up to the longest piece are exploded and equi-joined
to the piece table; the matches (edges) are grouped by unit, and a
fold over the edges in order of their ends keeps the best path to every place
(Viterbi). Ties keep the edge that begins first. A character without a piece of its
own is an edge of the lowest score less 10, written as its UTF-8 byte pieces.

The units of a corpus grow with it, and those of one document would have to
travel to the encoded units and back. Only the ``FREQUENT`` most frequent units,
a table of bounded size, therefore take the relational path
(:func:`encode_units`: explode, join, group, higher-order aggregate) and are broadcast. The rest of a
run of texts takes the same steps on arrays in its own task
(:func:`lattice_paths`). Tests hold both against each other and against the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import ragged, text_slices
from .language_id import Pieces
from .scratch import stored

SPACE = "▁"
FREQUENT = 50_000
UNKNOWN_PENALTY = 10.0
#: What a task holds at once: bytes of text, and units whose lattice is unfolded.
SLICE_BYTES = 3 << 20
LATTICE_UNITS = 8_000
PIECES = "piece string, id int, score double"


@lru_cache(maxsize=2)
def read_pieces(model_file: str) -> tuple[tuple[tuple[str, int, float], ...], tuple[int, ...]]:
    """((piece, id, score)..., byte piece ids) of a public model file; of fixed size, read on the driver."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    normal = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in range(len(model))
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return normal, tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))


def unit_array(text: Column) -> Column:
    """The units of a text, in order; a null or empty text has none."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(marked, F.lit(f"{SPACE}*[^{SPACE}]+|{SPACE}+$"), F.lit(0)))


def encode_units(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, ids): the best segmentation of every distinct unit; ids are -1 - code point for characters without a piece.

    ``pieces`` has (piece, id, score); its size is the vocabulary's.
    """
    n = F.length("unit")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), n - s + 1)), lambda size: F.struct(s.alias("start"), size.alias("size")))))
    exploded = (units.where("length(unit) > 0").distinct().select("unit", F.explode(spans).alias("span"))
                .select("unit", "span.start", "span.size", F.substring(F.col("unit"), F.col("span.start"), F.col("span.size")).alias("piece")))
    lowest = pieces.agg(F.min("score")).first()[0] - UNKNOWN_PENALTY
    edges = (exploded.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1")
             .select("unit", F.struct((F.col("start") + F.col("size") - 1).alias("end"), (F.col("start") - 1).alias("start"),
                                      F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(lowest)).alias("score")).alias("e")))
    lattice = edges.groupBy("unit").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    nowhere = F.lit(float("-inf"))
    path = F.array().cast("array<int>")
    place = "struct<score: double, ids: array<int>>"
    first = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), path.alias("ids")).cast(place)),
                     F.array_repeat(F.struct(nowhere.alias("score"), path.alias("ids")).cast(place), F.length("unit")))

    def step(best: Column, e: Column) -> Column:
        at, total = F.get(best, e["start"]), F.get(best, e["start"])["score"] + e["score"]
        better = F.struct(total.alias("score"), F.concat(at["ids"], F.array(e["id"])).alias("ids")).cast(place)
        return F.transform(best, lambda x, i: F.when((i == e["end"]) & (total > x["score"]), better).otherwise(x))

    return lattice.select("unit", F.aggregate("edges", first, step, lambda best: F.element_at(best, -1)["ids"]).alias("ids"))


def lattice_paths(data: np.ndarray, offsets: np.ndarray, pieces: Pieces, ids: np.ndarray, scores: np.ndarray, byte_ids: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the best segmentations of units given as UTF-8 bytes, all units at once."""
    n = len(offsets) - 1
    lattice = pieces.lattice(data, offsets)
    start = np.concatenate([at for _, at, _ in lattice] or [np.zeros(0, np.int64)])
    size = np.concatenate([np.full(len(at), k) for k, at, _ in lattice] or [np.zeros(0, np.int64)])
    piece = np.concatenate([i for _, _, i in lattice] or [np.zeros(0, np.int64)])
    # characters without a piece of their own
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(begin, len(data)))
    has = np.zeros(len(data), bool)
    char_size = np.zeros(len(data), np.int64)
    char_size[begin] = width
    has[start[size == char_size[start]]] = True
    extra = ~has[begin]
    start = np.concatenate([start, begin[extra]])
    size = np.concatenate([size, width[extra]])
    piece = np.concatenate([piece, np.full(int(extra.sum()), -1)])
    weight = np.where(piece >= 0, scores[piece], scores.min() - UNKNOWN_PENALTY)
    unit = np.repeat(np.arange(n), np.diff(offsets))[start]
    node = start + unit  # units have one more place than bytes
    goal = node + size
    # by end in the unit, then by start; edges with equal end and size end in different units
    local = goal - offsets[unit] - unit
    longest = int(size.max()) if len(size) else 0
    step = local * (longest + 1) + longest - size
    narrow = len(step) and int(step.max()) < 1 << 16  # NumPy sorts these by radix
    order = np.argsort(step.astype(np.uint16) if narrow else step, kind="stable")
    node, goal, weight, piece, size, start, step = (x[order] for x in (node, goal, weight, piece, size, start, step))
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(step) > 0)), len(step)) if len(step) else np.zeros(1, np.int64)
    best = np.full(len(data) + n, -np.inf)
    best[offsets[:-1] + np.arange(n)] = 0.0
    back = np.full(len(data) + n, -1)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        total, target = best[node[a:b]] + weight[a:b], goal[a:b]
        better = np.flatnonzero(total > best[target])  # of equals the one that begins first stays
        target = target[better]
        best[target] = total[better]
        back[target] = a + better
    # walk back from every unit's end in lockstep
    at, owner, steps = offsets[1:] + np.arange(n), np.arange(n), []
    live = np.diff(offsets) > 0
    at, owner = at[live], owner[live]
    while len(at):
        e = back[at]
        steps.append((owner, e))
        at = node[e]
        open_ = at != (offsets[:-1] + np.arange(n))[owner]
        at, owner = at[open_], owner[open_]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    edge = np.concatenate([e for _, e in steps[::-1]])
    owner = np.concatenate([o for o, _ in steps[::-1]])
    order = np.argsort(owner, kind="stable")
    edge, owner = edge[order], owner[order]
    known = piece[edge] >= 0
    count = np.where(known, 1, size[edge])
    out = np.empty(int(count.sum()), np.int32)
    where = np.cumsum(count) - count
    out[where[known]] = ids[piece[edge[known]]]
    unknown = np.flatnonzero(~known)
    if len(unknown):
        length = size[edge[unknown]]
        places = ragged(np.arange(len(out)), where[unknown], length)
        out[places] = byte_ids[ragged(data, start[edge[unknown]], length)]
    return out, np.concatenate([[0], np.cumsum(np.bincount(owner, weights=count, minlength=n))]).astype(np.int64)


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, first unit of every document): texts normalised and cut into units.

    In the bytes U+2581 is the single byte 0xFF, which UTF-8 never holds.
    """
    some = np.diff(offsets) > 0
    data = np.where(data == 0x20, np.uint8(0xFF), data)
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    keep = np.ones(len(data), bool)
    if len(mark):  # a literal U+2581 is the same character to the model
        data[mark] = 0xFF
        keep[mark + 1] = keep[mark + 2] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    offsets = kept[offsets]
    data = np.insert(data[keep], offsets[:-1][some], 0xFF)
    offsets = offsets + np.concatenate([[0], np.cumsum(some)])
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (data[1:] == 0xFF) & (data[:-1] != 0xFF)
    cut[offsets[:-1][some]] = True
    bounds = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    return data, np.append(bounds, len(data)), np.searchsorted(bounds, offsets)


class Codec:
    """Encodes and decodes runs of texts with a piece table and the paths of frequent units."""

    def __init__(self, rows, byte_ids, frequent: list[tuple[str, list[int]]]):
        raw = [p.replace(SPACE, "\0").encode().replace(b"\0", b"\xff") for p, _, _ in rows]
        self.raw = raw
        self.ids = np.array([i for _, i, _ in rows], np.int32)
        self.scores = np.array([s for _, _, s in rows])
        self.byte_ids = np.array(byte_ids, np.int32)
        self.frequent = pa.array([unit.replace(SPACE, "\0").encode().replace(b"\0", b"\xff") for unit, _ in frequent], pa.large_binary())
        paths = [[i for x in path for i in ([x] if x >= 0 else [byte_ids[b] for b in chr(-1 - x).encode()])] for _, path in frequent]
        self.frequent_length = np.array([len(path) for path in paths], np.int64)
        self.frequent_ids = np.array([i for path in paths for i in path], np.int32)
        size = max([*self.ids.tolist(), *byte_ids]) + 1
        text = [b""] * size
        for r, i in zip(raw, self.ids.tolist()):
            text[i] = r.replace(b"\xff", b" ")
        for b, i in enumerate(byte_ids):
            text[i] = bytes([b])
        self.lengths = np.array([len(t) for t in text])
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @cached_property
    def pieces(self) -> Pieces:
        """Only encoding looks pieces up."""
        return Pieces(self.raw)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, bounds, first = unit_bounds(data, offsets)
        units = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
            None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        distinct = units.dictionary
        if not len(distinct):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
        raw = np.frombuffer(distinct.buffers()[2], np.uint8)
        place = pc.fill_null(pc.index_in(distinct, value_set=self.frequent), -1).to_numpy()
        known, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        length, parts = np.zeros(len(distinct), np.int64), [self.frequent_ids]
        length[known] = self.frequent_length[place[known]]
        start = np.zeros(len(distinct), np.int64)
        start[known] = (np.cumsum(self.frequent_length) - self.frequent_length)[place[known]]
        held = len(self.frequent_ids)
        for k in range(0, len(rest), LATTICE_UNITS):
            part = rest[k:k + LATTICE_UNITS]
            sizes = at[part + 1] - at[part]
            ids, cuts = lattice_paths(ragged(raw, at[part], sizes), np.concatenate([[0], np.cumsum(sizes)]), self.pieces, self.ids, self.scores, self.byte_ids)
            parts.append(ids)
            length[part], start[part] = np.diff(cuts), held + cuts[:-1]
            held += len(ids)
        codes = units.indices.to_numpy(zero_copy_only=False)
        length, start = length[codes], start[codes]
        return ragged(np.concatenate(parts), start, length), np.concatenate([[0], np.cumsum(length)])[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts, without the space that encoding puts first."""
        length = self.lengths[ids].copy()
        begin = self.starts[ids].copy()
        lead = bounds[:-1][np.diff(bounds) > 0]
        lead = lead[self.bytes[begin[lead]] == 0x20]
        begin[lead] += 1
        length[lead] -= 1
        return ragged(self.bytes, begin, length), np.concatenate([[0], np.cumsum(length)])[bounds]


def frequent_units(docs: DataFrame, most: int, text_col: str = "text") -> DataFrame:
    """(unit): at most ``most`` of the most frequent units of up to 64 characters.

    A histogram of the counts, of bounded size, tells from which count on the
    units are few enough, so no task sorts or gathers the units of the corpus.
    """
    counts = (docs.select(F.explode(unit_array(F.col(text_col).cast("string"))).alias("unit")).where("length(unit) <= 64")
              .groupBy("unit").agg(F.count("*").alias("n")).where("n > 1"))
    counts = stored(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "units")
    total, least = 0, 1 << 30
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("units")).collect(), reverse=True):  # some hundred rows at most
        total += r["units"]
        if total > most:
            break
        least = r["step"]
    return counts.where(F.col("step") >= least).select("unit")


def codec_parts(docs: DataFrame, model_file: str, frequent: int = FREQUENT, text_col: str = "text"):
    """(piece rows, byte ids, frequent units with their ids): all of bounded size."""
    spark = docs.sparkSession
    rows, byte_ids = read_pieces(model_file)
    pieces = spark.createDataFrame(list(rows), PIECES)
    encoded = encode_units(frequent_units(docs, frequent, text_col), pieces, max(len(p) for p, _, _ in rows)).collect()
    return rows, byte_ids, [(r["unit"], list(r["ids"])) for r in encoded]


def encode(docs: DataFrame, model_file: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` of every row's whole text; a null or empty text has none. Other columns are not carried."""
    shared = docs.sparkSession.sparkContext.broadcast(codec_parts(docs, model_file, frequent, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, limit=SLICE_BYTES):
                ids, bounds = codec.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """id, ``text``, ``n_pieces`` and ``ids_crc32`` of encoded rows; null ids decode to a null text."""
    rows, byte_ids = read_pieces(model_file)
    shared = encoded.sparkSession.sparkContext.broadcast((rows, byte_ids, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])]).astype(np.int64)
                data, cuts = codec.decode(ids, bounds)
                raw = data.tobytes()
                valid = [x.is_valid for x in lists]
                text = [raw[a:b].decode("utf-8", "replace") if ok else None for ok, a, b in zip(valid, cuts[:-1], cuts[1:])]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(text, pa.string()), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                                                 names=["id", "text", "n_pieces", "ids_crc32"])

    rows_in = encoded.select(F.col(id_col).alias("id"), "ids")
    out = rows_in.mapInArrow(run, f"id {dict(rows_in.dtypes)['id']}, text string, n_pieces bigint, ids_crc32 bigint")
    return out.withColumnRenamed("id", id_col)
