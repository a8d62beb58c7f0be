"""Exact Jaccard self-join of documents on word shingles: grouped prefix join (operator 3).

A document's set holds the 64-bit hashes of its distinct word n-grams. Two
documents link when 100 * |A and B| >= percent * |A or B|.

1. One pass counts all shingles into a table of 2**22 counters. Ordering a
   set by (counter, hash) puts its rarest shingles first; this order is the same for all documents,
   which is all that the prefix filter needs to be exact.
2. A second pass gives each document its size, a 128-bit hash of its set, a
   512-bit parity signature and its prefix: the first n - ceil(t n) + 1
   shingles in that order. Linked sets share a prefix shingle.
3. Equal sets become one representative. Representatives with one prefix and
   size become one group, and only groups go through the prefix index.
4. Groups that share a prefix shingle are paired in a task, filtered by size and
   position, expanded to members and filtered by the signatures (the parity
   signature's difference never exceeds the sets' difference). Of the
   surviving pairs a task emits only those that connect what it had not connected yet: a
   forest, never all pairs of a group.
5. These pairs are verified on the sets themselves, and the verified ones make
   components. Where a pair fails, further pairs could connect what it was to connect: then all surviving pairs between
   different components are verified too. Hence no link between
   components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, NOT_SPACE, Words, text_slices, whole_buckets
from .graph import EDGES, Forest, components, edge_batch
from .lookup import marked
from .scratch import stored

WORDS = 4
PERCENT = 85
COUNTERS = 1 << 22
COUNTER_BLOCK = 1 << 16
SIGNATURE_BITS = 512
#: A prefix shingle of more members is dealt out as pairs of blocks of about this many.
BLOCK = 2048
SMALL = 48
#: Text whose shingles a task holds at once.
SLICE_BYTES = 4 << 20
#: Pairs of members that are tested at once.
TILE = 1 << 18
PROFILE = "doc_id bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint, sig binary, prefix array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each document's distinct shingles, ascending by hash.

    With fewer than ``n_words`` words the whole sequence is the one shingle;
    without words the set is empty.
    """
    words = Words(LOWER[data], offsets, NOT_SPACE)
    h = words.hashes()[words.codes] if len(words) else np.zeros(0, np.uint64)
    count = np.diff(words.first)
    salts = list(_mix(np.arange(1, n_words + 1, dtype=np.uint64)) | np.uint64(1))
    full = np.maximum(len(h) - n_words + 1, 0)
    value = np.zeros(full, np.uint64)
    for k in range(n_words if full else 0):
        value += h[k:k + full] * salts[k]
    doc = np.repeat(np.arange(len(count)), count)[:full]
    inside = np.arange(full) + n_words <= words.first[1:][doc]
    value, doc = _mix(value[inside]), doc[inside]
    for k in np.flatnonzero((count > 0) & (count < n_words)):
        some = h[words.first[k]:words.first[k + 1]]
        one = _mix(np.array([(some * np.array(salts[:len(some)])).sum() + np.uint64(len(some))], np.uint64))
        value, doc = np.append(value, one), np.append(doc, k)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def shingle_counters(docs: DataFrame, n_words: int = WORDS) -> np.ndarray:
    """How many documents hold a shingle of each counter, over all documents; a table of fixed size (16 MB)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, data, offsets in text_slices(batch, limit=SLICE_BYTES):
                values, _ = shingle_sets(data, offsets, n_words)
                total += np.bincount((values & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        blocks = total.reshape(-1, COUNTER_BLOCK)
        some = [k for k in range(len(blocks)) if blocks[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in some], pa.binary())],
                                         names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("block").to_pylist(), batch.column("counts")):
                x = np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())],
                                         names=["block", "counts"])

    out = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), np.uint32)
    schema = "block int, counts binary"
    for r in docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toLocalIterator():
        out[r["block"]] += np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out.ravel()


def profiles(docs: DataFrame, counters, n_words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, hash of the set, signature and prefix of every row; ``counters`` is a broadcast of the compressed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(counters.value), np.uint32)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, limit=SLICE_BYTES):
                values, bounds = shingle_sets(data, offsets, n_words)
                n = np.diff(bounds)
                docs_ = len(n)
                doc = np.repeat(np.arange(docs_), n)
                h1, h2 = np.zeros(docs_, np.uint64), np.zeros(docs_, np.uint64)
                some = n > 0
                if len(values):
                    h1[some] = np.add.reduceat(_mix(values), bounds[:-1][some])
                    h2[some] = np.add.reduceat(_mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), bounds[:-1][some])
                bits = np.bincount(doc * SIGNATURE_BITS + (values >> np.uint64(40)).astype(np.int64) % SIGNATURE_BITS,
                                   minlength=docs_ * SIGNATURE_BITS).reshape(docs_, SIGNATURE_BITS) & 1
                sig = np.packbits(bits.astype(np.uint8), axis=1).tobytes()
                order = np.lexsort((values, table[(values & np.uint64(COUNTERS - 1)).astype(np.int64)], doc))
                length = np.where(some, n - (percent * n + 99) // 100 + 1, 0)
                first = np.arange(len(values)) - bounds[doc] < length[doc]
                cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), rows.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.array([sig[k * 64:k * 64 + 64] for k in range(docs_)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(values[order][first].view(np.int64)))],
                    names=["doc_id", "text_hash", "n", "h1", "h2", "sig", "prefix"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, PROFILE)


def _bucket_pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of one bucket, in bounded portions; buckets are [start, end)."""
    size = ends - starts
    small = (size > 1) & (size <= SMALL)
    begin, end = starts[small], ends[small]
    if len(begin):
        rows = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
        stop = np.repeat(end, end - begin)
        for d in range(1, int((end - begin).max())):
            ok = rows + d < stop
            rows, stop = rows[ok], stop[ok]
            yield rows, rows + d
    for a, b in zip(starts[size > SMALL], ends[size > SMALL]):
        for x in range(a, b, 256):
            i, j = np.meshgrid(np.arange(x, min(x + 256, b)), np.arange(x, b), indexing="ij")
            ok = i < j
            yield i[ok], j[ok]


class PairFinder:
    """Pairs of members that may link, from rows sorted by (token, x, y, gid).

    ``connect`` keeps, per task, only pairs that unite what the task had not
    united yet; else all pairs are kept, each once per portion.
    """

    def __init__(self, percent: int, connect: bool):
        self.percent, self.forest = percent, Forest() if connect else None
        self.ready: list[np.ndarray] = []

    def need(self, total: np.ndarray) -> np.ndarray:
        """Smallest intersection that links two sets with ``total`` elements between them."""
        return (self.percent * total + 99 + self.percent) // (100 + self.percent)

    def rows(self, t: pa.Table) -> None:
        """All rows of some buckets."""
        self.c = c = {k: t.column(k).to_numpy() for k in ("token", "x", "y", "pos", "n", "rep", "gid", "side", "label")}
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(-1, SIGNATURE_BITS // 64)
        new = np.ones(len(t), bool)
        new[1:] = (np.diff(c["token"]) != 0) | (np.diff(c["x"]) != 0) | (np.diff(c["y"]) != 0)
        lead = new.copy()
        lead[1:] |= (np.diff(c["gid"]) != 0) | (np.diff(c["side"]) != 0)
        self.group = group = np.flatnonzero(lead)  # groups of the bucket: rows of one gid and side stand together
        self.stop = stop = np.append(group[1:], len(t))
        bucket = np.flatnonzero(new[group])
        n, pos, side, gid, mixed = c["n"][group], c["pos"][group], c["side"][group], c["gid"][group], (c["x"] != c["y"])[group]
        own = np.flatnonzero((stop - group > 1) & (pos == 0) & ~mixed)  # pairs inside a group: once, by its first shingle
        self.members(own, own)
        for i, j in _bucket_pairs(bucket, np.append(bucket[1:], len(group))):
            ok = ((100 * np.minimum(n[i], n[j]) >= self.percent * np.maximum(n[i], n[j]))
                  & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= self.need(n[i] + n[j])) & (~mixed[i] | (side[i] != side[j])) & ((gid[i] != gid[j]) | (pos[i] == 0)))
            if ok.any():
                self.members(i[ok], j[ok])

    def members(self, i: np.ndarray, j: np.ndarray) -> None:
        """Expand pairs of groups to pairs of members, in bounded portions, and filter these by signature."""
        c, size_i, size_j = self.c, self.stop[i] - self.group[i], self.stop[j] - self.group[j]
        # tiles of at most TILE pairs: some members of i, all of j (a block's share of a shingle)
        step = np.maximum(1, TILE // size_j)
        tiles = -(-size_i // step)
        of = np.repeat(np.arange(len(i)), tiles)
        skip = (np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * step[of]
        rows, width = np.minimum(step[of], size_i[of] - skip), size_j[of]
        for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(rows * width) // TILE)) + 1):
            k = (rows * width)[part]
            tile = np.repeat(part, k)
            at = np.arange(len(tile)) - np.repeat(np.cumsum(k) - k, k)
            pair = of[tile]
            a, b = self.group[i[pair]] + skip[tile] + at // width[tile], self.group[j[pair]] + at % width[tile]
            ok = (c["rep"][a] != c["rep"][b]) & (c["label"][a] != c["label"][b]) & ((i[pair] != j[pair]) | (a < b))
            a, b = a[ok], b[ok]
            total = c["n"][a] + c["n"][b]
            differ = np.bitwise_count(self.sig[a] ^ self.sig[b]).sum(1).astype(np.int64)
            ok = differ <= total - 2 * self.need(total)
            if ok.any():
                a, b, share = c["rep"][a[ok]], c["rep"][b[ok]], differ[ok] / total[ok]
                self.keep(np.minimum(a, b), np.maximum(a, b), share)

    def keep(self, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> None:
        if self.forest is None:
            self.ready.append(np.unique(np.stack([a, b]), axis=1))
            return
        find = self.forest.find
        nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.fromiter(map(find, nodes.tolist()), np.int64, len(nodes))
        x, y = root[where[:len(a)]], root[where[len(a):]]
        rest = np.flatnonzero(x != y)
        rest = rest[np.argsort(share[rest], kind="stable")]  # the closest pairs first: they verify best
        _, once = np.unique(np.stack([np.minimum(x, y)[rest], np.maximum(x, y)[rest]]), axis=1, return_index=True)
        chosen = [(p, q) for p, q in zip(a[rest[np.sort(once)]].tolist(), b[rest[np.sort(once)]].tolist()) if self.forest.join(p, q)]
        if chosen:
            self.ready.append(np.array(chosen, np.int64).T)

    def take(self) -> list[pa.RecordBatch]:
        out, self.ready = [edge_batch(*e) for e in self.ready], []
        return out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, ("token", "x", "y")):
            self.rows(table)
            yield from self.take()


def _dealt(shared: DataFrame, members: DataFrame) -> DataFrame:
    """Members at their shared prefix shingles; a shingle of many members is dealt out as pairs of blocks."""
    at = shared.join(members, "gid")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")  # by member: a group of any size is split too
    at = at.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return (at.select("token", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "pos", "n", "gid", "rep", "label", "sig")
            .repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "gid", "side"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(a, b, linked) by the exact test on the sets, which are made again from a text of every set that occurs in pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "head.doc_id", "head.text_hash"), "rep")
    wanted = stored(wanted, "wanted")
    key = ["doc_id", "text_hash"]
    # other texts than those wanted are not shuffled to find these, however many are wanted
    texts = marked(docs, wanted, key, "near").where("near").join(wanted, key).select("rep", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, limit=SLICE_BYTES):
                values, bounds = shingle_sets(data, offsets, n_words)
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.array([raw[8 * a:8 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                                                 names=["rep", "hashes"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    table = stored(texts.mapInArrow(sets, "rep bigint, hashes binary").dropDuplicates(["rep"]), "sets")
    both = (pairs.join(table.select(F.col("rep").alias("a"), F.col("hashes").alias("of_a")), "a")
            .join(table.select(F.col("rep").alias("b"), F.col("hashes").alias("of_b")), "b"))
    return both.select("a", "b", "of_a", "of_b").mapInArrow(test, "a bigint, b bigint, linked boolean")


def merged(parts: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links, from the components before: only what the new links touch is searched again."""
    of = parts.select(F.col("node").alias("x"), F.col("component").alias("label"))
    ends = (more.join(of.withColumnsRenamed({"x": "a", "label": "la"}), "a", "left").join(of.withColumnsRenamed({"x": "b", "label": "lb"}), "b", "left")
            .select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    ends = stored(ends, "ends")
    again = stored(components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("component").alias("top")), "merged")
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("component")),
                                        F.struct(F.col("b").alias("node"), F.col("lb").alias("component")))).alias("n")).select("n.*")
    every = parts.unionByName(new).distinct()
    return every.join(again, F.col("component") == F.col("label"), "left").select("node", F.coalesce("top", "component").alias("component"))


def jaccard_classes(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, ``n_shingles``, ``component_id``, ``text_hash`` (xxhash64 of the text) and ``kept`` for every row.

    Links are between sets, so rows that share an id but not their words are
    linked each by its own words. ``component_id`` is the smallest doc_id
    among the rows of all sets that are reached by links, the row's own included; the row
    with the smallest id, and of these the smallest text hash, has ``kept``
    (with every exact repetition of it). A null or empty text, or one without
    words, has an empty set, is its own component and kept. A row with a
    null id has a null component, links with nothing and is kept. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    table = spark.sparkContext.broadcast(zlib.compress(shingle_counters(docs, n_words).tobytes(), 1))  # at most 16 MB, whatever the corpus
    prof = stored(profiles(docs, table, n_words, percent), "profiles")
    same_set = ["n", "h1", "h2"]
    reps = prof.where("n > 0 and doc_id is not null").groupBy(*same_set).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("head"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    reps = stored(reps.withColumn("px", F.xxhash64("prefix")).withColumn("rep", F.monotonically_increasing_id()), "representatives")
    groups = reps.groupBy("px", "n").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    member = reps.join(groups, ["px", "n"])
    tokens = member.where("rep = gid").select("gid", "n", "members", F.posexplode("prefix").alias("pos", "token"))
    tokens = tokens.withColumn("pos", F.col("pos").cast("bigint"))
    common = tokens.groupBy("token").agg(F.sum("members").alias("c")).where("c > 1")
    # most prefix shingles are nobody else's: the others are found once, for both searches
    shared = stored(tokens.drop("members").join(common, "token"), "shared")
    members = member.select("gid", "rep", "sig", F.col("rep").alias("label"))
    at = _dealt(shared, members)
    pairs = stored(at.mapInArrow(lambda b: PairFinder(percent, True).run(b), EDGES).distinct(), "pairs")
    checked = stored(_verified(pairs, docs, reps, n_words, percent), "checked")
    links = checked.where("linked")
    parts = components(links)
    if not checked.where("not linked").isEmpty():
        # pairs that were to connect something did not: try every other pair between components
        label = members.drop("label").join(parts, F.col("rep") == F.col("node"), "left").select(
            "gid", "rep", "sig", F.coalesce("component", "rep").alias("label"))
        rest = (_dealt(shared, label).mapInArrow(lambda b: PairFinder(percent, False).run(b), EDGES)
                .distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        more = stored(_verified(stored(rest, "more_pairs"), docs, reps, n_words, percent).where("linked"), "more_links")
        if not more.isEmpty():
            parts = merged(parts, more)
    # the first row of every component of more than one set
    tops = reps.join(parts, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("head").alias("top"))
    linked = parts.join(tops, "component").select("node", "top")
    named = reps.select(*same_set, "rep", "head").join(linked, F.col("rep") == F.col("node"), "left").select(*same_set, F.coalesce("top", "head").alias("top"))
    rows = prof.select("doc_id", "text_hash", *same_set).join(named, same_set, "left")
    first = (F.col("top.doc_id") == F.col("doc_id")) & (F.col("top.text_hash") == F.col("text_hash"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("doc_id").isNotNull(), F.coalesce("top.doc_id", "doc_id")).alias("component_id"), "text_hash",
                       F.when(F.col("top").isNull() | F.col("doc_id").isNull(), True).otherwise(first).alias("kept"))


def jaccard_components(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, ``n_shingles`` and ``component_id`` of :func:`jaccard_classes`."""
    return jaccard_classes(docs, n_words, percent).select("doc_id", "n_shingles", "component_id")
