"""Near-duplicate vectors by a pivot-permutation index (operator 7).

Reference points (pivots) are a bounded sample of the distinct vectors. Each
vector is described by its ``NEAREST`` nearest pivots, nearest first, and
enters the inverted lists of these pivots. Two vectors are candidates when
they share at least ``SHARED`` of them; every candidate is verified by its
cosine in double precision, so a pair that is reported is a link. Equal
vectors are one entry with a weight, and never cost more than one.

A list is processed in tasks of bounded size: one with many entries is dealt out as
pairs of blocks. Vectors of different lengths never meet: the length is a further
key of pivots and lists. A pair counts in the list of the smallest pivot that it
shares. Tasks return the number of links per vector and a spanning forest
of the links, not the links.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import whole_buckets
from .graph import Forest, components
from .scratch import stored

COSINE = 0.95
NEAREST = 10
SHARED = 2
#: Pivots: this many times the root of the number of distinct vectors, within bounds that keep them a few MB.
PIVOT_FACTOR, FEWEST_PIVOTS, MOST_PIVOTS = 4, 16, 8192
BLOCK = 1024
#: A length of at most this many distinct vectors needs no pivots: all its pairs are compared.
DIRECT = 256
FOUND = "a bigint, b bigint, links bigint"


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked_pairs(x: np.ndarray, perm: np.ndarray, side: np.ndarray, pivot: int, mixed: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a list's entries that are candidates of this list and pass verification."""
    unit = _unit(x)
    # a 128-bit signature of the pivots bounds the shared ones from above before they are counted exactly
    signature = np.zeros((len(x), 2), np.uint64)
    bits = np.uint64(1) << (perm % 64).astype(np.uint64)
    for word in (0, 1):
        signature[:, word] = np.bitwise_or.reduce(np.where((perm // 64) % 2 == word, bits, np.uint64(0)), axis=1)
    first, second = [], []
    for a in range(0, len(x), 512):
        b = min(a + 512, len(x))
        shared = sum(np.bitwise_count(signature[a:b, w][:, None] & signature[None, a:, w]) for w in (0, 1))
        maybe = (shared > 0) & (unit[a:b] @ unit[a:].T >= cosine - 1e-9)
        i, j = np.nonzero(maybe)
        i, j = i + a, j + a
        ok = (i < j) & ((side[i] != side[j]) | (not mixed))
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 200_000):
            p, q = i[k:k + 200_000], j[k:k + 200_000]
            same = perm[p][:, :, None] == perm[q][:, None, :]
            low = np.where(same.any(2), perm[p], np.iinfo(np.int32).max).min(1)
            ok = (same.any(2).sum(1) >= SHARED) & (low == pivot)
            p, q = p[ok], q[ok]
            # the reported cosine: dot product over the product of norms, of the vectors as they are
            dot = np.einsum("nd,nd->n", x[p], x[q])
            ok = dot / (np.sqrt(np.einsum("nd,nd->n", x[p], x[p])) * np.sqrt(np.einsum("nd,nd->n", x[q], x[q]))) >= cosine
            first.append(p[ok])
            second.append(q[ok])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, ``n_links``, ``component_id`` (smallest linked id, itself included) and ``kept`` for every row.

    A vector that is null, empty, zero, or holds null or non-finite components links with nothing. So does a
    row with a null id, whose component is null. Vectors link with those of
    their own length only; every length has pivots and lists of its own. Repeated rows are vectors of
    their own and link with each other. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))
    distinct = stored(rows.where(usable).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("d", F.size("v")), "distinct_vectors")
    counts = distinct.groupBy("d").agg(F.count("*").alias("n"))
    # a length of few vectors is one list; each of the others, at most one for every DIRECT vectors, gets an index
    few = distinct.join(counts.where((F.col("n") > 1) & (F.col("n") <= DIRECT)).select("d"), "d", "left_semi")
    one_list = F.array(*[F.lit(k) for k in range(SHARED)])
    indexed = [few.select("v", "rep", "weight", "d", one_list.alias("perm"))]
    for size in counts.where(F.col("n") > DIRECT).orderBy("d").collect():
        indexed.append(pivot_index(distinct.where(F.col("d") == size["d"]), size["n"]).withColumn("d", F.lit(size["d"])).select("v", "rep", "weight", "d", "perm"))
    index = stored(reduce(DataFrame.unionByName, indexed), "pivot_index")
    # the pseudo-pivots of a length of few vectors are the same for all: the first one's list holds every pair
    listed = F.when(F.size("perm") == SHARED, F.slice("perm", 1, 1)).otherwise(F.col("perm"))
    lists = index.select("rep", "weight", "v", "d", "perm", F.explode(listed).alias("pivot"))
    sizes = lists.groupBy("d", "pivot").agg(F.count("*").alias("c")).where("c > 1")  # a row a pivot
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = (lists.join(F.broadcast(sizes), ["d", "pivot"]).withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("d", "pivot", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "rep", "weight", "v", "perm")
             .repartition("d", "pivot", "x", "y").sortWithinPartitions("d", "pivot", "x", "y"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, links = Forest(), Counter()
        edges: list[tuple[int, int]] = []
        for t in whole_buckets(batches, ("d", "pivot", "x", "y")):
            c = {k: t.column(k).to_numpy() for k in ("d", "pivot", "x", "y", "side", "rep", "weight")}
            new = np.ones(len(t), bool)
            new[1:] = (np.diff(c["d"]) != 0) | (np.diff(c["pivot"]) != 0) | (np.diff(c["x"]) != 0) | (np.diff(c["y"]) != 0)
            cuts = np.append(np.flatnonzero(new), len(t))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                part = t.slice(a, b - a)
                i, j = linked_pairs(_matrix(part.column("v")), _matrix(part.column("perm")).astype(np.int32), c["side"][a:b], int(c["pivot"][a]),
                                    bool(c["x"][a] != c["y"][a]), cosine)
                if not len(i):
                    continue
                rep, weight = c["rep"][a:b], c["weight"][a:b]
                total = np.bincount(i, weights=weight[j], minlength=b - a) + np.bincount(j, weights=weight[i], minlength=b - a)
                for k in np.flatnonzero(total):
                    links[int(rep[k])] += int(total[k])
                edges += [(p, q) for p, q in zip(rep[i].tolist(), rep[j].tolist()) if forest.join(p, q)]
        a, b = [e[0] for e in edges], [e[1] for e in edges]
        yield pa.RecordBatch.from_arrays([pa.array(a + list(links), pa.int64()), pa.array(b + [None] * len(links), pa.int64()),
                                          pa.array([None] * len(a) + list(links.values()), pa.int64())], names=["a", "b", "links"])

    found = stored(dealt.mapInArrow(search, FOUND), "links")
    degree = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = (distinct.join(degree, "rep", "left").join(parts, "rep", "left")
             .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    named = named.withColumnRenamed("v", "key")
    # vectors that cannot link have no key: they stay out of the join, in which they would all be one key
    out = (rows.where(usable).join(named, F.col("v") == F.col("key"), "left").select("id", "links", "component")
           .unionByName(rows.where(~usable).select("id"), allowMissingColumns=True))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def pivot_index(distinct: DataFrame, n: int) -> DataFrame:
    """v, rep, weight and ``perm``, the nearest pivots in order, of ``n`` distinct vectors of one length.

    The pivots are a sample of bounded size, by hash: the fit; every vector is indexed.
    """
    wanted = min(MOST_PIVOTS, max(FEWEST_PIVOTS, PIVOT_FACTOR * math.isqrt(n)))
    chosen = distinct.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("v").collect()
    pivots = distinct.sparkSession.sparkContext.broadcast(_unit(np.array([r["v"] for r in chosen], np.float64)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        k = min(NEAREST, len(p))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _unit(_matrix(part.column("v"))) @ p.T
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
                cuts = pa.array(np.arange(len(top) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, pa.array(top.ravel()))], names=["v", "rep", "weight", "perm"])

    kind = dict(distinct.dtypes)["v"]
    return distinct.select("v", "rep", "weight").mapInArrow(describe, f"v {kind}, rep bigint, weight bigint, perm array<int>")
