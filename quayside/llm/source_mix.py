"""Mixing sources to target weights by weighted fair queueing (operator 13).

Every source has a queue of its documents in shuffled order, each document as
often as the mix may repeat it: a whole pass over the source, then the next.
A document's virtual finish time is the words of its queue up to its end,
divided by its source's target, so a source whose target is twice as large
moves twice as fast. All entries are sorted by finish time with a range
partitioning, and the mix is the prefix whose words fit the total budget.

Targets are shares of the budget by weight. A share above what the source can
give (``most_times`` its size) stops there, and what is left over is shared
again by weight among the others: ``target = min(most, level * weight)``, with
the one level at which the targets add up to the budget.

No running sum passes through one task: a source's queue is cut by the hash
that shuffles it, the global order by Spark's range partitions, and only sums
of the cuts are added up in order. The cut in the global order is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: The same words as `[^\x20\x09-\x0D]+` of the contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_TIMES = 2
SEED = "mix"
#: Hexadecimal digits of the shuffling hash that cut a source's queue.
CUT_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted by range partitions and written, with ``part`` (the partition) and ``at`` (ascending in the whole order)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(placed, name).withColumn("part", F.shiftright("at", 33))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, rank, ``target`` from (source, source_size): weights in turn by code point, null last.

    The level is found by rounds over the sources: those whose share exceeds
    what they can give are set to it, and the rest is shared again, until no
    share exceeds. Only sums reach the driver.
    """
    placed = in_order(sizes, [F.col("source").asc_nulls_last()], "sources")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = parts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    rank = (F.col("before") + F.col("at") - F.col("first")).cast("bigint")
    turn = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    ranked = (placed.join(before, "part").select("source", "source_size", rank.alias("rank"))
              .withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
              .withColumn("most", F.col("source_size") * most_times))
    ranked = stored(ranked, "weights")
    total = ranked.agg(F.sum("source_size")).collect()[0][0] or 0
    budget, level, seen = total * budget_percent / 100.0, 0.0, None
    full = F.lit(False)
    while True:
        row = ranked.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most")))).collect()[0]
        if not row[0] or row[0] == seen:
            level = level if row[0] else float("inf")
            break
        seen, level = row[0], (budget - float(row[1] or 0)) / row[0]
        full = F.col("most") < F.lit(level) * F.col("weight")
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def queued(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, ``ends`` (words of the source's shuffled queue up to the document's end) of every row.

    Equal rows (source, id and size) stand next to each other, as copies: a
    count until their places are known.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col).cast("string")).alias("size"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stored(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
                  .withColumn("key", key).withColumn("cut", F.substring("key", 1, CUT_DIGITS)), "sizes")
    words = F.col("size") * F.col("copies")
    cuts = rows.groupBy("source", "cut").agg(F.sum(words).alias("words"))
    cuts = cuts.select("source", "cut", (F.sum("words").over(Window.partitionBy("source").orderBy("cut")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("source", "cut").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", (F.sum(words).over(inside) - words).alias("inside"))
    same = rows["source"].eqNullSafe(cuts["source"]) & (rows["cut"] == cuts["cut"])
    return (rows.join(cuts, same).select("doc_id", rows["source"], "size", (F.col("before") + F.col("inside")).alias("begins"),
                                         F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
            .select("doc_id", "source", "size", (F.col("begins") + F.col("copy") * F.col("size")).alias("ends")))


def mix(docs: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_times: int = MOST_TIMES, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, ``target`` of its source, ``times`` and ``taken`` (words).

    A null or empty text has no words and is never taken. A null source is a
    source like any other, the last one. Null and repeated ids count row by
    row; copies of one row follow each other in the queue, so the mix may take
    some of them once more than others. The order depends on ``seed``, ids
    and sizes only, so reruns agree. An empty table gives no rows; other
    columns are ignored.
    """
    rows = stored(queued(docs, seed, id_col, text_col, source_col), "queues")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, budget_percent, most_times), "targets")
    total = targets.agg(F.sum("source_size")).collect()[0][0] or 0
    same = rows["source"].eqNullSafe(targets["source"])
    rows = rows.join(targets, same).select("doc_id", rows["source"], "size", "ends", "source_size", "target", "rank")
    entry = [F.struct((F.col("ends") + F.lit(k).cast("bigint") * F.col("source_size")).alias("ends")) for k in range(most_times)]
    entries = rows.where("size > 0").select("size", "target", "rank", F.explode(F.array(*entry)).alias("e")).select(
        finish(F.col("e.ends")).alias("finish"), "rank", F.col("e.ends").alias("ends"), "size")
    cut = budget_cut(entries, total * budget_percent // 100)
    times = F.lit(0)
    for k in range(most_times):
        at = F.col("ends") + F.lit(k).cast("bigint") * F.col("source_size")
        times = times + F.when(before_cut(finish(at), F.col("rank"), at, cut), 1).otherwise(0)
    times = F.when(F.col("size") > 0, times).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def finish(ends: Column) -> Column:
    """Virtual finish time; a source with words always has a target."""
    return ends.cast("double") / F.when(F.col("target") > 0, F.col("target"))


def before_cut(time: Column, rank: Column, ends: Column, cut: tuple | None) -> Column:
    """Whether an entry stands before the first one that no longer fits."""
    if cut is None:
        return F.lit(True)
    t, r, e = (F.lit(x) for x in cut)
    return F.coalesce((time < t) | ((time == t) & ((rank < r) | ((rank == r) & (ends < e)))), F.lit(False))


def budget_cut(entries: DataFrame, budget: int) -> tuple | None:
    """(finish, rank, ends) of the first entry, in global order, with which the words exceed ``budget``; None if all fit.

    Partitions of the global order are summed, their sums added up in order,
    and only the partition in which the budget ends is looked at row by row.
    """
    order = [F.col("finish"), F.col("rank"), F.col("ends")]
    placed = in_order(entries, order, "order")
    parts = placed.groupBy("part").agg(F.sum("size").alias("words"))
    upto = parts.select("part", "words", F.sum("words").over(Window.orderBy("part")).alias("upto"))  # a row a partition
    last = upto.where(F.col("upto") > budget).orderBy("part").limit(1).collect()
    if not last:
        return None
    left = budget - (last[0]["upto"] - last[0]["words"])
    running = F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    row = (placed.where(F.col("part") == last[0]["part"]).select("finish", "rank", "ends", "at", running.alias("words"))
           .where(F.col("words") > left).orderBy("at").limit(1).collect()[0])
    return row["finish"], row["rank"], row["ends"]


def oracle_sql(weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_times: int = MOST_TIMES, seed: str = SEED) -> str:
    """The same mix in DuckDB SQL, with the level found over the sources in order of what they can give per weight."""
    turn = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return rf"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key
      FROM documents),
    sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
      FROM sized GROUP BY source),
    weighted AS (
      SELECT *, CASE rank % {len(weights)} {turn} END AS weight, source_size * {most_times} AS most FROM sources),
    stepped AS (
      SELECT most / weight AS ratio, rank,
             (sum(source_size) OVER () * {budget_percent} / 100.0::DOUBLE
              - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM weighted),
    level AS (SELECT coalesce(arg_min(level, (ratio, rank)) FILTER (WHERE ratio >= level), 'inf'::DOUBLE) AS level FROM stepped),
    targets AS (
      SELECT source, source_size, rank, least(most::DOUBLE, level * weight) AS target FROM weighted, level),
    queues AS (
      SELECT doc_id, d.source, size, source_size, target, rank,
             row_number() OVER () AS line, sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
      FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
    entries AS (
      SELECT line, size, rank, ends + pass * source_size AS ends, (ends + pass * source_size)::DOUBLE / target AS finish
      FROM queues, range({most_times}) p(pass) WHERE size > 0),
    summed AS (SELECT line, size, sum(size) OVER (ORDER BY finish, rank, ends ROWS UNBOUNDED PRECEDING) AS words FROM entries),
    mixed AS (
      SELECT line, sum(size)::BIGINT AS taken FROM summed
      WHERE words <= (SELECT sum(source_size) * {budget_percent} // 100 FROM sources) GROUP BY line)
    SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
    FROM queues LEFT JOIN mixed USING (line)
    """
