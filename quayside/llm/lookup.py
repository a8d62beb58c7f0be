"""Setting few rows of a large table aside without shuffling the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table of keys (4 MB, broadcast): a bound, whatever the number of keys.
BITS = 1 << 25
#: Bits of one row of that table, as ``bitmap_construct_agg`` makes it.
ROW_BITS = 1 << 15


def marked(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """``rows`` with a boolean ``name`` that is false only where no row of ``keys`` has the same values ``on``.

    The hashes of all keys set bits of a table of ``BITS`` bits, which every
    task tests its rows against. A few rows without a key find a bit of
    another one: a join by the columns themselves must follow for the marked
    rows, and only for them.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(BITS))
    at = [F.floor(place / ROW_BITS).cast("int").alias("__bucket"), F.pmod(place, F.lit(ROW_BITS)).alias("__place")]
    table = keys.select(*at).groupBy("__bucket").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    found = rows.select("*", *at).join(F.broadcast(table), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod("__place", F.lit(8)).cast("int"))
    return found.select(*(f"`{c}`" for c in rows.columns), F.coalesce(bit == 1, F.lit(False)).alias(name))
