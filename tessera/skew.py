"""Helpers that keep one hot key from landing in one task, and rows that can match nothing out of a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: Rows of a table of heavy groups up to which it is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Words of 64 bits in a filter: 8.4 million bits, 3 MB as a table, whatever the data.
FILTER_WORDS = 1 << 17


def heavy_groups(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame | None:
    """The groups with more than `min_rows` rows as a table (keys, rows_), or None if there is none.

    The counts are combined on the map side, so a hot group costs one row per task. No group is left out: there are at
    most rows / `min_rows` of them, and the table goes to the shared folder, not to the driver. It is marked for broadcast
    only when counted to be short. An empty table has no heavy group. NULL keys form a group like any other.
    """
    found = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_")).where(F.col("rows_") > min_rows))
    n = found.count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found


def salt_of(column: Column, salts: int | Column) -> Column:
    """A stable salt in [0, salts): the same row gets the same salt when a task is run again."""
    return F.pmod(F.xxhash64(column), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def _bits(keys: Sequence[str]) -> tuple[Column, Column]:
    """The word of the filter that a row's keys fall into, and their bit in it."""
    h = F.xxhash64(*keys)
    return h.bitwiseAND(F.lit(FILTER_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int"))


def may_match(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` whose keys `wanted` may have: none that it has is lost, and of the others only those whose bit collides stay.

    The filter is a table of a fixed size, so it is broadcast whatever the data; when `wanted` fills it, it lets everything
    pass. `df` must not have columns named word_, bit_ and bits_.
    """
    word, bit = _bits(keys)
    none = df.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("word_"), F.lit(0).cast("bigint").alias("bit_"))
    table = wanted.select(word.alias("word_"), bit.alias("bit_")).unionAll(none).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))
    held = df.withColumn("word_", word).withColumn("bit_", bit)
    return held.join(F.broadcast(table), "word_").where(F.col("bits_").bitwiseAND(F.col("bit_")) != 0).select(*df.columns)
