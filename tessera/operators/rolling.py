"""Trailing totals and averages per entity and calendar day, by binary doubling.

Rows are first reduced to one per entity and day (combined on the map side, so a hot entity costs no more than its
days), then days without rows are filled in from the gap to the next day. Sums over 1, 2, 4, 8, 16 ... days come
from doubling: S(2k) at day t is S(k) at t plus S(k) at t - k. Any window is a chain of such blocks, one for each
binary digit of its length. All steps share one partitioning and one order, so there is one shuffle after the first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_loaded(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the values of the row that is greatest in `order` (NULL lowest)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v_")).select(*keys, *[F.col(f"v_.{v}").alias(v) for v in values])


def dense_days(df: DataFrame, entity: str, day: str, zeros: Sequence[str]) -> DataFrame:
    """Every calendar day from an entity's first to its last, one row each; columns `zeros` are 0 on added days."""
    w = Window.partitionBy(entity).orderBy(day)
    gaps = df.withColumn("next_", F.lead(day).over(w))
    last = F.coalesce(F.date_sub("next_", 1), F.col(day))
    out = gaps.select(entity, F.col(day).alias("first_"), *zeros, F.explode(F.sequence(F.col(day), last)).alias(day))
    return out.select(entity, day, *[F.when(F.col(day) == F.col("first_"), F.col(z)).otherwise(F.lit(0)).alias(z) for z in zeros])


def trailing_sums(df: DataFrame, entity: str, day: str, measures: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Sums of each measure over each trailing window, as `measure_window`; needs dense days and no NULL measures."""
    w = Window.partitionBy(entity).orderBy(day)
    block = 1
    for m in measures:
        df = df.withColumn(f"s1_{m}", F.col(m))
    while 2 * block <= max(windows):
        doubled = {f"s{2 * block}_{m}": F.col(f"s{block}_{m}") + F.lag(f"s{block}_{m}", block, 0).over(w) for m in measures}
        df, block = df.withColumns(doubled), 2 * block
    sums: dict[str, Column] = {}
    for n in windows:
        for m in measures:
            total, back = None, 0
            for b in sorted((1 << i for i in range(n.bit_length()) if n >> i & 1), reverse=True):
                part = F.lag(f"s{b}_{m}", back, 0).over(w) if back else F.col(f"s{b}_{m}")
                total, back = part if total is None else total + part, back + b
            sums[f"{m}_{n}"] = total
    return df.withColumns(sums).select(entity, day, *measures, *sums)


def trailing_totals(
    df: DataFrame, *, entity: str, day: str, values: Sequence[str], order: Sequence[str], windows: Sequence[int] = (7, 30), places: Mapping[str, int] | int = 4
) -> DataFrame:
    """Totals and averages of `values` per entity and calendar day over trailing windows, days without rows included.

    Of rows for the same entity and day the last in `order` counts. NULL and NaN count as 0 in totals; `v_avg_n` is
    the total by the days of the window, `v_mean_n` the total by the days that have a value (NULL if none).
    Rows without an entity or a day are left out. An empty table gives no rows.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    one = last_loaded(rows, [entity, day], values, order)
    for v in values:
        x = F.col(v).cast("double")
        x = F.when(F.isnan(x), None).otherwise(x)
        one = one.withColumn(f"n_{v}", x.isNotNull().cast("int")).withColumn(v, F.coalesce(x, F.lit(0.0)))
    counts = [f"n_{v}" for v in values]
    dense = dense_days(one, entity, day, [*values, *counts])
    sums = trailing_sums(dense, entity, day, [*values, *counts], windows)
    out = [F.col(entity), F.col(day)]
    for v in values:
        digits = places if isinstance(places, int) else places[v]
        for n in windows:
            total = F.round(f"{v}_{n}", digits)
            out += [total.alias(f"{v}_sum_{n}"), (total / n).alias(f"{v}_avg_{n}"), F.try_divide(total, F.col(f"n_{v}_{n}")).alias(f"{v}_mean_{n}")]
    return sums.select(*out)
