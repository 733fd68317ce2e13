"""Panels of bars, and what is joined to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safe import finite
from tessera.operators.rolling import last_loaded

BAR = {"px_open": "open", "px_high": "high", "px_low": "low", "px_last": "close", "volume": "volume", "weighted_avg_px": "vwap"}


def daily_panel(prices: DataFrame, symbol: str = "stock_code", day: str = "date", columns: Mapping[str, str] = BAR, order: Sequence[str] = ("loaded_at_utc", "row_id")) -> DataFrame:
    """One bar per symbol and day (of repeated rows the last loaded): symbol, timestamp and the bar's fields as finite doubles."""
    rows = prices.where(F.col(symbol).isNotNull() & F.col(day).isNotNull())
    one = last_loaded(rows, [symbol, day], list(columns), order)
    return one.select(F.col(symbol).alias("symbol"), F.col(day).alias("timestamp"), *[finite(F.col(c)).alias(n) for c, n in columns.items()])


def between(df: DataFrame, start: date | str | None, end: date | str | None, day: str = "timestamp") -> DataFrame:
    """Rows of the days from start to end, both included; the condition reaches the scan."""
    if start is not None:
        df = df.where(F.to_date(day) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.to_date(day) <= F.lit(end).cast("date"))


def joined_panel(prices: DataFrame, features: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """A panel with feature tables joined by symbol and time; rows without features stay. Features must be unique by the keys.

    A feature whose name the panel has already is left out of the feature table.
    """
    for f in features:
        new = [c for c in f.columns if c in keys or c not in prices.columns]
        prices = prices.join(f.select(*new), list(keys), "left")
    return prices


def as_of(facts: DataFrame, day: date | str, entity: str = "symbol", field: str = "field_name", period: str = "period_end", published: str = "published_at", value: str = "value") -> DataFrame:
    """The latest known value per entity and field on a day: published by then, of the latest period; of restatements the first."""
    known = facts.where((F.to_date(published) <= F.lit(day).cast("date")) & (F.col(period) <= F.lit(day).cast("date")))
    w = Window.partitionBy(entity, field).orderBy(F.col(period).desc(), F.col(published), F.col(value))
    return known.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def missing_ranges(stored: DataFrame, wanted: DataFrame, start: date | str, end: date | str, slack_days: int = 3, symbol: str = "symbol", day: str = "timestamp") -> DataFrame:
    """Symbols of `wanted` whose stored rows do not cover the range (the end with some slack)."""
    have = stored.groupBy(symbol).agg(F.to_date(F.min(day)).alias("a"), F.to_date(F.max(day)).alias("b"))
    done = have.where((F.col("a") <= F.lit(start).cast("date")) & (F.col("b") >= F.date_sub(F.lit(end).cast("date"), slack_days)))
    return wanted.select(symbol).distinct().join(done, symbol, "left_anti")


def nearest_events(calendar: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, kinds: Sequence[str], kind: str) -> DataFrame:
    """For each calendar row and kind of event, the next event on or after the day and the last one on or before it.

    Events are put among the calendar's days and carried along the keys, so there is no range join: columns next_<kind>
    and prev_<kind>. Calendar rows must be unique; kinds without an event give NULL.
    """
    days = calendar.select(*keys, F.col(day).alias("d_"), F.lit(1).alias("c_"), *[F.lit(None).cast("date").alias(f"e_{k}") for k in kinds])
    marks = events.where(F.col(kind).isin(*kinds) & F.col(event_day).isNotNull()).select(*keys, F.col(event_day).alias("d_"), F.lit(0).alias("c_"), *[F.when(F.col(kind) == k, F.col(event_day)).alias(f"e_{k}") for k in kinds])
    back = Window.partitionBy(*keys).orderBy("d_", "c_").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("d_").desc(), "c_").rowsBetween(Window.unboundedPreceding, 0)
    both = days.unionAll(marks.distinct())
    both = both.withColumns({f"prev_{k}": F.last(f"e_{k}", True).over(back) for k in kinds}).withColumns({f"next_{k}": F.last(f"e_{k}", True).over(ahead) for k in kinds})
    return both.where("c_ = 1").select(*keys, F.col("d_").alias(day), *[f"{p}_{k}" for k in kinds for p in ("next", "prev")])
