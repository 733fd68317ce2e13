"""What the query modules share: the panel with a signal, the same in SQL, and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expression import with_factors
from tessera.operators import evaluate, panel
from tessera.tables import table

#: The signal that the evaluation queries use.
SIGNAL = "ts_mean(volume, 5) / ts_mean(volume, 20)"
#: A fixed list of expressions for queries over several factors.
FACTORS = {
    "f1": "ts_mean(volume, 5) / ts_mean(volume, 20)", "f2": "-ts_delta(close, 5) / lag(close, 5)", "f3": "ts_std(close, 10) / ts_mean(close, 10)", "f4": "(high - low) / close",
}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of summation does not show; minus 0 is 0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return panel.daily_panel(table(spark, folder, "ipo_daily_prices"))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with the signal and the next day's return, beginning a day ahead."""
    return evaluate.with_forward(with_factors(bars(spark, folder), {"signal": SIGNAL}))


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    """The sector of each stock's last registration."""
    m = table(spark, folder, "ipo_master").where("stock_code is not null")
    return m.groupBy(F.col("stock_code").alias("symbol")).agg(F.max_by("sector", F.struct("registered_at_utc", F.coalesce("sector", F.lit("")))).alias("sector"))


PANEL = """panel as (
  select stock_code as symbol, date as timestamp, px_open as open, px_high as high, px_low as low, px_last as close, volume, weighted_avg_px as vwap
  from ipo_daily_prices where stock_code is not null and date is not null
  qualify row_number() over (partition by stock_code, date order by loaded_at_utc desc, row_id desc) = 1)"""
SIGNALS = (
    PANEL
    + """, sig as (
  select *, avg(volume) over (partition by symbol order by timestamp rows 4 preceding)
    / nullif(avg(volume) over (partition by symbol order by timestamp rows 19 preceding), 0) as signal from panel),
lab as (
  select *, lead(close, 2) over w / nullif(lead(close, 1) over w, 0) - 1 as fwd from sig window w as (partition by symbol order by timestamp))"""
)
FACTORS_SQL = (
    PANEL
    + """, fac as (
  select symbol, timestamp, close,
    avg(volume) over (w rows 4 preceding) / nullif(avg(volume) over (w rows 19 preceding), 0) as f1,
    -(close - lag(close, 5) over w) / nullif(lag(close, 5) over w, 0) as f2,
    stddev_samp(close) over (w rows 9 preceding) / nullif(avg(close) over (w rows 9 preceding), 0) as f3,
    (high - low) / nullif(close, 0) as f4
  from panel window w as (partition by symbol order by timestamp))"""
)


def rank_sql(x: str, by: str = "timestamp") -> str:
    """The mean rank among rows that have a value, for SQL."""
    return f"(rank() over (partition by {by}, ({x}) is null order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0)"


def rank_ic_sql(source: str, by: str = "timestamp", signal: str = "signal", ret: str = "fwd", keep: str = "") -> str:
    """A subquery of the rank-IC per time, for SQL; `keep` are columns that go along."""
    return f"""(select {by}{keep}, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) as ic, count(*) n from (
    select {by}{keep}, {rank_sql(signal, by)} a, {rank_sql(ret, by)} b from {source} where {signal} is not null and {ret} is not null)
    group by {by}{keep} having count(*) >= 3 and stddev_samp(a) > 0 and stddev_samp(b) > 0)"""


def ic_sql(source: str, by: str = "timestamp", signal: str = "signal", ret: str = "fwd") -> str:
    return f"""(select {by}, covar_samp({signal}, {ret}) / nullif(stddev_samp({signal}) * stddev_samp({ret}), 0) as ic from {source}
    where {signal} is not null and {ret} is not null group by {by} having count(*) >= 3 and stddev_samp({signal}) > 0 and stddev_samp({ret}) > 0)"""


def long_short_sql(source: str, by: str = "timestamp") -> str:
    """A subquery of the long-short return per time, for SQL (quintiles)."""
    edges = ", ".join(f"quantile_cont(signal, {i / 5})" for i in range(6))
    return f"""(select {by}, avg(fwd) filter (signal > hi) - avg(fwd) filter (signal <= lo) as ret from (
      select l.*, e[len(e) - 1] as hi, e[2] as lo from {source} l join (
        select {by}, list_sort(list_distinct([{edges}])) as e from {source} where signal is not null and fwd is not null group by {by} having count(*) >= 5
      ) q using ({by}) where len(e) >= 3 and signal is not null and fwd is not null)
    group by {by} having avg(fwd) filter (signal > hi) - avg(fwd) filter (signal <= lo) is not null)"""
