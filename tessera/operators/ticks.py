"""Ticks to features: quotes carried forward, trades signed, daily and first-hour features, manifests and checks.

Ticks are shuffled once, by source, trading day and hour, so a crowded day is many tasks: the last quotes and trades are
carried forward within an hour, and what an hour begins with comes from the few rows of hourly last values. One aggregation
by minute follows in the same partitions; all that comes after works on minutes. Ties in time go by tick id, so results do
not depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safe import divide

KEYS = ("stock_code", "trading_date")


def load_ticks(ticks: DataFrame, kinds: Sequence[str], symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None, scope: str = "target", limit: int | None = None) -> DataFrame:
    """Ticks of some kinds, symbols and days in order of symbol and time; a limit is a top-k, not a sort of everything."""
    if not kinds or (limit is not None and limit <= 0):
        raise ValueError("kinds must be given and a limit be positive")
    out = ticks.where((F.col("scope") == scope) & F.col("event_type").isin(*kinds))
    if symbols is not None:
        out = out.where(F.col("stock_code").isin(*symbols))
    if start is not None:
        out = out.where(F.col("trading_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("trading_date") <= F.lit(end).cast("date"))
    out = out.orderBy("stock_code", "time", "tick_id")
    out = out if limit is None else out.limit(limit)
    return out.select(
        F.col("stock_code").alias("symbol"), F.col("time").alias("timestamp"), "event_type", F.col("value").alias("price"), "size", "condition_codes", "exchange_code", "trade_time", "hk_time",
        "trading_date", "scope", "tick_id",
    )


def usable(ticks: DataFrame, scope: str = "target") -> DataFrame:
    """Ticks of a scope that have a price."""
    rows = ticks.where((F.col("scope") == scope) & (F.col("value") > 0) & ~F.isnan("value"))
    return rows.select(*KEYS, "tick_id", "time", "event_type", F.col("value").alias("price"), F.col("size").cast("double").alias("size"))


def quoted(ticks: DataFrame, scope: str = "target") -> DataFrame:
    """Usable ticks of a scope with the last bid and ask so far that day, the trade price before (`past`), the minute, and the local time of day.

    Ticks without a source or day are left out.
    """
    keyed = usable(ticks, scope).where(" and ".join(f"{k} is not null" for k in KEYS))
    rows = keyed.withColumn("hour", F.date_trunc("hour", "time")).repartition(*KEYS, "hour")
    price = lambda kind: F.when(F.col("event_type") == kind, F.col("price"))
    names = {"bid": "BID", "ask": "ASK", "past": "TRADE"}
    # What each hour begins with. The sizes are kept so that both branches read one exchange.
    at = lambda kind: F.when(F.col("event_type") == kind, F.struct("time", "tick_id"))
    hours = rows.groupBy(*KEYS, "hour").agg(*[F.max_by(price(k), at(k)).alias(n) for n, k in names.items()], F.count("size").alias("n_")).where("n_ >= 0")
    before = Window.partitionBy(*KEYS).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(*[F.col(k).alias(f"c_{k}") for k in (*KEYS, "hour")], *[F.last(n, True).over(before).alias(f"c_{n}") for n in names])
    on = [rows[k].eqNullSafe(carried[f"c_{k}"]) for k in (*KEYS, "hour")]
    w = Window.partitionBy(*KEYS, "hour").orderBy("time", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda n, w: F.coalesce(F.last(price(names[n]), True).over(w), F.col(f"c_{n}"))
    local = F.from_utc_timestamp(F.col("time").cast("timestamp"), "Asia/Hong_Kong")
    out = rows.join(carried, on, "left").withColumns({"bid": last("bid", w), "ask": last("ask", w), "past": last("past", w.rowsBetween(Window.unboundedPreceding, -1))})
    return out.withColumns({"minute": F.date_trunc("minute", F.col("time")), "minute_of_day": F.hour(local) * 60 + F.minute(local)}).drop(*[f"c_{c}" for c in (*KEYS, "hour", *names)])


def signed(quotes: DataFrame) -> DataFrame:
    """Ticks with `trade`, `quoted` (the quotes are usable) and, of trades, the signed size: by the quote, at the mid or without a quote by the tick test."""
    t = quotes.withColumns({
        "trade": F.col("event_type") == "TRADE", "quoted": F.coalesce(F.col("ask") > F.col("bid"), F.lit(False)), "mid": (F.col("bid") + F.col("ask")) / 2, "step": F.col("price") - F.col("past"),
    })
    by_tick = F.signum(F.coalesce("step", F.lit(0.0))) * F.col("size")
    by_quote = F.when(F.col("price") > F.col("mid"), F.col("size")).when(F.col("price") < F.col("mid"), -F.col("size")).otherwise(by_tick)
    return t.withColumn("signed_size", F.when(F.col("trade"), F.when(F.col("quoted"), by_quote).otherwise(by_tick)))


def by_minute(ticks: DataFrame) -> DataFrame:
    """One row per source, day and minute: trades, sizes, signed sizes, spreads, quotes, the last trade price. In the partitions of `ticks` (see quoted)."""
    trade, quote = F.col("trade"), F.col("event_type").isin("BID", "ASK")
    spread, of = _spread(F.col("quoted")), lambda cond, c: F.when(cond, c)
    return ticks.groupBy(*KEYS, "hour", "minute", "minute_of_day").agg(
        F.count_if(trade).alias("trades"), F.sum(of(trade, F.col("size"))).alias("size"), F.count(of(trade, F.col("size"))).alias("sized"), F.sum("signed_size").alias("signed"),
        F.sum(of(trade, spread)).alias("trade_spread"), F.count(of(trade, spread)).alias("trade_spreads"), F.count_if(quote).alias("quotes"),
        F.sum(of(quote, spread)).alias("quote_spread"), F.count(of(quote, spread)).alias("quote_spreads"), F.max_by(of(trade, F.col("price")), of(trade, F.struct("time", "tick_id"))).alias("px"),
    )


def minute_prices(ticks: DataFrame) -> DataFrame:
    """The last trade price of each minute that has one, from usable ticks: a map-side reduction, whatever the source holds."""
    t = ticks.where("event_type = 'TRADE'")
    return t.groupBy(*KEYS, F.date_trunc("minute", F.col("time")).alias("minute")).agg(F.max_by("price", F.struct("time", "tick_id")).alias("px"))


def with_returns(minutes: DataFrame) -> DataFrame:
    """Minutes with `r2`, the squared log return of the last trade price since the minute before that has one."""
    past = F.last("px", True).over(Window.partitionBy(*KEYS).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1))
    return minutes.withColumn("r2", F.pow(F.ln(F.try_divide(F.col("px"), past)), 2))


def realized_vol(minutes: DataFrame, name: str = "realized_vol") -> DataFrame:
    """The root of the summed squared log returns from minute to minute, per day; NULL with one minute only."""
    return with_returns(minutes).groupBy(*KEYS).agg(F.sqrt(F.sum("r2")).alias(name))


def calendar(prices: DataFrame) -> DataFrame:
    """Every source and day of a price table once."""
    return prices.select("stock_code", F.col("date").alias("trading_date")).distinct()


def _spread(quoted_: Column) -> Column:
    return F.when(quoted_, (F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2))


def daily_features(ticks: DataFrame, days: DataFrame) -> DataFrame:
    """Per day of the calendar: trades, volume, mean size, order-flow imbalance, relative spread, realised volatility, quotes.

    Days without ticks have NULL features. NULL sizes count as trades but not in sums.
    """
    m = with_returns(by_minute(signed(quoted(ticks))))
    n = F.sum("trades")
    day = m.groupBy(*KEYS).agg(
        F.nullif(n, F.lit(0)).alias("n_trades"), F.sum("size").alias("tick_volume"), F.try_divide(F.sum("size"), F.sum("sized")).alias("avg_trade_size"), divide(F.sum("signed"), F.sum("size")).alias("ofi"),
        F.try_divide(F.sum("trade_spread"), F.sum("trade_spreads")).alias("rel_spread"), F.sqrt(F.sum("r2")).alias("realized_vol"), F.nullif(F.sum("quotes"), F.lit(0)).alias("n_quotes"),
    )
    return days.join(day, list(KEYS), "left").select(*KEYS, "n_trades", "tick_volume", "avg_trade_size", "ofi", "rel_spread", "realized_vol", "n_quotes")


#: Fixed values, minutes after midnight: the opening auction and the first hour of the session.
AUCTION, FIRST_HOUR = (540, 570), (570, 630)


def intraday_features(ticks: DataFrame, days: DataFrame, trailing: int = 20) -> DataFrame:
    """Per day of the calendar: first-hour features, the auction's share of volume, trailing baselines (without the day), shocks."""
    within = lambda span: (F.col("minute_of_day") >= span[0]) & (F.col("minute_of_day") < span[1])
    hour = within(FIRST_HOUR)
    m = by_minute(signed(quoted(ticks)))
    # Returns within the first hour: prices before it do not count.
    m = with_returns(m.withColumn("px", F.when(hour, F.col("px"))))
    first = lambda c: F.sum(F.when(hour, F.col(c)))
    day = m.groupBy(*KEYS).agg(
        F.sum("size").alias("all_"), F.sum(F.when(within(AUCTION), F.col("size"))).alias("auction_"), F.nullif(first("trades"), F.lit(0)).alias("first_hour_n_trades"),
        first("size").alias("first_hour_tick_volume"), divide(first("signed"), first("size")).alias("first_hour_ofi"), first("quotes").alias("first_hour_n_quotes"),
        F.try_divide(first("quote_spread"), first("quote_spreads")).alias("first_hour_rel_spread"), F.sqrt(first("r2")).alias("first_hour_realized_vol"),
    )
    out = days.join(day, list(KEYS), "left")
    past = Window.partitionBy("stock_code").orderBy("trading_date").rowsBetween(-trailing, -1)
    out = out.withColumns({
        "opening_auction_trade_share": divide(F.col("auction_"), F.col("all_")),
        "prior_rel_spread": F.avg("first_hour_rel_spread").over(past), "prior_tick_volume": F.avg("first_hour_tick_volume").over(past),
    })
    return out.select(
        *KEYS, "first_hour_n_trades", "first_hour_tick_volume", "first_hour_ofi", "first_hour_rel_spread", "first_hour_realized_vol", "first_hour_n_quotes", "opening_auction_trade_share",
        "prior_rel_spread", "prior_tick_volume", (divide(F.col("first_hour_rel_spread"), F.col("prior_rel_spread")) - 1).alias("spread_shock"),
        (1 - divide(F.col("first_hour_tick_volume"), F.col("prior_tick_volume"))).alias("liquidity_withdrawal"),
    )


def manifest(ticks: DataFrame, scope: str = "target") -> DataFrame:
    """One row per source of a scope: days, rows by kind, unusable values and sizes, first and last event."""
    kind = F.col("event_type")
    return ticks.where(F.col("scope") == scope).groupBy("scope", "stock_code").agg(
        F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count_distinct("trading_date").alias("trading_days"), F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(kind == k).alias(f"{k.lower()}_rows") for k in ("TRADE", "BID", "ASK")], F.count_if(~kind.isin("TRADE", "BID", "ASK")).alias("other_rows"),
        F.count_if((F.col("value") <= 0) | F.col("value").isNull()).alias("nonpositive_value_rows"), F.count_if(F.col("size") < 0).alias("invalid_size_rows"),
        F.min("time").alias("first_event_utc"), F.max("time").alias("last_event_utc"),
    )


def nonpositive_report(ticks: DataFrame, scope: str = "target") -> DataFrame:
    """Rows without a positive value per source, day and kind, the worst first."""
    bad = ticks.where((F.col("scope") == scope) & ((F.col("value") <= 0) | F.col("value").isNull()))
    out = bad.groupBy(*KEYS, "event_type").agg(F.count(F.lit(1)).alias("nonpositive_value_rows"))
    return out.orderBy(F.col("nonpositive_value_rows").desc(), *KEYS, "event_type")


def feature_checks(features: DataFrame, empty: Sequence[str], end: str) -> DataFrame:
    """One row of acceptance counts: rows, sources, range of days, rows after the end, repeated keys, rows without any feature."""
    keyed = features.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_"), F.count_if(F.coalesce(*empty).isNull()).alias("none_"))
    return keyed.agg(
        F.sum("n_").alias("row_count"), F.count_distinct("stock_code").alias("stock_count"), F.min("trading_date").alias("min_date"), F.max("trading_date").alias("max_date"),
        F.sum(F.when(F.col("trading_date") > F.lit(end).cast("date"), F.col("n_")).otherwise(0)).alias("post_end_rows"), F.sum(F.col("n_") - 1).alias("duplicate_key_rows"), F.sum("none_").alias("no_feature_rows"),
    )


def minute_bars(ticks: DataFrame) -> DataFrame:
    """Minute bars of trades per source: open, high, low, close, volume, number of trades."""
    t = ticks.where("event_type = 'TRADE' and value > 0 and not isnan(value)")
    at = F.struct("time", "tick_id")
    return t.groupBy("stock_code", F.date_trunc("minute", F.col("time")).alias("minute")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades")
    )
