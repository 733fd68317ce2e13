"""Queries of the tick and event pipelines, event studies and data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, events, panel, ticks
from tessera.plans.common import PANEL, bars, rounded
from tessera.tables import table

END = "2026-05-29"
FAMILIES = {"cornerstone": "cornerstone_lockup_expiry", "greenshoe": "greenshoe_expiry", "stabilization_end": "stabilization_end", "unlock": "pre_ipo_investor_unlock"}


def _ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tick_events_ext")


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return ticks.calendar(table(spark, folder, "ipo_daily_prices"))


def load_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 bids and asks of November in order of stock and time (a limit of the loader)."""
    return ticks.load_ticks(_ticks(spark, folder), ["BID", "ASK"], start="2025-11-01", end="2025-11-30", limit=500).select("symbol", "timestamp", "event_type", "price", "size", "tick_id")


def load_ticks_all(spark: SparkSession, folder: str) -> DataFrame:
    """All trades, bids and asks of the target scope in order of stock and time: the loader without limit and dates."""
    return ticks.load_ticks(_ticks(spark, folder), ["TRADE", "BID", "ASK"]).select("symbol", "timestamp", "event_type", "price", "size", "tick_id")


def micro_features_daily(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ticks.daily_features(_ticks(spark, folder), _days(spark, folder)))


def intraday_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ticks.intraday_features(_ticks(spark, folder), _days(spark, folder)))


def minute_last_price(spark: SparkSession, folder: str) -> DataFrame:
    return ticks.minute_prices(ticks.usable(_ticks(spark, folder)))


def realized_vol(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ticks.realized_vol(minute_last_price(spark, folder)))


def minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    return ticks.minute_bars(_ticks(spark, folder))


def tick_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return ticks.manifest(_ticks(spark, folder))


def tick_qa(spark: SparkSession, folder: str) -> DataFrame:
    return ticks.nonpositive_report(_ticks(spark, folder))


def post_qa(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptance counts of the stored daily features."""
    stored = table(spark, folder, "micro_features_daily")
    return ticks.feature_checks(stored, ["n_trades", "tick_volume", "avg_trade_size", "ofi", "rel_spread", "realized_vol", "n_quotes"], END)


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ipo_event_terms_curated")


def curate_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the latest run with the first reason to look at them again, if there is one."""
    run = events.latest_run(_terms(spark, folder))
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = events.first_reason({"missing_date": F.col("event_date").isNull(), "missing_url": empty("source_url"), "missing_doc": empty("source_doc_id"), "missing_text": empty("source_text"), "low_confidence": F.col("confidence") < 0.5})
    return run.select("term_id", reason.alias("reason"))


def curated_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms without a rejected one of the same stock, kind, date and document."""
    t = _terms(spark, folder)
    rejected = t.where("event_date is null or source_url is null or source_url = ''")
    return events.without_rejected(t, rejected, ["stock_code", "event_type", "event_date", "source_doc_id"]).select("term_id", "stock_code", "event_type", "event_date")


def curate_dates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.event_dates(_terms(spark, folder)))


def event_features(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "ipo_daily_prices").select("stock_code", "date").distinct()
    return events.event_features(days, table(spark, folder, "ipo_event_dates_curated"), FAMILIES)


def next_event_days(spark: SparkSession, folder: str) -> DataFrame:
    """The next and the last lock-up expiry of each bar."""
    days = table(spark, folder, "ipo_daily_prices").select("stock_code", "date").distinct()
    k = "cornerstone_lockup_expiry"
    near = panel.nearest_events(days, table(spark, folder, "ipo_event_dates_curated"), ["stock_code"], "date", "event_date", [k], "event_type")
    return near.select("stock_code", "date", F.col(f"next_{k}").alias("next_date"), F.col(f"prev_{k}").alias("prev_date"))


def panel_join(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with the last loaded micro features of the day."""
    from tessera.operators.rolling import last_loaded

    features = ["n_trades", "ofi", "rel_spread"]
    micro = last_loaded(table(spark, folder, "micro_features_daily").where("stock_code is not null and trading_date is not null"), ["stock_code", "trading_date"], features, ["loaded_at_utc", "row_id"])
    micro = micro.withColumnsRenamed({"stock_code": "symbol", "trading_date": "timestamp"})
    return rounded(panel.joined_panel(bars(spark, folder), [micro]).select("symbol", "timestamp", "close", *features))


def scan_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of a date range and a few stocks: both conditions reach the scan."""
    prices = table(spark, folder, "ipo_daily_prices").where(F.col("stock_code") >= "00300")
    return rounded(panel.between(panel.daily_panel(prices), "2025-12-01", "2025-12-31"))


def scan_bars_all(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of all stocks and days."""
    return rounded(panel.between(panel.daily_panel(table(spark, folder, "ipo_daily_prices")), None, None))


def universe_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of stocks registered and live, by a semi join."""
    live = table(spark, folder, "ipo_master").where("deleted_at_utc is null").select(F.col("stock_code").alias("symbol")).distinct()
    return bars(spark, folder).join(live, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


def backfill_missing(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "ipo_master").select(F.col("stock_code").alias("symbol"))
    return panel.missing_ranges(bars(spark, folder), wanted, "2025-11-03", "2026-06-26")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with two times: the last run's dates of event as periods, published when curated."""
    t = _terms(spark, folder)
    return t.select(F.col("stock_code").alias("symbol"), F.col("event_type").alias("field_name"), F.col("confidence").alias("value"), F.col("event_date").alias("period_end"), F.col("curated_at_utc").alias("published_at"), "term_id")


def fundamentals_asof(spark: SparkSession, folder: str) -> DataFrame:
    return panel.as_of(_facts(spark, folder), "2026-01-15", value="term_id").select("symbol", "field_name", "period_end", "published_at", "term_id")


def fundamentals_range(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.sources.readers import read_facts

    symbols = [f"{i:05d}" for i in range(0, 500)]
    return read_facts(_facts(spark, folder), symbols, ["listing_date", "pricing_date"], "2025-06-01", "2025-12-31").select("symbol", "field_name", "period_end", "term_id")


def fundamentals_all(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all kinds and dates of every registered stock."""
    from tessera.sources.readers import read_facts

    symbols = table(spark, folder, "ipo_master").select(F.col("stock_code").alias("symbol"))
    return read_facts(_facts(spark, folder), symbols).select("symbol", "field_name", "period_end", "term_id")


def key_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Stock-days that only the price table or only the feature table has."""
    prices = table(spark, folder, "ipo_daily_prices").select("stock_code", F.col("date").alias("day"))
    micro = table(spark, folder, "micro_features_daily").select("stock_code", F.col("trading_date").alias("day"))
    return events.unmatched_keys(prices, micro, ["stock_code", "day"], ("prices", "features"))


def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, stocks and days of each dated table."""
    out = None
    for name, day in (("ipo_daily_prices", "date"), ("micro_features_daily", "trading_date"), ("ipo_event_dates_curated", "event_date")):
        part = table(spark, folder, name).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("stock_code").alias("stocks"), F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def truth_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of the event dates: rows that fail each, the state of each, and the worst of all."""
    def dates() -> DataFrame:
        return table(spark, folder, "ipo_event_dates_curated")

    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    count = lambda condition: lambda: dates().agg(F.count_if(condition).alias("failed"))
    keys = ["stock_code", "event_type", "event_date"]
    repeated = lambda: dates().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("failed"))
    orphan = lambda: dates().join(table(spark, folder, "ipo_master").select("stock_code").distinct(), "stock_code", "left_anti").agg(F.count(F.lit(1)).alias("failed"))
    return events.audit(spark, {
        "no_document": (False, count(empty("primary_source_doc_id"))), "no_date": (True, count(F.col("event_date").isNull())), "before_listing": (False, count(F.col("days_from_listing") < 0)),
        "repeated_key": (True, repeated), "negative_terms": (True, count(F.col("term_count") < 0)), "unknown_stock": (False, orphan), "column_gone": (True, count(F.col("no_such_column") > 0)),
    })


def _study(spark: SparkSession, folder: str, shift: int = 0, whole: bool = False, before: int = 10, after: int = 10) -> DataFrame:
    b = bars(spark, folder)
    over = evaluate.Window.partitionBy("symbol").orderBy("timestamp")
    r = b.select("symbol", "timestamp", (F.try_divide(F.col("close"), F.lag("close").over(over)) - 1).alias("r"))
    market = r.groupBy("timestamp").agg(F.avg("r").alias("m"))
    ar = r.join(market, "timestamp").select("symbol", "timestamp", (F.col("r") - F.col("m")).alias("ar"))
    return events.event_window(ar, plausible_events(spark, folder).withColumnRenamed("stock_code", "symbol"), before, after, shift=shift, whole=whole)


def plausible_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lock-up expiries once per stock and date, at least 30 days from listing where that is known."""
    e = table(spark, folder, "ipo_event_dates_curated").where("event_type = 'cornerstone_lockup_expiry' and event_date is not null and (days_from_listing is null or days_from_listing >= 30)")
    return e.groupBy("stock_code", "event_date").agg(F.min("row_id").alias("event_id"))


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_study(spark, folder).select("symbol", "event_id", "tau", "timestamp", "ar"))


def car_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.profile_by_tau(_study(spark, folder)))


def per_event_car(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.cumulated(_study(spark, folder)))


def placebo_car(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.cumulated(_study(spark, folder, -40, True)))


def event_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.t_statistic(events.cumulated(_study(spark, folder)).where("car is not null"), "car"))


def _car_float(spark: SparkSession, folder: str) -> DataFrame:
    free = table(spark, folder, "ipo_daily_prices").groupBy(F.col("stock_code").alias("symbol")).agg(F.median("free_float_pct").alias("free_float"))
    return events.cumulated(_study(spark, folder)).where("car is not null").join(free, "symbol")


def freefloat_split(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.median_split(_car_float(spark, folder), "free_float", "car"))


def welch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.welch(_car_float(spark, folder), "car", F.col("free_float") > 20))


QUERIES = {
    f.__name__: f for f in (
        load_ticks, load_ticks_all, micro_features_daily, intraday_features, minute_last_price, realized_vol, minute_bars, tick_manifest, tick_qa, post_qa, curate_terms, curated_terms, curate_dates, event_features,
        next_event_days, panel_join, scan_bars, scan_bars_all, universe_filter, backfill_missing, fundamentals_asof, fundamentals_range, fundamentals_all, key_alignment, coverage_counts, truth_audit, plausible_events, event_panel,
        car_profile, per_event_car, placebo_car, event_stats, freefloat_split, welch,
    )
}

_R = lambda x, n=6: f"round({x}, {n}) + 0.0"
_K = "partition by stock_code, trading_date order by time, tick_id"
_TICKS = f"""
ev as (select *, value as price, size::double as sz, extract(hour from time + interval 8 hour) * 60 + extract(minute from time + interval 8 hour) as mod from tick_events_ext where scope = 'target' and value > 0 and not isnan(value)),
q as (select *, last_value(case when event_type = 'BID' then price end ignore nulls) over ({_K} rows unbounded preceding) as bid,
  last_value(case when event_type = 'ASK' then price end ignore nulls) over ({_K} rows unbounded preceding) as ask from ev),
t0 as (select *, (bid + ask) / 2 as mid, price - lag(price) over ({_K}) as dpx, coalesce(ask > bid, false) as ok from q where event_type = 'TRADE'),
t as (select *, case when ok and price > mid then sz when ok and price < mid then -sz else sign(coalesce(dpx, 0)) * sz end as signed from t0),
cal as (select distinct stock_code, date as trading_date from ipo_daily_prices)"""
_MINUTES = "select stock_code, trading_date, date_trunc('minute', time) as minute, arg_max(price, (time, tick_id)) as px from t {0} group by 1, 2, 3"
_VOL = """select stock_code, trading_date, sqrt(sum(pow(ln(px / lag_px), 2))) as v from (
  select *, lag(px) over (partition by stock_code, trading_date order by minute) lag_px from ({0})) group by 1, 2"""
_NEAREST = lambda kind, op, f: f"(select {f}(event_date) from ipo_event_dates_curated e where e.stock_code = c.stock_code and e.event_type = '{kind}' and e.event_date {op} c.date)"


def _features_sql() -> str:
    cols = []
    for name, kind in FAMILIES.items():
        n, p = f"date_diff('day', c.date, {_NEAREST(kind, '>=', 'min')})", f"date_diff('day', {_NEAREST(kind, '<=', 'max')}, c.date)"
        cols += [f"{n} as days_to_next_{name}", f"{p} as days_since_prev_{name}", f"case when {n} between 0 and 5 then 1 else 0 end as is_pre_{name}", f"case when {n} <= 5 or {p} <= 5 then 1 else 0 end as is_near_{name}"]
    return f"select c.stock_code, c.date, {', '.join(cols)} from (select distinct stock_code, date from ipo_daily_prices) c"


_STUDY = f"""with {PANEL}, r as (select symbol, timestamp, close / nullif(lag(close) over (partition by symbol order by timestamp), 0) - 1 as r, row_number() over (partition by symbol order by timestamp) rn from panel),
ar as (select *, r - avg(r) over (partition by timestamp) as ar from r),
ev as (select stock_code as symbol, event_date, min(row_id) as event_id from ipo_event_dates_curated
  where event_type = 'cornerstone_lockup_expiry' and event_date is not null and (days_from_listing is null or days_from_listing >= 30) group by 1, 2),
e0 as (select symbol, event_id, (select min(rn) from r where r.symbol = ev.symbol and r.timestamp >= ev.event_date) as rn0 from ev),
w as (select e0.symbol, event_id, rn - rn0 as tau, timestamp, ar from e0 join ar on ar.symbol = e0.symbol and rn between rn0 - 10 and rn0 + 10),
car as (select symbol, event_id, sum(ar) as car, count(ar) as n from w where tau between -1 and 3 group by 1, 2)"""
_FLOAT = ", ff as (select stock_code as symbol, median(free_float_pct) as free_float from ipo_daily_prices group by 1), cf as (select * from car join ff using (symbol) where car is not null)"

SQL = {
    "load_ticks": """select stock_code as symbol, time as timestamp, event_type, value as price, size, tick_id from tick_events_ext where scope = 'target' and event_type in ('BID', 'ASK')
  and trading_date between date '2025-11-01' and date '2025-11-30' order by stock_code, time, tick_id limit 500""",
    "load_ticks_all": "select stock_code as symbol, time as timestamp, event_type, value as price, size, tick_id from tick_events_ext where scope = 'target' and event_type in ('TRADE', 'BID', 'ASK') order by stock_code, time, tick_id",
    "micro_features_daily": f"""with {_TICKS},
f as (select stock_code, trading_date, count(*) as n_trades, sum(sz) as tick_volume, avg(sz) as avg_trade_size, sum(signed) / nullif(sum(sz), 0) as ofi, avg(case when ok then (ask - bid) / mid end) as rel_spread from t group by 1, 2),
v as ({_VOL.format(_MINUTES.format(''))}), n as (select stock_code, trading_date, count(*) as n_quotes from ev where event_type in ('BID', 'ASK') group by 1, 2)
select stock_code, trading_date, n_trades, {_R('tick_volume')} as tick_volume, {_R('avg_trade_size')} as avg_trade_size, {_R('ofi')} as ofi, {_R('rel_spread')} as rel_spread, {_R('v')} as realized_vol, n_quotes
from cal left join f using (stock_code, trading_date) left join v using (stock_code, trading_date) left join n using (stock_code, trading_date)""",
    "intraday_features": f"""with {_TICKS},
f as (select stock_code, trading_date, sum(sz) as al, sum(sz) filter (mod >= 540 and mod < 570) as au, nullif(count(*) filter (h), 0) as n, sum(sz) filter (h) as vol, sum(signed) filter (h) / nullif(sum(sz) filter (h), 0) as ofi
  from (select *, mod >= 570 and mod < 630 as h from t) group by 1, 2),
k as (select stock_code, trading_date, count(*) filter (event_type in ('BID', 'ASK')) as nq, avg(case when event_type in ('BID', 'ASK') and ask > bid then (ask - bid) / ((bid + ask) / 2) end) as sp from q where mod >= 570 and mod < 630 group by 1, 2),
v as ({_VOL.format(_MINUTES.format('where mod >= 570 and mod < 630'))}),
j as (select stock_code, trading_date, n, vol, ofi, sp, v, nq, au / nullif(al, 0) as share from cal left join f using (stock_code, trading_date) left join k using (stock_code, trading_date) left join v using (stock_code, trading_date)),
b as (select *, avg(sp) over w psp, avg(vol) over w pv from j window w as (partition by stock_code order by trading_date rows between 20 preceding and 1 preceding))
select stock_code, trading_date, n as first_hour_n_trades, {_R('vol')} as first_hour_tick_volume, {_R('ofi')} as first_hour_ofi, {_R('sp')} as first_hour_rel_spread, {_R('v')} as first_hour_realized_vol, nq as first_hour_n_quotes,
  {_R('share')} as opening_auction_trade_share, {_R('psp')} as prior_rel_spread, {_R('pv')} as prior_tick_volume, {_R('sp / nullif(psp, 0) - 1')} as spread_shock, {_R('1 - vol / nullif(pv, 0)')} as liquidity_withdrawal from b""",
    "minute_last_price": f"with {_TICKS} {_MINUTES.format('')}",
    "realized_vol": f"with {_TICKS} select stock_code, trading_date, {_R('v')} as realized_vol from ({_VOL.format(_MINUTES.format(''))})",
    "minute_bars": """select stock_code, date_trunc('minute', time) as minute, arg_min(value, (time, tick_id)) as open, max(value) as high, min(value) as low, arg_max(value, (time, tick_id)) as close,
  sum(size)::bigint as volume, count(*) as trades from tick_events_ext where event_type = 'TRADE' and value > 0 and not isnan(value) group by 1, 2""",
    "tick_manifest": """select scope, stock_code, min(trading_date) as first_date, max(trading_date) as last_date, count(distinct trading_date) as trading_days, count(*) as total_rows, count(*) filter (event_type = 'TRADE') as trade_rows,
  count(*) filter (event_type = 'BID') as bid_rows, count(*) filter (event_type = 'ASK') as ask_rows, count(*) filter (event_type not in ('TRADE', 'BID', 'ASK')) as other_rows,
  count(*) filter (value <= 0 or value is null) as nonpositive_value_rows, count(*) filter (size < 0) as invalid_size_rows, min(time) as first_event_utc, max(time) as last_event_utc
  from tick_events_ext where scope = 'target' group by 1, 2""",
    "tick_qa": "select stock_code, trading_date, event_type, count(*) as nonpositive_value_rows from tick_events_ext where scope = 'target' and (value <= 0 or value is null) group by 1, 2, 3",
    "post_qa": f"""with d as (select stock_code, trading_date, count(*) n, count(*) filter (coalesce(n_trades, tick_volume, avg_trade_size, ofi, rel_spread, realized_vol, n_quotes) is null) z from micro_features_daily group by 1, 2)
select sum(n)::bigint as row_count, count(distinct stock_code) as stock_count, min(trading_date) as min_date, max(trading_date) as max_date, coalesce(sum(n) filter (trading_date > date '{END}'), 0)::bigint as post_end_rows,
  sum(n - 1)::bigint as duplicate_key_rows, sum(z)::bigint as no_feature_rows from d""",
    "curate_terms": """select term_id, case when event_date is null then 'missing_date' when source_url is null or source_url = '' then 'missing_url' when source_doc_id is null or source_doc_id = '' then 'missing_doc'
  when source_text is null or source_text = '' then 'missing_text' when confidence < 0.5 then 'low_confidence' end as reason from ipo_event_terms_curated where run_id = (select max(run_id) from ipo_event_terms_curated)""",
    "curated_terms": """select term_id, stock_code, event_type, event_date from ipo_event_terms_curated t where not exists (select 1 from ipo_event_terms_curated r where (r.event_date is null or r.source_url is null or r.source_url = '')
  and r.stock_code is not distinct from t.stock_code and r.event_type is not distinct from t.event_type and r.event_date is not distinct from t.event_date and r.source_doc_id is not distinct from t.source_doc_id)""",
    "curate_dates": f"""with g as (select * from ipo_event_terms_curated where event_date is not null), l as (select stock_code, min(event_date) as listing_date from g where event_type = 'listing_date' group by 1),
p as (select *, row_number() over (partition by stock_code, event_type, event_date order by source_priority_rank nulls last, confidence desc nulls last, coalesce(source_doc_id, ''), term_id) rn from g),
a as (select stock_code, event_type, event_date, count(*) as term_count, count(distinct party_name) as party_count, sum(shares)::bigint as total_shares, {_R('sum(pct_of_offer)')} as total_pct_of_offer, max(lockup_months) as max_lockup_months,
  {_R('avg(confidence)')} as avg_confidence, {_R('max(confidence)')} as max_confidence from g group by 1, 2, 3)
select md5(concat_ws('|', stock_code, event_type, event_date::varchar)) as event_id, stock_code, event_type, event_date, listing_date, date_diff('day', listing_date, event_date) as days_from_listing, term_count, party_count, total_shares,
  total_pct_of_offer, max_lockup_months, avg_confidence, max_confidence, source_priority as primary_source_priority, source_doc_id as primary_source_doc_id, source_page as primary_source_page
from a left join l using (stock_code) join p using (stock_code, event_type, event_date) where rn = 1""",
    "event_features": _features_sql(),
    "next_event_days": f"select c.stock_code, c.date, {_NEAREST('cornerstone_lockup_expiry', '>=', 'min')} as next_date, {_NEAREST('cornerstone_lockup_expiry', '<=', 'max')} as prev_date from (select distinct stock_code, date from ipo_daily_prices) c",
    "panel_join": f"""with {PANEL}, m as (select * from micro_features_daily where stock_code is not null and trading_date is not null qualify row_number() over (partition by stock_code, trading_date order by loaded_at_utc desc, row_id desc) = 1)
select symbol, timestamp, {_R('close')} as close, n_trades, {_R('ofi')} as ofi, {_R('rel_spread')} as rel_spread from panel left join m on stock_code = symbol and trading_date = timestamp""",
    "scan_bars": f"with {PANEL} select symbol, timestamp, {', '.join(_R(c) + ' as ' + c for c in ('open', 'high', 'low', 'close', 'volume', 'vwap'))} from panel where symbol >= '00300' and timestamp between date '2025-12-01' and date '2025-12-31'",
    "scan_bars_all": f"with {PANEL} select symbol, timestamp, {', '.join(_R(c) + ' as ' + c for c in ('open', 'high', 'low', 'close', 'volume', 'vwap'))} from panel",
    "universe_filter": f"with {PANEL} select symbol, count(*) as bars from panel where symbol in (select stock_code from ipo_master where deleted_at_utc is null) group by 1",
    "backfill_missing": f"""with {PANEL}, h as (select symbol from panel group by 1 having min(timestamp) <= date '2025-11-03' and max(timestamp) >= date '2026-06-23')
select distinct stock_code as symbol from ipo_master where stock_code not in (select symbol from h)""",
    "fundamentals_asof": """select stock_code as symbol, event_type as field_name, event_date as period_end, curated_at_utc as published_at, term_id from ipo_event_terms_curated
where curated_at_utc::date <= date '2026-01-15' and event_date <= date '2026-01-15' qualify row_number() over (partition by stock_code, event_type order by event_date desc, curated_at_utc, term_id) = 1""",
    "fundamentals_range": """select stock_code as symbol, event_type as field_name, event_date as period_end, term_id from ipo_event_terms_curated
where stock_code between '00000' and '00499' and length(stock_code) = 5 and event_type in ('listing_date', 'pricing_date') and event_date between date '2025-06-01' and date '2025-12-31'""",
    "fundamentals_all": "select stock_code as symbol, event_type as field_name, event_date as period_end, term_id from ipo_event_terms_curated where stock_code in (select stock_code from ipo_master)",
    "key_alignment": """with p as (select distinct stock_code, date as day from ipo_daily_prices), m as (select distinct stock_code, trading_date as day from micro_features_daily)
select stock_code, day, 'prices' as only_in from p where not exists (select 1 from m where m.stock_code = p.stock_code and m.day = p.day)
union all select stock_code, day, 'features' as only_in from m where not exists (select 1 from p where m.stock_code = p.stock_code and m.day = p.day)""",
    "coverage_counts": " union all ".join(
        f"""select '{t}' as table_name, count(*) as "rows", count(distinct stock_code) as stocks, min({d}) as first_day, max({d}) as last_day from {t}"""
        for t, d in (("ipo_daily_prices", "date"), ("micro_features_daily", "trading_date"), ("ipo_event_dates_curated", "event_date"))
    ),
    "truth_audit": """with e as (select * from ipo_event_dates_curated),
c as (select 'no_document' as check_name, count(*) filter (primary_source_doc_id is null or primary_source_doc_id = '') as failed, 2 as bad from e union all select 'no_date', count(*) filter (event_date is null), 1 from e
  union all select 'before_listing', count(*) filter (days_from_listing < 0), 2 from e union all select 'repeated_key', coalesce(sum(n - 1), 0)::bigint, 1 from (select count(*) n from e group by stock_code, event_type, event_date)
  union all select 'negative_terms', count(*) filter (term_count < 0), 1 from e union all select 'unknown_stock', count(*), 2 from e where not exists (select 1 from ipo_master m where m.stock_code = e.stock_code)
  union all select 'column_gone', null, 0),
s as (select check_name, failed, case when failed is null then 0 when failed = 0 then 3 else bad end as state from c)
select check_name, failed, ['FAILED', 'BLOCKED', 'REVIEW_REQUIRED', 'PASSED'][state + 1] as status from s
union all select 'all', sum(failed)::bigint, ['FAILED', 'BLOCKED', 'REVIEW_REQUIRED', 'PASSED'][min(state) + 1] from s""",
    "plausible_events": _STUDY + " select symbol as stock_code, event_date, event_id from ev",
    "event_panel": _STUDY + f" select symbol, event_id, tau, timestamp, {_R('ar')} as ar from w",
    "car_profile": _STUDY + f", p as (select tau, avg(ar) as m, count(ar) as n from w group by 1) select tau, {_R('m')} as mean_ar, n, {_R('sum(m) over (order by tau)')} as car from p",
    "per_event_car": _STUDY + f" select symbol, event_id, {_R('car')} as car, n from car",
    "placebo_car": _STUDY
    + f""", s as (select e0.symbol, event_id, rn - rn0 + 40 as tau, ar from e0 join ar on ar.symbol = e0.symbol and rn between rn0 - 50 and rn0 - 30), f as (select symbol, event_id from s group by 1, 2 having count(*) = 21)
select symbol, event_id, {_R('sum(ar)')} as car, count(ar) as n from s join f using (symbol, event_id) where tau between -1 and 3 group by 1, 2""",
    "event_stats": _STUDY + f" select {_R('avg(car)')} as mean, {_R('avg(car) / nullif(stddev_samp(car) / sqrt(count(car)), 0)')} as t, count(car) as n from car where car is not null",
    "freefloat_split": _STUDY
    + _FLOAT
    + f", k as (select *, case when free_float > (select median(free_float) from cf) then 'high' else 'low' end as side from cf where free_float is not null) select side, {_R('avg(car)')} as mean, {_R('median(car)')} as median, count(car) as n from k group by 1",
    "welch": _STUDY
    + _FLOAT
    + f""" select count(car) filter (free_float > 20) as n_in, count(car) filter (not free_float > 20) as n_out, {_R('avg(car) filter (free_float > 20)')} as mean_in, {_R('avg(car) filter (not free_float > 20)')} as mean_out,
  {_R('(avg(car) filter (free_float > 20) - avg(car) filter (not free_float > 20)) / nullif(sqrt(var_samp(car) filter (free_float > 20) / count(car) filter (free_float > 20) + var_samp(car) filter (not free_float > 20) / count(car) filter (not free_float > 20)), 0)')} as t from cf""",
}
