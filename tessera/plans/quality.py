"""Queries p1, p2, p5 and p6: data quality and trailing totals over the domain tables."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import orphans, profile, rolling, spikes
from tessera.session import shared_dir
from tessera.tables import table


def _tick_flags(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.flag_readings(
        table(spark, folder, "tick_events_ext"), id="tick_id", source=["stock_code"], block=["trading_date"],
        channel=["event_type"], time="time", value="value", size="size",
    )


def _manifest_flags(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.flag_counts(
        table(spark, folder, "tick_manifest_target"), id="manifest_id", source=["stock_code"], order="load_id",
        count="nonpositive_value_rows", total="total_rows",
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible ticks and manifest rows."""
    ticks = _tick_flags(spark, folder).select(F.lit("tick_events_ext").alias("table_name"), F.col("id").alias("record_id"))
    loads = _manifest_flags(spark, folder).select(F.lit("tick_manifest_target").alias("table_name"), F.col("id").alias("record_id"))
    return ticks.unionAll(loads)


def p1_flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each table broke a limit, were stuck, spiked, or had an outlying size."""
    ticks = _tick_flags(spark, folder).select(F.lit("tick_events_ext").alias("table_name"), "flags")
    loads = _manifest_flags(spark, folder).select(F.lit("tick_manifest_target").alias("table_name"), "flags")
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(F.lit(b)) > 0)
    return ticks.unionAll(loads).groupBy("table_name").agg(
        bit(spikes.LIMIT).alias("beyond_limits"), bit(spikes.STUCK).alias("stuck"), bit(spikes.SPIKE).alias("spikes"),
        bit(spikes.SIZE).alias("size_outliers"), F.count(F.lit(1)).alias("rows_flagged"),
    )


def _references(spark: SparkSession, folder: str) -> tuple[orphans.Parent, list[orphans.Child]]:
    key = orphans.number_key(F.col("stock_code"))
    parent = orphans.Parent("ipo_master", table(spark, folder, "ipo_master"), key, "registered_at_utc", "deleted_at_utc")
    at = {"ipo_daily_prices": "loaded_at_utc", "micro_features_daily": "loaded_at_utc", "ipo_event_dates_curated": "curated_at_utc"}
    return parent, [orphans.Child(n, table(spark, folder, n), key, c, "row_id") for n, c in at.items()]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose stock was not live in ipo_master when they were loaded."""
    return orphans.orphan_rows(*_references(spark, folder))


def p2_orphans_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan rows and keys per table and load month."""
    return orphans.orphan_report(*_references(spark, folder))


#: How the two tables of loads are profiled. load_id is the load itself.
MANIFEST = profile.Profiled(
    "tick_manifest_target", "load_id", "built_at_utc",
    ("trading_days", "total_rows", "trade_rows", "bid_rows", "ask_rows", "other_rows", "nonpositive_value_rows", "invalid_size_rows"),
)
MICRO = profile.Profiled("micro_features_daily", "load_id", "loaded_at_utc", ("n_trades", "tick_volume", "avg_trade_size", "n_quotes"))
WATCHED = (("tick_manifest_target", "trade_rows"), ("tick_manifest_target", "invalid_size_rows"), ("micro_features_daily", "trading_date"))


def _maintained_counts(spark: SparkSession, folder: str, *specs: profile.Profiled) -> DataFrame:
    """Value counts of tables, kept in the shared folder and brought up to date load by load.

    There is a store for each folder and choice of columns; the first query counts all loads, a later one only those that are new or changed.
    """
    name = hashlib.md5(repr((folder, specs)).encode()).hexdigest()[:16]
    store = profile.ValueCounts(spark, f"{shared_dir(spark).rstrip('/')}/value-counts-{name}")
    for spec in specs:
        store.refresh(table(spark, folder, spec.name), spec)
    return store.counts()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Loads in which one of the watched columns clearly differs from the other loads."""
    specs = [replace(s, columns=(*[c for t, c in WATCHED if t == s.name], s.loaded_at)) for s in (MANIFEST, MICRO)]
    found = profile.differing_loads(_maintained_counts(spark, folder, *specs), {s.name: s.loaded_at for s in specs})
    return found.where(F.col("column_name").isin([c for _, c in WATCHED])).select("table_name", "column_name", "load_id")


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The exact profile of every column of both tables per load."""
    return profile.profile(_maintained_counts(spark, folder, MANIFEST, MICRO))


def p6_trailing(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and averages over the last 7 and 30 days for every stock and calendar day."""
    prices = table(spark, folder, "ipo_daily_prices")
    return rolling.trailing_totals(prices, entity="stock_code", day="date", values=["volume", "chg_pct_1d"], order=["loaded_at_utc", "row_id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which a listed stock has traded nothing for 7 days, but something within 30."""
    prices = table(spark, folder, "ipo_daily_prices")
    days = rolling.trailing_totals(prices, entity="stock_code", day="date", values=["volume"], order=["loaded_at_utc", "row_id"])
    listed = table(spark, folder, "ipo_master").select("stock_code").distinct()
    quiet = days.where("volume_sum_7 = 0 and volume_sum_30 > 0").join(listed, "stock_code", "left_semi")
    return quiet.select("stock_code", F.date_format("date", "yyyy-MM-dd").alias("ref_date"))


QUERIES = {
    "p1_found": p1_found, "p1_flag_counts": p1_flag_counts, "p2_found": p2_found, "p2_orphans_by_period": p2_orphans_by_period,
    "p5_found": p5_found, "p5_profile": p5_profile, "p6_found": p6_found, "p6_trailing": p6_trailing,
}

_NUMBER = "coalesce(regexp_replace(nullif(regexp_extract({0}, '([0-9]+)', 1), ''), '^0+(.)', '\\1'), '')"
_REFERENCES = " union all ".join(
    f"select '{t}' as table_name, {_NUMBER.format('stock_code')} as key, cast({c} as timestamp) as seen, row_id from {t}"
    for t, c in (("ipo_daily_prices", "loaded_at_utc"), ("micro_features_daily", "loaded_at_utc"), ("ipo_event_dates_curated", "curated_at_utc"))
)
_ORPHANS = f"""
with refs as ({_REFERENCES}),
master as (select {_NUMBER.format('stock_code')} as key, registered_at_utc s, deleted_at_utc e from ipo_master),
orphans as (
  select * from refs r where not exists (
    select 1 from master m where m.key <> '' and m.key = r.key and m.s <= r.seen and (m.e is null or r.seen < m.e)))
"""
_DAYS = """
with one as (
  select stock_code, date, case when isnan(volume) then null else volume end volume, case when isnan(chg_pct_1d) then null else chg_pct_1d end chg_pct_1d
  from ipo_daily_prices where stock_code is not null and date is not null
  qualify row_number() over (partition by stock_code, date order by loaded_at_utc desc, row_id desc) = 1),
calendar as (select stock_code, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from one group by stock_code),
days as (
  select c.stock_code, c.date, coalesce(volume, 0) v, coalesce(chg_pct_1d, 0) c, (volume is not null)::int nv, (chg_pct_1d is not null)::int nc
  from calendar c left join one o on o.stock_code = c.stock_code and o.date = c.date),
sums as (
  select stock_code, date, sum(v) over w7 v7, sum(v) over w30 v30, sum(c) over w7 c7, sum(c) over w30 c30,
    sum(nv) over w7 nv7, sum(nv) over w30 nv30, sum(nc) over w7 nc7, sum(nc) over w30 nc30
  from days
  window w7 as (partition by stock_code order by date rows 6 preceding), w30 as (partition by stock_code order by date rows 29 preceding))
"""
_TOTALS = ", ".join(
    f"round({a}{n}, 4) as {v}_sum_{n}, round({a}{n}, 4) / {n} as {v}_avg_{n}, round({a}{n}, 4) / nullif(n{a}{n}, 0) as {v}_mean_{n}"
    for v, a in (("volume", "v"), ("chg_pct_1d", "c")) for n in (7, 30)
)
#: Columns of the profiled tables by kind, for the SQL of the profile.
_PROFILED = {
    "tick_manifest_target": (MANIFEST, {
        "manifest_id": "n", "scope": "s", "stock_code": "s", "first_date": "d", "last_date": "d", "trading_days": "n", "total_rows": "n", "trade_rows": "n", "bid_rows": "n",
        "ask_rows": "n", "other_rows": "n", "nonpositive_value_rows": "n", "invalid_size_rows": "n", "first_event_utc": "t", "last_event_utc": "t", "built_at_utc": "t",
    }),
    "micro_features_daily": (MICRO, {
        "row_id": "n", "stock_code": "s", "trading_date": "d", "n_trades": "n", "tick_volume": "n", "avg_trade_size": "n", "ofi": "n", "rel_spread": "n", "realized_vol": "n", "n_quotes": "n", "loaded_at_utc": "t",
    }),
}


def _profile_sql() -> str:
    line = {"n": "cast({0} as double)", "d": "cast(date_diff('day', date '1970-01-01', {0}) as double)", "t": "epoch_us({0}) / 1e6", "s": "cast(null as double)"}
    parts = []
    for name, (spec, columns) in _PROFILED.items():
        for c, kind in columns.items():
            x = line[kind].format(c)
            bad = f"count(*) filter ({c} < 0)" if c in spec.not_negative else "0"
            parts.append(f"""
select '{name}' as table_name, '{c}' as column_name, load_id, sum(n)::bigint as "rows", (sum(n) - sum(n) filter (v is not null))::bigint as nulls0,
  count(v)::bigint as distinct_values, min(x) as value_min, max(x) as value_max, sum(bad)::bigint as negatives,
  case when sum(n) filter (v is not null) > 0 then round(greatest(log2(sum(n) filter (v is not null)) - sum(n * log2(n)) filter (v is not null) / sum(n) filter (v is not null), 0), 6) end as entropy
from (select load_id, {c} as v, count(*) n, min({x}) x, {bad} bad from {name} group by load_id, {c}) group by load_id""")
    body = " union all ".join(parts)
    return f"""select table_name, column_name, load_id, "rows", coalesce(nulls0, "rows") as nulls, distinct_values, value_min, value_max, negatives, entropy,
round(coalesce(nulls0, "rows") / "rows", 6) as null_rate from ({body})"""


SQL = {
    "p2_found": _ORPHANS + "select table_name, strftime(seen, '%Y-%m') as period, row_id from orphans",
    "p2_orphans_by_period": _ORPHANS
    + "select table_name, strftime(seen, '%Y-%m') as period, count(*) as orphan_rows, count(distinct key) as orphan_keys from orphans group by 1, 2",
    "p5_profile": _profile_sql(),
    "p6_trailing": _DAYS + f"select stock_code, date, {_TOTALS} from sums",
    "p6_found": _DAYS
    + "select stock_code, strftime(date, '%Y-%m-%d') as ref_date from sums where v7 = 0 and v30 > 0 and stock_code in (select stock_code from ipo_master)",
}
