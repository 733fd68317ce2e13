"""Queries that evaluate signals: labels, statistics, portfolios, folds, combinations, selection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.expression import with_factors
from tessera.operators import evaluate, events, folds, selection
from tessera.plans.common import FACTORS, FACTORS_SQL, PANEL, SIGNALS, bars, ic_sql, long_short_sql, rank_ic_sql, rank_sql, rounded, sectors, signals

START, END = date(2025, 10, 6), date(2026, 6, 26)
RULE = folds.Folds(count=4, size=90, step=45, embargo=2, least=20)
HORIZONS = {1: "h1", 5: "h5", 10: "h10"}


def fwd_return(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.with_forward(bars(spark, folder), horizons={"fwd": (1, 5)}).select("symbol", "timestamp", "fwd"))


def fwd_return_log(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.with_forward(bars(spark, folder), horizons={"fwd": (1, 5)}, kind="log").select("symbol", "timestamp", "fwd"))


def _market(spark: SparkSession, folder: str) -> DataFrame:
    index = bars(spark, folder).groupBy("timestamp").agg(F.avg("close").alias("close"))
    over = Window.orderBy("timestamp")  # one row per day
    return index.select("timestamp", evaluate.forward_return(F.col("close"), over).alias("market_fwd"))


def market_fwd(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_market(spark, folder))


def ic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.mean_ic(signals(spark, folder)))


def rank_ic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.mean_rank_ic(signals(spark, folder)))


def rank_ic_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.rank_ic_by_time(signals(spark, folder)))


def quantile_spread(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.quantile_spread(signals(spark, folder)))


def long_short(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.long_short(signals(spark, folder)))


def turnover(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.turnover(signals(spark, folder)))


def net_spread(spark: SparkSession, folder: str) -> DataFrame:
    s = signals(spark, folder)
    both = evaluate.quantile_spread(s).join(evaluate.turnover(s))  # one row each
    return rounded(both.select(evaluate.net_of_cost(F.col("quantile_spread"), F.col("turnover"), 10).alias("net_spread")))


def sector_neutral(spark: SparkSession, folder: str) -> DataFrame:
    s = signals(spark, folder).join(sectors(spark, folder), "symbol", "left")
    return rounded(evaluate.sector_neutral(s).select("symbol", "timestamp", "fwd"))


def beta_neutral(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.beta_neutral(signals(spark, folder), lookback=40, least=10).select("symbol", "timestamp", "fwd"))


def neutral_both(spark: SparkSession, folder: str) -> DataFrame:
    s = signals(spark, folder).join(sectors(spark, folder), "symbol", "left")
    return rounded(evaluate.neutralised(s, "both", lookback=40, least=10).select("symbol", "timestamp", "fwd"))


def ic_by_horizon(spark: SparkSession, folder: str) -> DataFrame:
    s = with_factors(bars(spark, folder), {"signal": "-ts_delta(close, 5) / lag(close, 5)"})
    s = evaluate.with_forward(s, horizons={c: (1, h) for h, c in HORIZONS.items()})
    return rounded(evaluate.ic_by_horizon(s, HORIZONS))


def eval_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.evaluation(signals(spark, folder)))


def portfolio(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.portfolio_metrics(evaluate.long_short(signals(spark, folder))))


def episode_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.episode_shares(evaluate.long_short(signals(spark, folder)), 5))


def top_dates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.best_times(evaluate.long_short(signals(spark, folder)), 3))


def attribution(spark: SparkSession, folder: str) -> DataFrame:
    """The stream's metrics by month: what each part of the time contributes."""
    stream = evaluate.long_short(signals(spark, folder)).withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    return rounded(evaluate.portfolio_metrics(stream, ["month"]).select("month", "n", "mean_return", "hit_rate", "max_drawdown"))


def long_only(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.long_only(signals(spark, folder), _market(spark, folder)))


def fold_windows(spark: SparkSession, folder: str) -> DataFrame:
    return folds.frame(spark, folds.windows(START, END, RULE))


def walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    per = folds.walk_forward(signals(spark, folder), folds.windows(START, END, RULE))
    return rounded(per.select("fold", "n_periods", "n_assets", "ic", "rank_ic", "quantile_spread", "turnover"))


def walk_forward_summary(spark: SparkSession, folder: str) -> DataFrame:
    per = folds.walk_forward(signals(spark, folder), folds.windows(START, END, RULE))
    return rounded(folds.summarise(per).select("folds", "rank_ic", "rank_ic_deviation", "positive_share", "n_periods", "n_assets"))


def holdout(spark: SparkSession, folder: str) -> DataFrame:
    """In-sample and held-out rank-IC (fold -1) and their ratio, in one job."""
    inside, out = folds.holdout_span(START, END, 0.2)
    spans = [(i, a, b) for i, a, b in folds.windows(*inside, RULE)] + [(-1, *out)]
    per = folds.walk_forward(signals(spark, folder), spans)
    r = per.agg(F.avg(F.when(F.col("fold") >= 0, F.col("rank_ic"))).alias("in_sample"), F.max(F.when(F.col("fold") == -1, F.col("rank_ic"))).alias("held_out"))
    return rounded(r.withColumn("decay", F.try_divide("held_out", F.nullif(F.col("in_sample"), F.lit(0.0)))))


def splits(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(folds.month_splits(START, END, 3, 2, 1, 5))]
    return spark.createDataFrame(rows, "split int, train_start date, train_end date, test_start date, test_end date")


def date_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return folds.date_blocks(bars(spark, folder), 4, 2)


def _factors(spark: SparkSession, folder: str) -> DataFrame:
    return with_factors(bars(spark, folder), FACTORS)


def _combined(method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        f = _factors(spark, folder)
        return rounded(f.select("symbol", "timestamp", evaluate.combine(list(FACTORS), method).alias("signal")))

    run.__doc__ = f"The listed factors as one signal by {method}."
    return run


def pairwise_corr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.pairwise_rank_correlation(_factors(spark, folder), list(FACTORS)))


def mean_pairwise_corr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pairwise_corr(spark, folder).where("left <> right").agg(F.avg("rank_corr").alias("mean_corr")))


def _long(spark: SparkSession, folder: str) -> DataFrame:
    """Factors as rows, with the next day's return."""
    f = evaluate.with_forward(_factors(spark, folder))
    entries = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("signal")) for k in FACTORS])
    return f.select("symbol", "timestamp", "close", "fwd", F.explode(entries).alias("e")).select("symbol", "timestamp", "close", "fwd", "e.*")


def factor_rank_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Rank-IC of all factors side by side in one job."""
    return rounded(evaluate.mean_rank_ic(_long(spark, folder), ["factor"]))


def _per_fold(spark: SparkSession, folder: str) -> DataFrame:
    rows = folds.assign(_long(spark, folder).drop("fwd"), folds.windows(START, END, RULE))
    return evaluate.mean_rank_ic(evaluate.with_forward(rows, ["factor", "fold", "symbol"]), ["factor", "fold"])


def persistence_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.persistence(_per_fold(spark, folder), ["factor"]), 4)


def select_topk(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.best(evaluate.mean_rank_ic(_long(spark, folder), ["factor"]), "rank_ic", 2, ["factor"]))


def complement(spark: SparkSession, folder: str) -> DataFrame:
    """Rank-IC of a base signal, of the base with another, and the gain."""
    f = evaluate.with_forward(_factors(spark, folder)).withColumn("both", evaluate.combine(["f1", "f2"], "zscore_average"))
    entries = F.array(F.struct(F.lit("base").alias("which"), F.col("f1").alias("signal")), F.struct(F.lit("augmented").alias("which"), F.col("both").alias("signal")))
    per = evaluate.mean_rank_ic(f.select("timestamp", "fwd", F.explode(entries).alias("e")).select("timestamp", "fwd", "e.*"), ["which"])
    r = per.agg(F.max(F.when(F.col("which") == "base", F.col("rank_ic"))).alias("base"), F.max(F.when(F.col("which") == "augmented", F.col("rank_ic"))).alias("augmented"))
    return rounded(r.withColumn("lift", F.col("augmented") - F.col("base")))


def judge(spark: SparkSession, folder: str) -> DataFrame:
    """Factors by the first rule that holds on their folds: a chain of conditions over a table of metrics."""
    scale = selection.bonferroni_multiplier(len(FACTORS))
    per = _per_fold(spark, folder).groupBy("factor").agg(F.count("rank_ic").alias("folds"), F.avg("rank_ic").alias("rank_ic"), F.avg(F.when(F.col("rank_ic") > 0, 1.0).otherwise(0.0)).alias("positive_share"))
    rules = [
        ("folds", "reject", F.col("folds") < 2), ("strength", "reject", F.abs("rank_ic") < 0.005 * scale), ("stability", "reject", F.col("positive_share") < 0.5),
        ("margin", "refine", F.abs("rank_ic") < 0.02 * scale),
    ]
    return rounded(selection.decide(per, rules, "promote"))


def robustness_tally(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.tally(_per_fold(spark, folder), ["factor"], "rank_ic").drop("level"))


def sign_counts(spark: SparkSession, folder: str) -> DataFrame:
    return events.sign_counts(_per_fold(spark, folder), "rank_ic", ["factor"])


def t_stat(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(events.t_statistic(evaluate.long_short(signals(spark, folder)), "ret"))


def selector_corr(spark: SparkSession, folder: str) -> DataFrame:
    """Spearman correlation over factors between their rank-IC in the first and in the last fold."""
    per = _per_fold(spark, folder)
    wide = per.groupBy("factor").agg(F.max(F.when(F.col("fold") == 0, F.col("rank_ic"))).alias("a"), F.max(F.when(F.col("fold") == 3, F.col("rank_ic"))).alias("b"))
    ranked = wide.where("a is not null and b is not null").withColumns({c: F.rank().over(Window.orderBy(c)).cast("double") for c in ("a", "b")})  # one row per factor
    return rounded(events.safe_correlation(ranked, "a", "b"))


def brief(spark: SparkSession, folder: str) -> DataFrame:
    """What is weak about each factor, as a list."""
    per = _per_fold(spark, folder).groupBy("factor").agg(F.avg("rank_ic").alias("rank_ic"), F.avg(F.when(F.col("rank_ic") > 0, 1.0).otherwise(0.0)).alias("positive_share"))
    weak = selection.weaknesses({"weak_cross_sectional": F.abs("rank_ic") < 0.02, "sign_inconsistent": F.col("positive_share").between(0.3, 0.7)})
    return per.select("factor", F.concat_ws(",", weak).alias("weak"))


QUERIES = {
    f.__name__: f for f in (
        fwd_return, fwd_return_log, market_fwd, ic, rank_ic, rank_ic_by_day, quantile_spread, long_short, turnover, net_spread, sector_neutral, beta_neutral, neutral_both, ic_by_horizon, eval_bundle,
        portfolio, episode_share, top_dates, attribution, long_only, fold_windows, walk_forward, walk_forward_summary, holdout, splits, date_blocks, pairwise_corr, mean_pairwise_corr, factor_rank_ic,
        persistence_rank, select_topk, complement, judge, robustness_tally, sign_counts, t_stat, selector_corr, brief,
    )
} | {"combine_rank": _combined("rank_aggregate"), "combine_z": _combined("zscore_average"), "combine_eq": _combined("equal_weight")}

_R = lambda x, n=6: f"round({x}, {n}) + 0.0"
_TURN = """(select avg(step) as turnover from (select timestamp, avg(step) step from (
  select symbol, timestamp, abs(z - lag(z) over (partition by symbol order by timestamp)) step from (
    select symbol, timestamp, case when stddev_samp(signal) over t > 0 then (signal - avg(signal) over t) / stddev_samp(signal) over t else signal * 0 end z from lab window t as (partition by timestamp)))
  group by timestamp))"""
_STREAM = long_short_sql("lab")
_SECTOR = """, sector_of as (select stock_code as symbol, arg_max(sector, (registered_at_utc, coalesce(sector, ''))) as sector from ipo_master where stock_code is not null group by 1),
neutral as (select l.symbol, timestamp, fwd - avg(fwd) over (partition by timestamp, coalesce(sector, 'UNKNOWN')) as fwd from lab l left join sector_of s using (symbol))"""


def _beta(source: str) -> str:
    return f"""select symbol, timestamp, {_R('''case when abs(m) <= 1e-15 then fwd else fwd - (case when p >= 10 and n >= 10 then case when v = 0 then 0 else c / nullif(v, 0) end end) * m end''')} as fwd
from (select symbol, timestamp, fwd, m, count(case when fwd is not null then m end) over w p, covar_samp(case when m is not null then fwd end, case when fwd is not null then m end) over w c,
  count(m) over w n, var_samp(m) over w v
  from (select symbol, timestamp, fwd, avg(fwd) over (partition by timestamp) m from {source}) window w as (partition by symbol order by timestamp rows between 40 preceding and 1 preceding))"""


_FOLDS = " union all ".join(f"select {i} as fold, date '{a}' as a, date '{b}' as b" for i, a, b in folds.windows(START, END, RULE))


def _fold_labels(spans: str, source: str = "sig", extra: str = "") -> str:
    part = f"partition by fold{extra}, symbol order by timestamp"
    return f"""folds as ({spans}), flab as (select *, lead(close, 2) over ({part}) / nullif(lead(close, 1) over ({part}), 0) - 1 as fwd from {source} join folds on timestamp between a and b)"""


_PORTFOLIO = """
select count(ret) as n, round(avg(ret), 6) + 0.0 as mean_return, round(coalesce(stddev_samp(ret), 0), 6) + 0.0 as vol,
  round(case when stddev_samp(ret) > 1e-12 then avg(ret) / stddev_samp(ret) * sqrt(252) end, 6) + 0.0 as sharpe, round(avg((ret > 0)::int), 6) + 0.0 as hit_rate,
  round(max(down), 6) + 0.0 as max_drawdown, round(case when sum(ret) > 0 and count(*) >= 3 then sum(ret) filter (place <= 3) / sum(ret) end, 6) + 0.0 as tail_concentration{0}
from (select *, max(cum) over (partition by {1} order by timestamp) - cum as down from (
  select *{2}, sum(ret) over (partition by {1} order by timestamp) cum, row_number() over (partition by {1} order by ret desc, timestamp) place from {3})) {4}"""
_LONGSQL = f"""{FACTORS_SQL}, flong as (
  select symbol, timestamp, close, fwd, factor, signal from (select *, lead(close, 2) over (partition by symbol order by timestamp) / nullif(lead(close, 1) over (partition by symbol order by timestamp), 0) - 1 as fwd from fac) f,
  lateral (select unnest(['f1', 'f2', 'f3', 'f4']) as factor, unnest([f1, f2, f3, f4]) as signal))"""
_PERFOLD = f"""with {_LONGSQL}, folds as ({_FOLDS}), fl as (
  select symbol, timestamp, factor, signal, fold, lead(close, 2) over w / nullif(lead(close, 1) over w, 0) - 1 as fwd from flong join folds on timestamp between a and b
  window w as (partition by factor, fold, symbol order by timestamp)),
per as (select factor, fold, avg(ic) as rank_ic from {rank_ic_sql('fl', 'factor, fold, timestamp')} group by factor, fold)"""
_PAIR = " union all ".join(
    f"""select '{a}' as "left", '{b}' as "right", {_R('avg(c)')} as rank_corr from (
  select timestamp, case when stddev_samp({a}) > 0 and stddev_samp({b}) > 0 then covar_samp({a}, {b})
    / nullif(stddev_samp(case when {b} is not null then {a} end) * stddev_samp(case when {a} is not null then {b} end), 0) end c from rk group by timestamp)"""
    for a in FACTORS for b in FACTORS
)
_RANKED = ", rk as (select timestamp, " + ", ".join(f"case when {f} is not null then {rank_sql(f)} end as {f}" for f in FACTORS) + " from fac)"
_H = lambda h: f"lead(close, {1 + h}) over w / nullif(lead(close, 1) over w, 0) - 1"
_HL = f"""with {PANEL}, s as (select symbol, timestamp, -(close - lag(close, 5) over w) / nullif(lag(close, 5) over w, 0) as signal, {_H(1)} as h1, {_H(5)} as h5, {_H(10)} as h10
  from panel window w as (partition by symbol order by timestamp)),
hl as (select timestamp, symbol, signal, horizon, fwd from s, lateral (select unnest([1, 5, 10]) as horizon, unnest([h1, h5, h10]) as fwd))"""

SQL = {
    "fwd_return": f"with {PANEL} select symbol, timestamp, {_R('lead(close, 6) over w / nullif(lead(close, 1) over w, 0) - 1')} as fwd from panel window w as (partition by symbol order by timestamp)",
    "fwd_return_log": f"""with {PANEL}, r as (select symbol, timestamp, lead(close, 6) over w / nullif(lead(close, 1) over w, 0) as x from panel window w as (partition by symbol order by timestamp))
select symbol, timestamp, {_R('case when x > 0 then ln(x) end')} as fwd from r""",
    "market_fwd": f"with {PANEL}, m as (select timestamp, avg(close) c from panel group by 1) select timestamp, {_R('lead(c, 2) over w / nullif(lead(c, 1) over w, 0) - 1')} as market_fwd from m window w as (order by timestamp)",
    "ic": f"with {SIGNALS} select {_R('avg(ic)')} as ic, count(ic) as ic_times from {ic_sql('lab')}",
    "rank_ic": f"with {SIGNALS} select {_R('avg(ic)')} as rank_ic, count(ic) as rank_ic_times from {rank_ic_sql('lab')}",
    "rank_ic_by_day": f"with {SIGNALS} select timestamp, {_R('ic')} as ic from {rank_ic_sql('lab')}",
    "quantile_spread": f"with {SIGNALS} select {_R('avg(ret)')} as quantile_spread, count(ret) as quantile_spread_times from {_STREAM}",
    "long_short": f"with {SIGNALS} select timestamp, {_R('ret')} as ret from {_STREAM}",
    "turnover": f"with {SIGNALS} select {_R('turnover')} as turnover from {_TURN}",
    "net_spread": f"with {SIGNALS} select {_R('(select avg(ret) from ' + _STREAM + ') - 0.001 * (select turnover from ' + _TURN + ')')} as net_spread",
    "sector_neutral": f"with {SIGNALS}{_SECTOR} select symbol, timestamp, {_R('fwd')} as fwd from neutral",
    "beta_neutral": f"with {SIGNALS} {_beta('lab')}",
    "neutral_both": f"with {SIGNALS}{_SECTOR} {_beta('neutral')}",
    "ic_by_horizon": f"""{_HL}, r as (select horizon, {_R('avg(ic)')} as rank_ic, avg(ic) as raw from {rank_ic_sql('hl', 'horizon, timestamp')} group by horizon),
i as (select horizon, {_R('avg(ic)')} as ic from {ic_sql('hl', 'horizon, timestamp')} group by horizon)
select horizon, ic, rank_ic, (select count(*) from r where (raw > 0) = (select raw > 0 from r where horizon = 1)) as same_sign from i join r using (horizon)""",
    "eval_bundle": f"""with {SIGNALS}, st as (select * from {_STREAM}), pf as ({_PORTFOLIO.format('', '1', '', 'st', '')})
select (select count(distinct timestamp) from lab) as n_periods, (select count(distinct symbol) from lab) as n_assets, (select {_R('avg(ic)')} from {ic_sql('lab')}) as ic,
  (select {_R('avg(ic)')} from {rank_ic_sql('lab')}) as rank_ic, (select {_R('turnover')} from {_TURN}) as turnover, (select {_R('avg(ret)')} from st) as quantile_spread,
  mean_return, vol, sharpe, hit_rate, max_drawdown, tail_concentration, {_R('(select avg(ret) from st) - 0.001 * (select turnover from ' + _TURN + ')')} as net_spread from pf""",
    "portfolio": f"with {SIGNALS}, st as (select * from {_STREAM}) {_PORTFOLIO.format('', '1', '', 'st', '')}",
    "attribution": f"""with {SIGNALS}, st as (select *, strftime(timestamp, '%Y-%m') as month from {_STREAM}), pf as ({_PORTFOLIO.format(', month', 'month', '', 'st', 'group by month')})
select month, n, mean_return, hit_rate, max_drawdown from pf""",
    "episode_share": f"""with {SIGNALS}, st as (select * from {_STREAM}), p as (select *, (row_number() over (order by timestamp) - 1) % 5 as phase, greatest(ret, 0) as gain from st),
q as (select *, row_number() over (partition by phase order by gain desc, timestamp) place from p),
c as (select phase, sum(gain) filter (place <= 3) / nullif(sum(gain), 0) as share, count(*) filter (ret > 0) as gains from q group by phase)
select {_R('median(share)')} as median_share, {_R('max(share)')} as max_share, count(share) as phases, min(gains) as least_gains from c""",
    "top_dates": f"with {SIGNALS} select timestamp, {_R('ret')} as ret from {_STREAM} order by 2 desc, 1 limit 3",
    "long_only": f"""with {SIGNALS}, m as (select timestamp, avg(close) c from panel group by 1), mf as (select timestamp, lead(c, 2) over w / nullif(lead(c, 1) over w, 0) - 1 as mk from m window w as (order by timestamp)),
ok as (select * from lab where signal is not null and fwd is not null), e as (select timestamp, quantile_cont(signal, 0.8) q from ok group by 1 having count(*) >= 10),
top as (select o.symbol, o.timestamp, fwd, mk from ok o join e using (timestamp) join mf using (timestamp) where signal >= q and mk is not null),
d as (select timestamp, lag(timestamp) over (order by timestamp) p from (select distinct timestamp from top))
select t.timestamp, {_R('avg(fwd) - any_value(mk)')} as ret, {_R('avg(case when p is null then null when exists (select 1 from top u where u.symbol = t.symbol and u.timestamp = p) then 0 else 1 end)')} as turnover, count(*) as names
from top t join d using (timestamp) group by t.timestamp""",
    "fold_windows": f"select fold, a as fold_start, b as fold_end from ({_FOLDS})",
    "walk_forward": f"""with {SIGNALS}, {_fold_labels(_FOLDS)},
r as (select fold, avg(ic) x from {rank_ic_sql('flab', 'fold, timestamp')} group by fold), i as (select fold, avg(ic) x from {ic_sql('flab', 'fold, timestamp')} group by fold),
q as (select fold, avg(ret) x from {long_short_sql('flab', 'fold, timestamp')} group by fold),
t as ({_TURN[1:-1].replace('select avg(step) as turnover from (select timestamp,', 'select fold, avg(step) as x from (select fold, timestamp,').replace('select symbol, timestamp,', 'select fold, symbol, timestamp,').replace('partition by symbol', 'partition by fold, symbol').replace('partition by timestamp', 'partition by fold, timestamp').replace('group by timestamp', 'group by fold, timestamp').replace('from lab', 'from flab')} group by fold)
select fold, count(distinct timestamp) as n_periods, count(distinct symbol) as n_assets, (select {_R('x')} from i where i.fold = f.fold) as ic, (select {_R('x')} from r where r.fold = f.fold) as rank_ic,
  (select {_R('x')} from q where q.fold = f.fold) as quantile_spread, (select {_R('x')} from t where t.fold = f.fold) as turnover from flab f group by fold""",
    "walk_forward_summary": f"""with {SIGNALS}, {_fold_labels(_FOLDS)},
b as (select fold, count(distinct timestamp) p, count(distinct symbol) s from flab group by fold), r as (select fold, avg(ic) x from {rank_ic_sql('flab', 'fold, timestamp')} group by fold)
select count(*) as folds, {_R('avg(x)')} as rank_ic, {_R('coalesce(stddev_pop(x), 0)')} as rank_ic_deviation, {_R('avg(case when x is not null then (x > 0)::int end)')} as positive_share,
  sum(p)::bigint as n_periods, max(s) as n_assets from b left join r using (fold)""",
    "splits": "select * from (values " + ", ".join(f"({i}, {', '.join(f'''date '{d}' ''' for d in s)})" for i, s in enumerate(folds.month_splits(START, END, 3, 2, 1, 5))) + ") v(split, train_start, train_end, test_start, test_end)",
    "date_blocks": f"""with {PANEL}, d as (select day, ntile(4) over (order by day) as block from (select distinct timestamp as day from panel)),
k as (select *, row_number() over (partition by block order by day desc) r from d), f as (select block, day, count(*) over (partition by block) n from k where r > 2) select block, day from f where n >= 5""",
    "combine_rank": f"with {FACTORS_SQL}{_RANKED.replace('select timestamp', 'select symbol, timestamp')} select symbol, timestamp, {_R('case when coalesce(f1, f2, f3, f4) is not null then coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) + coalesce(f4, 0) end')} as signal from rk",
    "combine_z": f"with {FACTORS_SQL}, z as (select symbol, timestamp, "
    + ", ".join(f"({f} - avg({f}) over (partition by timestamp)) / nullif(stddev_samp({f}) over (partition by timestamp), 0) as {f}" for f in FACTORS)
    + f" from fac) select symbol, timestamp, {_R('list_avg([f1, f2, f3, f4])')} as signal from z",
    "combine_eq": f"with {FACTORS_SQL} select symbol, timestamp, {_R('list_avg([f1, f2, f3, f4])')} as signal from fac",
    "pairwise_corr": f"with {FACTORS_SQL}{_RANKED} {_PAIR}",
    "mean_pairwise_corr": f"""with {FACTORS_SQL}{_RANKED}, p as ({_PAIR}) select {_R('avg(rank_corr)')} as mean_corr from p where "left" <> "right" """,
    "factor_rank_ic": f"with {_LONGSQL} select factor, {_R('avg(ic)')} as rank_ic, count(ic) as rank_ic_times from {rank_ic_sql('flong', 'factor, timestamp')} group by factor",
    "select_topk": f"with {_LONGSQL} select factor, {_R('avg(ic)')} as rank_ic, count(ic) as rank_ic_times from {rank_ic_sql('flong', 'factor, timestamp')} group by factor order by avg(ic) desc nulls last, factor limit 2",
    "persistence_rank": f"""{_PERFOLD}, s as (select factor, count(rank_ic) as n_folds, avg((rank_ic > 0)::int) as positive_share,
  case when stddev_pop(rank_ic) > 0 then avg(rank_ic) / (stddev_pop(rank_ic) / sqrt(count(rank_ic))) when avg(rank_ic) > 0 then 'inf'::double when avg(rank_ic) < 0 then '-inf'::double else 0 end as score,
  avg(rank_ic) as mean from per group by factor)
select factor, n_folds, {_R('positive_share', 4)} as positive_share, {_R('score', 4)} as score, {_R('mean', 4)} as mean, row_number() over (order by positive_share desc, score desc, mean desc, factor) as place from s""",
    "robustness_tally": f"{_PERFOLD} select factor, count(rank_ic) as n, count(*) filter (rank_ic > 0) as positive, {_R('avg(rank_ic)')} as mean from per group by grouping sets ((factor), ())",
    "sign_counts": f"{_PERFOLD} select factor, count(*) filter (rank_ic > 0) as positive, count(*) filter (rank_ic < 0) as negative, count(*) filter (rank_ic = 0) as zero from per group by factor",
    "t_stat": f"with {SIGNALS} select {_R('avg(ret)')} as mean, {_R('avg(ret) / nullif(stddev_samp(ret) / sqrt(count(ret)), 0)')} as t, count(ret) as n from {_STREAM}",
    "judge": f"""{_PERFOLD}, m as (select factor, count(rank_ic) as folds, avg(rank_ic) as rank_ic, avg((rank_ic > 0)::int) as positive_share from per group by factor),
g as (select *, case when folds < 2 then 'folds' when abs(rank_ic) < {0.005 * selection.bonferroni_multiplier(4)!r} then 'strength' when positive_share < 0.5 then 'stability'
  when abs(rank_ic) < {0.02 * selection.bonferroni_multiplier(4)!r} then 'margin' else 'none' end as gate from m)
select factor, folds, {_R('rank_ic')} as rank_ic, {_R('positive_share')} as positive_share, gate, case gate when 'margin' then 'refine' when 'none' then 'promote' else 'reject' end as decision from g""",
    "brief": f"""{_PERFOLD}, m as (select factor, avg(rank_ic) as r, avg((rank_ic > 0)::int) as p from per group by factor)
select factor, concat_ws(',', case when abs(r) < 0.02 then 'weak_cross_sectional' end, case when p between 0.3 and 0.7 then 'sign_inconsistent' end) as weak from m""",
    "selector_corr": f"""{_PERFOLD}, w as (select factor, max(rank_ic) filter (fold = 0) a, max(rank_ic) filter (fold = 3) b from per group by factor),
k as (select rank() over (order by a)::double a, rank() over (order by b)::double b from w where a is not null and b is not null)
select {_R('covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0)')} as corr, count(*) as n from k""",
    "complement": f"""with {FACTORS_SQL}, z as (select *, (f1 - avg(f1) over t) / nullif(stddev_samp(f1) over t, 0) z1, (f2 - avg(f2) over t) / nullif(stddev_samp(f2) over t, 0) z2,
  lead(close, 2) over w / nullif(lead(close, 1) over w, 0) - 1 as fwd from fac window t as (partition by timestamp), w as (partition by symbol order by timestamp)),
y as (select *, list_avg([z1, z2]) as aug from z), b as (select avg(ic) x from {rank_ic_sql('y', signal='f1')}), a as (select avg(ic) x from {rank_ic_sql('y', signal='aug')})
select {_R('b.x')} as base, {_R('a.x')} as augmented, {_R('a.x - b.x')} as lift from a, b""",
}
_IN, _OUT = folds.holdout_span(START, END, 0.2)
_SPANS = " union all ".join(f"select {i} as fold, date '{a}' as a, date '{b}' as b" for i, a, b in [*folds.windows(*_IN, RULE), (-1, *_OUT)])
SQL["holdout"] = f"""with {SIGNALS}, {_fold_labels(_SPANS)}, r as (select fold, avg(ic) x from {rank_ic_sql('flab', 'fold, timestamp')} group by fold)
select {_R('avg(x) filter (fold >= 0)')} as in_sample, {_R('max(x) filter (fold = -1)')} as held_out, {_R('max(x) filter (fold = -1) / nullif(avg(x) filter (fold >= 0), 0)')} as decay from r"""
