"""Cross-sectional evaluation of signals against forward returns.

Every function takes rows with a time, a signal and a return, and optional keys (factor, fold, group) that are evaluated
side by side in one job. Statistics are made per time and then averaged over times. Rows in which the signal or the
return is missing are left out; a time whose statistic is undefined does not count. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safe import divide, finite, log, mean_rank, row_mean, row_sum
from tessera.session import cut


def forward_return(close: Column, over, lag: int = 1, horizon: int = 1, kind: str = "simple") -> Column:
    """The return over `horizon` rows beginning `lag` rows ahead; NULL at the end of a series (so nothing leaks past it)."""
    far, near = F.lead(close, lag + horizon).over(over), F.lead(close, lag).over(over)
    ratio = divide(far, near)
    return log(ratio) if kind == "log" else ratio - 1


def with_forward(df: DataFrame, symbol: Sequence[str] = ("symbol",), time: str = "timestamp", close: str = "close", horizons: Mapping[str, tuple[int, int]] | None = None, kind: str = "simple") -> DataFrame:
    """The rows with one forward return per name in `horizons` ({name: (lag, horizon)})."""
    over = Window.partitionBy(*symbol).orderBy(time)
    x = finite(F.col(close))
    return df.withColumns({n: forward_return(x, over, *h, kind) for n, h in (horizons or {"fwd": (1, 1)}).items()})


def _pairs(df: DataFrame, signal: str, ret: str) -> DataFrame:
    return df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())


def ic_by_time(df: DataFrame, keys: Sequence[str] = (), time: str = "timestamp", signal: str = "signal", ret: str = "fwd", least: int = 3) -> DataFrame:
    """Pearson correlation of signal and return per time with at least `least` pairs: keys, time, ic."""
    x, y = F.col(signal), F.col(ret)
    by = _pairs(df, signal, ret).groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"), F.covar_samp(x, y).alias("c"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"))
    return by.where((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)).select(*keys, time, (F.col("c") / (F.col("sx") * F.col("sy"))).alias("ic"))


def rank_ic_by_time(df: DataFrame, keys: Sequence[str] = (), time: str = "timestamp", signal: str = "signal", ret: str = "fwd", least: int = 3) -> DataFrame:
    """The same of ranks, which are made among the pairs of a time."""
    pairs = _pairs(df, signal, ret)
    ranked = pairs.select(*keys, time, mean_rank(F.col(signal), *keys, time).alias("signal"), mean_rank(F.col(ret), *keys, time).alias("fwd"))
    return ic_by_time(ranked, keys, time, least=least)


def _mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name), F.count(value).alias(f"{name}_times"))


def mean_ic(df: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    return _mean(ic_by_time(df, keys, **columns), keys, "ic", "ic")


def mean_rank_ic(df: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    return _mean(rank_ic_by_time(df, keys, **columns), keys, "ic", "rank_ic")


def long_short(df: DataFrame, keys: Sequence[str] = (), time: str = "timestamp", signal: str = "signal", ret: str = "fwd", quantiles: int = 5) -> DataFrame:
    """Mean return of the highest quantile less that of the lowest, per time with enough pairs: keys, time, ret.

    Quantile edges are interpolated; bins include their upper edge, the first also its lower one; equal edges are
    one. A time with fewer than two bins does not count.
    """
    pairs = _pairs(df, signal, ret).select(*keys, time, F.col(signal).alias("s"), F.col(ret).alias("r"))
    at = [i / quantiles for i in range(quantiles + 1)]
    edges = pairs.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"), F.percentile("s", F.array(*map(F.lit, at))).alias("e")).where(F.col("n") >= quantiles)
    edges = edges.withColumn("e", F.array_distinct("e")).where(F.size("e") >= 3).select(*keys, time, F.element_at("e", 2).alias("low"), F.element_at("e", -2).alias("high"))
    joined = pairs.join(edges, [*keys, time])
    by = joined.groupBy(*keys, time).agg(F.avg(F.when(F.col("s") > F.col("high"), F.col("r"))).alias("top"), F.avg(F.when(F.col("s") <= F.col("low"), F.col("r"))).alias("bottom"))
    return by.select(*keys, time, (F.col("top") - F.col("bottom")).alias("ret")).where("ret is not null")


def quantile_spread(df: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    return _mean(long_short(df, keys, **columns), keys, "ret", "quantile_spread")


def turnover(df: DataFrame, keys: Sequence[str] = (), symbol: str = "symbol", time: str = "timestamp", signal: str = "signal") -> DataFrame:
    """Mean over times of the mean change of a symbol's z-score from its row before: keys, turnover. A constant cross-section is all 0."""
    x = F.col(signal)
    cross = Window.partitionBy(*keys, time)
    sd = F.stddev_samp(x).over(cross)
    z = F.when(sd > 0, (x - F.avg(x).over(cross)) / sd).otherwise(x * 0)
    step = df.select(*keys, symbol, time, z.alias("z"))
    step = step.withColumn("step", F.abs(F.col("z") - F.lag("z").over(Window.partitionBy(*keys, symbol).orderBy(time))))
    by = step.groupBy(*keys, time).agg(F.avg("step").alias("step"))
    return by.groupBy(*keys).agg(F.avg("step").alias("turnover"))


def net_of_cost(spread: Column, turned: Column, bps: float) -> Column:
    """A spread less the cost of turning over at so many basis points; unchanged without a turnover."""
    return F.when(turned.isNull() | F.lit(bps == 0), spread).otherwise(spread - F.lit(bps / 10_000) * turned)


def sector_neutral(df: DataFrame, keys: Sequence[str] = (), time: str = "timestamp", ret: str = "fwd", sector: str = "sector") -> DataFrame:
    """The return less the mean of its sector at the time; a missing sector is one of its own."""
    group = Window.partitionBy(*keys, time, F.coalesce(F.col(sector), F.lit("UNKNOWN")))
    return df.withColumn(ret, F.col(ret) - F.avg(ret).over(group))


def beta_neutral(df: DataFrame, keys: Sequence[str] = (), symbol: str = "symbol", time: str = "timestamp", ret: str = "fwd", lookback: int = 60, least: int = 20) -> DataFrame:
    """The return less beta times the mean return of all symbols at the time.

    Beta is the covariance with that mean over the symbol's `lookback` earlier rows by the mean's variance there (0 if that
    is 0); with fewer than `least` pairs the result is NULL. Where the mean is (nearly) 0 the return stays.
    """
    df = df.withColumn("m_", F.avg(ret).over(Window.partitionBy(*keys, time)))
    past = Window.partitionBy(*keys, symbol).orderBy(time).rowsBetween(-lookback, -1)
    both = F.col(ret).isNotNull() & F.col("m_").isNotNull()
    x, y = F.when(both, F.col(ret)), F.when(both, F.col("m_"))
    pairs, cov, n, var = F.count(x).over(past), F.covar_samp(x, y).over(past), F.count("m_").over(past), F.var_samp("m_").over(past)
    df = df.withColumns({"p_": pairs, "c_": cov, "n_": n, "v_": var})
    beta = F.when((F.col("p_") >= least) & (F.col("n_") >= least), F.when(F.col("v_") == 0, F.lit(0.0)).otherwise(F.try_divide("c_", "v_")))
    out = F.when(F.abs("m_") <= 1e-15, F.col(ret)).otherwise(F.col(ret) - beta * F.col("m_"))
    return df.withColumn(ret, out).drop("m_", "p_", "c_", "n_", "v_")


def neutralised(df: DataFrame, mode: str, keys: Sequence[str] = (), **columns) -> DataFrame:
    """mode: none, sector, beta, or both (sector first)."""
    if mode in ("sector", "both"):
        df = sector_neutral(df, keys)
    return beta_neutral(df, keys, **columns) if mode in ("beta", "both") else df


def combine(columns: Sequence[str], method: str, time: str = "timestamp") -> Column:
    """Signals of a row as one: rank_aggregate (sum of ranks in the cross-section), zscore_average, or equal_weight (mean).

    Missing signals are skipped; a row without any has none.
    """
    cross = Window.partitionBy(time)
    if method == "equal_weight":
        return row_mean([F.col(c) for c in columns])
    if method == "zscore_average":
        return row_mean([F.try_divide(F.col(c) - F.avg(c).over(cross), F.stddev_samp(c).over(cross)) for c in columns])
    if method != "rank_aggregate":
        raise ValueError(f"unknown method {method!r}")
    return row_sum([mean_rank(F.col(c), time) for c in columns])


def pairwise_rank_correlation(df: DataFrame, signals: Sequence[str], symbol: str = "symbol", time: str = "timestamp") -> DataFrame:
    """Mean over times of the correlation of two signals' ranks: left, right, rank_corr for every ordered pair.

    Ranks are made among each signal's own rows and not again for a pair. A time counts if neither rank is
    constant at it. All pairs come from one aggregation of the wide table; signals are not joined to each other.
    """
    ranked = df.select(time, *[mean_rank(F.col(s), time).alias(s) for s in signals])
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i:]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs.append(F.when((F.stddev_samp(a) > 0) & (F.stddev_samp(b) > 0), F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))).alias(f"c{k}"))
    by = ranked.groupBy(time).agg(*aggs).agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in range(len(pairs))])
    both_ways = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{k}").alias("rank_corr")) for k, (p, q) in enumerate(pairs) for a, b in ({(p, q), (q, p)})]
    return by.select(F.explode(F.array(*both_ways)).alias("r")).select("r.*")


# Return streams ---------------------------------------------------------------------------------------------------


def portfolio_metrics(stream: DataFrame, keys: Sequence[str] = (), time: str = "timestamp", ret: str = "ret", year: int = 252) -> DataFrame:
    """Per key: n, mean, vol, sharpe, hit_rate, max_drawdown, tail_concentration (share of the three best in the total).

    Without keys an empty stream has a row: n is 0 and the rest NULL (vol too).
    """
    first = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    best = Window.partitionBy(*keys).orderBy(F.col(ret).desc(), time)
    s = stream.withColumn("sum_", F.sum(ret).over(first)).withColumn("place_", F.row_number().over(best))
    s = s.withColumn("down_", F.max("sum_").over(first) - F.col("sum_"))
    r = F.col(ret)
    vol = F.when(F.count(r) > 0, F.coalesce(F.stddev_samp(r), F.lit(0.0)))
    return s.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean_return"), vol.alias("vol"), F.when(vol > 1e-12, F.avg(r) / vol * F.sqrt(F.lit(float(year)))).alias("sharpe"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.max("down_").alias("max_drawdown"),
        F.when((F.sum(r) > 0) & (F.count(r) >= 3), F.sum(F.when(F.col("place_") <= 3, r)) / F.sum(r)).alias("tail_concentration"),
    )


def episode_shares(stream: DataFrame, phases: int, keys: Sequence[str] = (), time: str = "timestamp", ret: str = "ret") -> DataFrame:
    """A stream of overlapping returns cut into `phases` cohorts: the share of the three best in all gains, over cohorts."""
    phase = F.pmod(F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1, F.lit(phases))
    gains = stream.withColumn("phase", phase).withColumn("gain", F.greatest(F.col(ret), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy(*keys, "phase").orderBy(F.col("gain").desc(), time))
    by = gains.withColumn("place", place).groupBy(*keys, "phase").agg(
        F.try_divide(F.sum(F.when(F.col("place") <= 3, F.col("gain"))), F.sum("gain")).alias("share"), F.count_if(F.col(ret) > 0).alias("gains")
    )
    return by.groupBy(*keys).agg(F.median("share").alias("median_share"), F.max("share").alias("max_share"), F.count("share").alias("phases"), F.min("gains").alias("least_gains"))


def best_times(stream: DataFrame, n: int, time: str = "timestamp", ret: str = "ret") -> DataFrame:
    """The n times of greatest return."""
    return stream.orderBy(F.col(ret).desc(), time).limit(n)


def long_only(df: DataFrame, market: DataFrame, time: str = "timestamp", least: int = 10, quantile: float = 0.8) -> DataFrame:
    """Per time with at least `least` names: mean return of the top names less the market's, and the share of names new to the top.

    market: time, market_fwd. New means not in the top of the previous time that counts.
    """
    pairs = _pairs(df, "signal", "fwd")
    edge = pairs.groupBy(time).agg(F.count(F.lit(1)).alias("n"), F.percentile("signal", F.lit(quantile)).alias("edge")).where(F.col("n") >= least)
    top = pairs.join(edge, time).where("signal >= edge").join(market, time).where("market_fwd is not null")
    days = top.select(time).distinct()
    days = days.withColumn("prev_", F.lag(time).over(Window.orderBy(time)))  # one row per time
    top = top.join(days, time)
    last = F.lag(time).over(Window.partitionBy("symbol").orderBy(time))
    top = top.withColumn("new_", F.when(F.col("prev_").isNull(), None).when(last.eqNullSafe(F.col("prev_")), 0).otherwise(1))
    return top.groupBy(time).agg((F.avg("fwd") - F.first("market_fwd")).alias("ret"), F.avg("new_").alias("turnover"), F.count(F.lit(1)).alias("names"))


def long_only_net(stream: DataFrame, half_spread: Column, least: int = 3) -> DataFrame:
    """One row for a long_only stream: days, mean, hit rate, mean turnover (the first day turns over nothing), and the mean less the round trip on what is turned over.

    half_spread: as a share of the price. With fewer than `least` days all but the days are NULL.
    """
    enough = F.count("ret") >= least
    turned = F.avg(F.coalesce("turnover", F.lit(0.0)))
    row = stream.agg(F.count("ret").alias("days"), *[F.when(enough, x).alias(n) for n, x in (("mean", F.avg("ret")), ("hit_rate", F.avg((F.col("ret") > 0).cast("double"))), ("turnover", turned))])
    return row.withColumn("net", F.col("mean") - F.col("turnover") * 2 * half_spread)


def grouped_streams(df: DataFrame, groups: Sequence[str], **columns) -> DataFrame:
    """The long-short stream and its metrics within each label of each grouping: grouping, label, and portfolio_metrics."""
    entries = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("label")) for g in groups])
    long = df.select("symbol", "timestamp", "signal", "fwd", F.explode(entries).alias("g_")).select("symbol", "timestamp", "signal", "fwd", "g_.*").where("label is not null")
    return portfolio_metrics(long_short(long, ["grouping", "label"], **columns), ["grouping", "label"])


def evaluation(df: DataFrame, keys: Sequence[str] = (), quantiles: int = 5, cost_bps: float = 10.0) -> DataFrame:
    """One row per key with all metrics: periods, assets, ic, rank_ic, quantile_spread, turnover, net spread, and the portfolio's.

    df: keys, symbol, timestamp, signal, fwd. Keys without a defined metric have NULL there. The input and the statistics per
    time are made once and kept in the shared folder; the one-row-per-key results are joined.
    """
    df = cut(df.select(*keys, "symbol", "timestamp", "signal", "fwd"))
    by = cut(_by_time(df, keys, quantiles=quantiles))
    rows = df.groupBy(*keys).agg(F.count_distinct("timestamp").alias("n_periods"), F.count_distinct("symbol").alias("n_assets"))
    stream = by.where("ret is not null").select(*keys, "timestamp", "ret")
    parts = [by.groupBy(*keys).agg(*[F.avg(c).alias(n) for c, n in (("ic", "ic"), ("rank_ic", "rank_ic"), ("ret", "quantile_spread"))]), turnover(df, keys), portfolio_metrics(stream, keys).drop("n")]
    for p in parts:
        rows = rows.join(p, list(keys), "left") if keys else rows.join(p, F.lit(True), "left")
    return rows.withColumn("net_spread", net_of_cost(F.col("quantile_spread"), F.col("turnover"), cost_bps))


def _by_time(df: DataFrame, keys: Sequence[str], quantiles: int, least: int = 3) -> DataFrame:
    """Per time what ic_by_time, rank_ic_by_time and long_short give, in one shuffle: keys, timestamp, ic, rank_ic, ret.

    Ranks and quantile edges are windows over the same cross-section, whose rows are bounded by the number of symbols.
    """
    cross = Window.partitionBy(*keys, "timestamp")
    at = [i / quantiles for i in range(quantiles + 1)]
    pairs = _pairs(df, "signal", "fwd").select(*keys, "timestamp", F.col("signal").alias("s"), F.col("fwd").alias("r"))
    pairs = pairs.withColumns({"rs": mean_rank(F.col("s"), *keys, "timestamp"), "rr": mean_rank(F.col("r"), *keys, "timestamp"), "e": F.array_distinct(F.percentile("s", F.array(*map(F.lit, at))).over(cross))})
    edges = (F.count(F.lit(1)) >= quantiles) & (F.size(F.first("e")) >= 3)
    top, bottom = F.avg(F.when(F.col("s") > F.try_element_at("e", F.lit(-2)), F.col("r"))), F.avg(F.when(F.col("s") <= F.try_element_at("e", F.lit(2)), F.col("r")))

    def corr(x: str, y: str) -> Column:
        a, b = F.stddev_samp(x), F.stddev_samp(y)
        return F.when((F.count(F.lit(1)) >= least) & (a > 0) & (b > 0), F.covar_samp(x, y) / (a * b))

    return pairs.groupBy(*keys, "timestamp").agg(corr("s", "r").alias("ic"), corr("rs", "rr").alias("rank_ic"), F.when(edges, top - bottom).alias("ret"))


def ic_by_horizon(df: DataFrame, horizons: Mapping[int, str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean IC and rank-IC per horizon in one pass over the returns, and how many horizons share the first one's sign of rank-IC."""
    entries = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("fwd")) for h, c in horizons.items()])
    long = df.select(*keys, "timestamp", "signal", F.explode(entries).alias("e")).select(*keys, "timestamp", "signal", "e.*")
    out = mean_ic(long, [*keys, "horizon"]).select(*keys, "horizon", "ic").join(mean_rank_ic(long, [*keys, "horizon"]).select(*keys, "horizon", "rank_ic"), [*keys, "horizon"])
    all_ = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    primary = F.first(F.when(F.col("horizon") == next(iter(horizons)), F.col("rank_ic")), True).over(all_.orderBy("horizon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("primary_", primary).withColumn("same_sign", F.count_if((F.col("rank_ic") > 0) == (F.col("primary_") > 0)).over(all_)).drop("primary_")
